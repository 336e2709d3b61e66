"""Queries on landing. Lines: events as JSON, of which a fixed rule damages some; files: written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators.running import running
from materia.registry import query, table
from materia.sources import landing as L
from materia.sources.shared import shared_table


def damaged(spark, sf):
    """Events as lines: every tenth cut short, every eleventh an array, every twelfth without its type."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 12 == 0, "").otherwise(F.col("event_type"))
    whole = F.to_json(F.struct("event_id", "user_id", kind.alias("event_type"), "props"))
    line = F.when(F.col("event_id") % 10 == 0, F.left(whole, F.lit(20))).when(F.col("event_id") % 11 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    return e.select(F.col("event_id").alias("line_number"), line.alias("line"))


REASON_SQL = "CASE WHEN event_id % 10 = 0 THEN 'invalid_json' WHEN event_id % 11 = 0 THEN 'invalid_schema' WHEN event_id % 12 = 0 THEN 'missing_required_fields' END"


@query("s1_quarantine", f"SELECT event_id AS line_number, {REASON_SQL} AS reason FROM events WHERE {REASON_SQL} IS NOT NULL")
def quarantine(spark, sf):
    landed = L.land(damaged(spark, sf), ["event_id", "event_type"])
    return landed.filter(F.col("reason").isNotNull()).select("line_number", "reason")


@query("s2_strict_counts", f"SELECT {REASON_SQL} AS reason, count(*) AS n FROM events WHERE {REASON_SQL} IS NOT NULL GROUP BY 1")
def strict_counts(spark, sf):
    """What a strict run would fail on."""
    return L.land(damaged(spark, sf), ["event_id", "event_type"]).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


@query("f3_missing_fields", "SELECT event_id AS line_number, 'event_type' AS missing FROM events WHERE event_id % 12 = 0 AND event_id % 10 <> 0 AND event_id % 11 <> 0")
def missing_fields(spark, sf):
    landed = L.land(damaged(spark, sf), ["event_id", "event_type"])
    return landed.filter("reason = 'missing_required_fields'").select("line_number", F.array_join("missing", ",").alias("missing"))


def work_dir(spark, label):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/materia-{label}-{uuid.uuid4().hex}"


@query("s6_multi_source_lines", """SELECT 2 AS sources_read, (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) AS lines_read, (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) AS numbered,
  (SELECT sum(event_id) FROM events) + (SELECT sum(o_orderkey) FROM orders) AS keys""")
def multi_source_lines(spark, sf):
    """Two tables written as JSON lines and read back as one stream; numbers run from 1 to the last line of each file (S6, S7)."""
    root = work_dir(spark, "lines")
    for name in ("events", "orders"):
        L.publish(table(spark, sf, name), f"{root}/{name}")
    rows = L.read_lines(spark, [f"{root}/events", f"{root}/orders"])
    key = F.get_json_object("line", "$.event_id").cast("long"), F.get_json_object("line", "$.o_orderkey").cast("long")
    per_file = rows.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("line_number").alias("numbers"), F.min("line_number").alias("first"), F.max("line_number").alias("last"), F.sum(F.coalesce(*key)).alias("keys"))
    whole = F.when((F.col("first") == 1) & (F.col("last") == F.col("n")), F.col("numbers")).otherwise(0)
    source = F.element_at(F.split("path", "/"), -2)
    return per_file.agg(F.countDistinct(source).alias("sources_read"), F.sum("n").alias("lines_read"), F.sum(whole).alias("numbered"), F.sum("keys").alias("keys"))


@query("s3_recursive_files", "SELECT p_brand AS category, count(*) AS files_read, sum(items) AS items_read FROM (SELECT p_brand, p_size, count(*) AS items FROM part GROUP BY 1, 2) GROUP BY 1")
def recursive_files(spark, sf):
    """One file of a JSON array per brand and size, in a folder per brand; the path gives the category (S3, S4)."""
    root = work_dir(spark, "files")
    arrays = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name"))).alias("value"))
    arrays.select("value", F.concat(F.lit("b"), F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand"), F.col("p_size").alias("size")).repartition("brand", "size").write.partitionBy("brand", "size").text(root)
    files = L.read_files(spark, L.first_with_files(spark, [f"{root}-absent", root]))
    items = L.explode_items(files).groupBy("path").agg(F.max("item_number").alias("n"))
    brand = F.replace(F.regexp_extract("path", "brand=b([^/]+)", 1), F.lit("-"), F.lit("#"))
    return items.groupBy(brand.alias("category")).agg(F.count("*").alias("files_read"), F.sum("n").cast("long").alias("items_read"))


@query("s8_run_report", f"SELECT count(*) AS lines_read, count(*) FILTER ({REASON_SQL} IS NULL) AS valid, count(*) FILTER ({REASON_SQL} = 'invalid_json') AS invalid_json FROM events")
def run_report(spark, sf):
    """The report row, written beside the data and read back."""
    landed = L.land(damaged(spark, sf), ["event_id", "event_type"])
    row = landed.agg(F.count("*").alias("lines_read"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason") == "invalid_json").alias("invalid_json"))
    path = work_dir(spark, "report")
    L.report(row, path)
    return spark.read.schema(row.schema).json(path)


class HashEncoder:
    """Stand-in for a text encoder: eight numbers of a text's digest."""

    def encode(self, texts):
        import hashlib

        return [[b / 255 for b in hashlib.sha256((t or "").encode()).digest()[:8]] for t in texts]


@query("s9_vector_load", "SELECT count(*) AS points, count(*) FILTER (doc_id % 3 = 0) AS replaced, count(*) * 8 AS numbers FROM documents")
def vector_load(spark, sf):
    """Deterministic ids, encoded in batches, upserted over the points stored before (S9, D1)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    stored = d.select("doc_id", F.array_repeat(F.lit(0.0).cast("float"), 8).alias("vector"), F.lit(False).alias("is_new"))
    new = L.encode(d.filter("doc_id % 3 = 0"), "text", HashEncoder).select("doc_id", "vector", F.lit(True).alias("is_new"))
    points = L.upsert(stored, new, "doc_id")
    return points.agg(F.count("*").alias("points"), F.count_if("is_new").alias("replaced"), F.sum(F.size("vector")).alias("numbers"))


@query("s12_payload_scan", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def payload_scan(spark, sf):
    """Filter pushed to the scan; the vector column isn't read."""
    return table(spark, sf, "embeddings").filter("label = 3").select("vec_id", "label")


@query("f1_field_precedence", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS catalog_order, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS loader_order FROM documents")
def field_precedence(spark, sf):
    """Metadata first, or the record first; an empty string counts as null."""
    meta, record = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    none = lambda c: F.nullif(c, F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(none(meta), F.col("source")).alias("catalog_order"), F.coalesce(none(record), F.col("lang")).alias("loader_order"))


@query("f2_flat_payload", "SELECT doc_id, CASE source WHEN 'src1' THEN 'Source one' ELSE source END AS source_name, CASE WHEN doc_id % 5 = 0 THEN 'url' ELSE '' END AS missing FROM documents")
def flat_payload(spark, sf):
    names = F.create_map(F.lit("src1"), F.lit("Source one"))
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 5 == 0, "").otherwise("u").alias("url"), "text")
    missing = L.missing_fields(lambda n: F.col(n), ["source", "lang", "url", "text"])
    return d.select("doc_id", F.coalesce(F.try_element_at(names, F.col("source")), F.col("source")).alias("source_name"), F.array_join(missing, ",").alias("missing"))


@query("f5_single_key", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def single_key(spark, sf):
    return table(spark, sf, "documents").filter("source = 'src3'").select("doc_id", "lang")


@query("s10_note_upsert", "SELECT doc_id AS note_id, sha256('passage: ' || text) AS embedding_text_hash, CASE WHEN doc_id % 4 = 0 THEN 'semantic-v2' ELSE 'v1' END AS version FROM documents")
def note_upsert(spark, sf):
    """Notes keyed by id, with hash and version of the embedded text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.sha2(F.concat(F.lit("passage: "), "text"), 256).alias("embedding_text_hash"))
    return L.upsert(d.withColumn("version", F.lit("v1")), d.filter("note_id % 4 = 0").withColumn("version", F.lit("semantic-v2")), "note_id")


@query("f21_public_projection", "SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS score, CAST(label AS VARCHAR) AS slug FROM embeddings")
def public_projection(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("score"), F.col("label").cast("string").alias("slug"))


@query("d3_record_expansion", "SELECT source, count(*) AS lines FROM (SELECT source, unnest(string_split(text, chr(10))) FROM documents) GROUP BY source")
def record_expansion(spark, sf):
    return table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n"))).groupBy("source").agg(F.count("*").alias("lines"))


@query("x19_brand_name", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE p_name END AS brand, p_partkey % 2 = 1 AS fallback FROM part")
def brand_names(spark, sf):
    """First word after a form prefix; else the leading words up to a dose."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Viên nén ").otherwise(""), "p_name", F.lit(" 20mg hộp"))
    bare, had = X.form_stripped(name), X.form_stripped(name) != X.normalize(name)
    head = F.regexp_extract(bare, r"^(.*?)\s*(?:\d+(?:[.,/]\d+)*(?:mg|g|mcg|µg|ml|iu|ui|%).*)?$", 1)
    words = F.array_join(F.slice(F.split(head, " "), 1, 4), " ")
    return table(spark, sf, "part").select("p_partkey", F.when(had, F.split(bare, " ")[0]).otherwise(words).alias("brand"), (~had).alias("fallback"))


@query("s4_array_items", "SELECT p_brand AS category, p_size AS size, count(*) AS items, min(p_partkey) AS first_key FROM part GROUP BY 1, 2")
def array_items(spark, sf):
    """One JSON array per file, exploded with item numbers from 1."""
    root = work_dir(spark, "arrays")
    arrays = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.to_json(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))).alias("value"))
    arrays.select("value", F.concat(F.lit("b"), F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("brand"), F.col("p_size").alias("size")).repartition("brand", "size").write.partitionBy("brand", "size").text(root)
    items = L.explode_items(L.read_files(spark, root))
    key = F.try_variant_get("item", "$.p_partkey", "long")
    made = items.groupBy("path").agg(F.max("item_number").cast("long").alias("items"), F.min_by(key, "item_number").alias("first_key"))
    brand = F.replace(F.regexp_extract("path", "brand=b([^/]+)", 1), F.lit("-"), F.lit("#"))
    return made.select(brand.alias("category"), F.regexp_extract("path", r"size=(\d+)", 1).cast("int").alias("size"), "items", "first_key")


@query("s5_source_fallback", "SELECT o_orderstatus, count(*) AS rows_read FROM orders GROUP BY o_orderstatus")
def source_fallback(spark, sf):
    """The processed folder is absent, so the raw one is read."""
    root = work_dir(spark, "fallback")
    table(spark, sf, "orders").write.json(f"{root}/raw")
    chosen = L.first_with_files(spark, [f"{root}/processed", f"{root}/raw"])
    return spark.read.schema("o_orderstatus string").json(chosen).groupBy("o_orderstatus").agg(F.count("*").alias("rows_read"))


@query("s7_guarded_publish", "SELECT count(*) AS lines_published, true AS refused FROM supplier")
def guarded_publish(spark, sf):
    """A second publish to a path is refused unless asked to overwrite; the first stays whole."""
    from pyspark.errors import AnalysisException

    path = work_dir(spark, "published")
    rows = table(spark, sf, "supplier")
    L.publish(rows, path)
    try:
        L.publish(rows.limit(0), path)
        refused = False
    except AnalysisException:
        refused = True
    L.publish(rows, path, overwrite=True)
    return spark.read.text(path).agg(F.count("*").alias("lines_published")).withColumn("refused", F.lit(refused))


@query("d1_pluggable_encoder", "SELECT doc_id, 8 AS dimensions FROM documents")
def pluggable_encoder(spark, sf):
    """Vectors of all texts by an encoder object, made once a task."""
    made = L.encode(table(spark, sf, "documents").select("doc_id", "text"), "text", HashEncoder)
    return made.select("doc_id", F.size("vector").alias("dimensions"))


@query("s9_keyed_load", """WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) % 3 AS k FROM documents) SELECT count(*) AS points, count(DISTINCT doc_id) AS ids, count(*) FILTER (k = 0) AS renewed, count(*) FILTER (k = 0) AS encoded_again, sum(length(coalesce(text, '')) + CASE WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS chars FROM d""")
def keyed_load(spark, sf):
    """Documents loaded as points, then again with a third of them changed: those alone are encoded, and each takes its own place (S9, S10)."""
    path = work_dir(spark, "points")
    rows = running(table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("text")), [], ["doc_id"], i=("count", None))
    rows = rows.withColumn("k", F.col("i") % 3).drop("i")
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    before = L.load_vectors(rows, path, key, F.col("text"), HashEncoder).select("point_id", F.col("text_hash").alias("was"))
    before = shared_table(before, "before")
    renewed = rows.withColumns({"text": F.when(F.col("k") == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), "n": F.col("n") + (F.col("k") == 0).cast("int")})
    after = L.load_vectors(renewed, path, key, F.col("text"), HashEncoder)
    both = after.join(before, "point_id", "left")
    return both.agg(F.count("*").alias("points"), F.countDistinct("point_id").alias("ids"), F.count_if(F.col("k") == 0).alias("renewed"), F.count_if(F.col("was") != F.col("text_hash")).alias("encoded_again"), F.sum("n").alias("chars"))
