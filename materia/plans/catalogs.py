"""Queries on the ingredient catalog. Chunks: documents; slug = source, section = lang, order = doc_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import catalog as C
from materia.operators.running import running
from materia.registry import query, table

CHUNKS_SQL = """chunks AS (SELECT doc_id AS seq, doc_id AS chunk_id, source AS slug, lang AS section, CASE WHEN doc_id % 2 = 0 THEN 'trungtamthuoc' ELSE 'longchau' END AS source,
  CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS entity_name, lang AS language, 'https://example.org/' || doc_id AS url FROM documents)"""


def chunks(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("slug"), F.col("lang").alias("section"),
        F.when(F.col("doc_id") % 2 == 0, "trungtamthuoc").otherwise("longchau").alias("source"),
        F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source")).alias("entity_name"),
        F.col("lang").alias("language"), F.concat(F.lit("https://example.org/"), "doc_id").alias("url"),
    )


@query("a1_catalog_build", f"""WITH {CHUNKS_SQL}, names AS (SELECT slug, entity_name, count(*) AS n, min(seq) AS f FROM chunks GROUP BY 1, 2), langs AS (SELECT slug, language, count(*) AS n, min(seq) AS f FROM chunks GROUP BY 1, 2)
  SELECT 'ingredient:' || c.slug AS catalog_id, count(*) AS chunk_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  arg_min(url, seq) AS url, (SELECT entity_name FROM names x WHERE x.slug = c.slug ORDER BY n DESC, f LIMIT 1) AS entity_name, (SELECT language FROM langs x WHERE x.slug = c.slug ORDER BY n DESC, f LIMIT 1) AS language,
  count(*) FILTER (section = 'en') AS sections_en, count(*) FILTER (source = 'longchau' AND section = 'en') AS longchau_en, (SELECT count(*) FROM names x WHERE x.slug = c.slug) > 1 AS warned
  FROM chunks c GROUP BY c.slug""")
def build(spark, sf):
    c = C.build(chunks(spark, sf))
    return c.select(
        "catalog_id", "chunk_count", F.array_join("sources", ",").alias("sources"), "url", "entity_name", "language",
        F.coalesce(F.try_element_at("section_counts", F.lit("en")), F.lit(0)).cast("long").alias("sections_en"),
        F.coalesce(F.try_element_at("section_counts_by_source", F.lit("longchau/en")), F.lit(0)).cast("long").alias("longchau_en"), (F.size("warnings") > 0).alias("warned"),
    )


@query("a2_representative", f"WITH {CHUNKS_SQL} SELECT slug, entity_name, forms AS entity_name_forms FROM (SELECT slug, entity_name, count(*) OVER (PARTITION BY slug) AS forms, row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, min(seq)) AS k FROM chunks GROUP BY slug, entity_name) WHERE k = 1")
def representative(spark, sf):
    return C.representative(chunks(spark, sf), "slug", "entity_name", "seq")


@query("a3_first_and_last", f"WITH {CHUNKS_SQL} SELECT slug, source, arg_min(url, seq) AS first_url, arg_max(language, seq) AS last_language FROM chunks GROUP BY slug, source")
def first_and_last(spark, sf):
    return chunks(spark, sf).groupBy("slug", "source").agg(F.min_by("url", "seq").alias("first_url"), F.max_by("language", "seq").alias("last_language"))


@query("a4_capped_sample", f"WITH {CHUNKS_SQL} SELECT slug, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY seq) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq) AS k FROM chunks) WHERE k <= 5 GROUP BY slug")
def capped_sample(spark, sf):
    return C.capped_sample(chunks(spark, sf), "slug", "chunk_id", "seq").select("slug", F.array_join("sample", ",").alias("sample"))


@query("a5_warning_set", """WITH w AS (SELECT source AS slug, unnest(CASE WHEN doc_id % 2 = 0 THEN [lang || '_b', 'common'] ELSE ['common', lang || '_a'] END) AS warning, doc_id, unnest([1, 2]) AS p FROM documents),
  f AS (SELECT slug, warning, min((doc_id, p)) AS seen FROM w GROUP BY 1, 2) SELECT slug, string_agg(warning, ',' ORDER BY seen) AS warnings FROM f GROUP BY slug""")
def warning_set(spark, sf):
    w = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat("lang", F.lit("_b")), F.lit("common"))).otherwise(F.array(F.lit("common"), F.concat("lang", F.lit("_a"))))
    rows = table(spark, sf, "documents").select(F.col("source").alias("slug"), "doc_id", w.alias("warnings"))
    return C.in_first_seen_order(rows, "slug", "warnings", "doc_id").select("slug", F.array_join("warnings", ",").alias("warnings"))


@query("a6_product_build", """SELECT o_orderkey, arg_min(l_returnflag, l_linenumber) AS flag, string_agg(l_partkey || 'x' || CAST(l_quantity AS BIGINT), '; ' ORDER BY l_linenumber, l_partkey, l_quantity) AS contents, count(DISTINCT l_returnflag) > 1 AS inconsistent
  FROM orders JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def product_build(spark, sf):
    """Lines of an order as the chunks of one file: first value, ordered text, inconsistency flag."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w)).filter("k = 1")
    text = F.concat("l_partkey", F.lit("x"), F.col("l_quantity").cast("long"))
    joined = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(
        F.min_by("l_returnflag", "l_linenumber").alias("flag"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", text.alias("t")))), lambda x: x.t), "; ").alias("contents"),
        (F.countDistinct("l_returnflag") > 1).alias("inconsistent"),
    )


@query("a7_brand_map", "SELECT p_brand, arg_max(p_partkey, p_partkey) AS product_id FROM part GROUP BY p_brand")
def brand_map(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_partkey", "p_partkey").alias("product_id"))


@query("a27_distinct_in_order", """SELECT conv_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT conv_id, word, min(turn * 100000 + i) AS i FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word,
  generate_subscripts(regexp_extract_all(lower(text), '[a-z]{5,}'), 1) AS i FROM conversations) GROUP BY conv_id, word) GROUP BY conv_id""")
def distinct_in_order(spark, sf):
    """Words of all turns of a conversation, each where it is first met."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))
    return C.in_first_seen_order(turns, "conv_id", "words", "turn").select("conv_id", F.array_join("words", " ").alias("words"))


@query("a28_dictionary_stats", """SELECT count(*) AS records, count(*) FILTER (p_size > 25) AS with_ingredients, count(*) FILTER (p_size % 3 = 0) AS high, count(DISTINCT lower(p_name)) AS name_keys, count(DISTINCT lower(p_brand)) AS brand_keys FROM part""")
def dictionary_stats(spark, sf):
    p = table(spark, sf, "part")
    return p.agg(F.count("*").alias("records"), F.count_if(F.col("p_size") > 25).alias("with_ingredients"), F.count_if(F.col("p_size") % 3 == 0).alias("high"),
                 F.countDistinct(X.normalize(F.col("p_name"))).alias("name_keys"), F.countDistinct(X.normalize(F.col("p_brand"))).alias("brand_keys"))


@query("f22_chunk_identity", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN lang || '-' || source WHEN 2 THEN source || '-name' END AS slug,
  CASE doc_id % 4 WHEN 0 THEN source || ' title' WHEN 1 THEN lang || ' ' || source WHEN 2 THEN source || ' Name' END AS entity_name,
  CASE doc_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'chunk_id' WHEN 2 THEN 'entity_name' END AS slug_source,
  CASE doc_id % 4 WHEN 1 THEN 'entity_name_derived_from_slug' ELSE '' END AS warnings FROM documents""")
def chunk_identity(spark, sf):
    k = F.col("doc_id") % 4
    made = C.with_identity(
        table(spark, sf, "documents").select("doc_id", "source", "lang"), F.when(k == 0, F.col("source")),
        F.when(k == 1, F.concat(F.lit("longchau:ingredient:"), "lang", F.lit("-"), "source", F.lit(":x:0001"))).otherwise("plain"),
        F.when(k == 2, F.concat("source", F.lit(" Name"))), F.when(k == 0, F.concat("source", F.lit(" title"))).when(k == 1, F.concat("source", F.lit(" là thuốc gì?"))),
    )
    return made.select("doc_id", "identity.slug", "identity.entity_name", "identity.slug_source", F.array_join("identity.warnings", ",").alias("warnings"))


@query("w1_running_index", "SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS chunk_index FROM documents")
def running_index(spark, sf):
    return running(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], chunk_index=("count", None))


@query("w2_first_seen_dedup", "SELECT key, min(doc_id) AS doc_id, count(*) - 1 AS quarantined FROM (SELECT md5(text) AS key, doc_id FROM documents) GROUP BY key")
def first_seen(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id")
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("quarantined"))


@query("w3_duplicate_keys", "SELECT key, count(*) AS n FROM (SELECT source || '/' || lang || '/' || n_chars AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return table(spark, sf, "documents").groupBy(F.concat_ws("/", "source", "lang", "n_chars").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


@query("j20_duplicate_id_fallback", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand || p_size) = 1 THEN p_brand || p_size ELSE replace(p_name, ' ', '-') || '-' || p_partkey END AS product_key FROM part")
def id_fallback(spark, sf):
    """An id counts only where it is unique over the whole input; the count is aggregated, not windowed."""
    p = table(spark, sf, "part").withColumn("id", F.concat("p_brand", "p_size"))
    unique = p.groupBy("id").count().filter("count = 1").select("id", F.lit(True).alias("unique"))
    key = F.when(F.col("unique"), F.col("id")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey"))
    return p.join(unique, "id", "left").select("p_partkey", key.alias("product_key"))


@query("u1_union_sources", "SELECT source_table, key, text FROM (SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS key, md5(text) AS text FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), md5(text) FROM benchmark)")
def union_sources(spark, sf):
    one = lambda name, key: table(spark, sf, name).select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("key"), F.md5(F.col("text").cast("binary")).alias("text"))
    return one("documents", "doc_id").unionByName(one("benchmark", "item_id"))


@query("u4_not_current", "SELECT vec_id FROM embeddings WHERE NOT (vec_id % 3 = 0)")
def not_current(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    return e.join(e.filter("vec_id % 3 = 0"), "vec_id", "left_anti")


@query("u5_urls_not_done", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def urls_not_done(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.join(p.filter("page_id % 4 = 0").select("url").distinct(), "url", "left_anti").select("page_id", "url")


@query("a26_reindex_summary", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 'current' WHEN label = 0 THEN 'invalid' ELSE 'to_reindex' END AS state FROM embeddings) GROUP BY state")
def reindex_summary(spark, sf):
    state = F.when(F.col("vec_id") % 3 == 0, "current").when(F.col("label") == 0, "invalid").otherwise("to_reindex")
    return table(spark, sf, "embeddings").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
