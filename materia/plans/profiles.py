"""Queries on profiles, counters, top lists and samples of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import profile as P
from materia.plans.texts import LINES_SQL
from materia.registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("a8_job_counters", f"""WITH {LINES_SQL} SELECT (SELECT count(*) FROM documents) AS documents_read, (SELECT count(*) FROM lines) AS lines_read, count(*) AS lines_kept,
  (SELECT count(*) FROM (SELECT doc_id, line FROM kept GROUP BY 1, 2)) AS distinct_lines FROM kept""")
def counters(spark, sf):
    d = docs(spark, sf).select("doc_id", F.size(F.split("text", "\n")).alias("raw"), X.blocks(F.col("text")).alias("b"))
    return d.agg(F.count("*").alias("documents_read"), F.sum("raw").alias("lines_read"), F.sum(F.size("b")).alias("lines_kept"), F.sum(F.size(F.array_distinct("b"))).alias("distinct_lines"))


@query("a9_length_stats", "SELECT count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, median(length(text)) AS median, round_even(avg(length(text)), 2) AS mean FROM documents")
def length_stats(spark, sf):
    return P.length_stats(docs(spark, sf), F.length("text"))


@query("a10_length_stats_by_key", "SELECT source, lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, median(n_chars) AS median, round_even(avg(n_chars), 2) AS mean FROM documents GROUP BY source, lang")
def length_by_key(spark, sf):
    return P.length_stats(docs(spark, sf), F.col("n_chars"), ["source", "lang"])


@query("a11_nearest_rank", "WITH p AS (SELECT quantile_disc(n_chars, 0.95) AS limit_value FROM documents) SELECT limit_value, count(*) FILTER (n_chars >= limit_value) AS at_or_above FROM documents, p GROUP BY limit_value")
def percentile(spark, sf):
    return P.nearest_rank(docs(spark, sf), "n_chars", 0.95)


@query("a12_duplicate_report", f"WITH {LINES_SQL} SELECT line, count(*) AS n, count(*) - 1 AS extra FROM kept GROUP BY line HAVING count(*) > 1")
def duplicate_report(spark, sf):
    lines = docs(spark, sf).select(F.explode(X.blocks(F.col("text"))).alias("line"))
    return P.duplicates(lines, "line")


@query("a13_key_coverage", """SELECT source, round(100.0 * count(*) FILTER (contains(text, '|')) / count(*), 4) AS tables, round(100.0 * count(*) FILTER (contains(text, '@')) / count(*), 4) AS addresses,
  round(100.0 * count(*) FILTER (contains(text, chr(10))) / count(*), 4) AS paragraphs FROM documents GROUP BY source""")
def coverage(spark, sf):
    has = lambda s: F.when(F.contains("text", F.lit(s)), F.lit(True))
    keys = F.map_filter(F.create_map(F.lit("tables"), has("|"), F.lit("addresses"), has("@"), F.lit("paragraphs"), has("\n")), lambda k, v: v.isNotNull())
    d = docs(spark, sf).select("source", keys.alias("sections"))
    return d.groupBy("source").agg(*(F.round(100.0 * F.count_if(F.map_contains_key("sections", k)) / F.count("*"), 4).alias(k) for k in ("tables", "addresses", "paragraphs")))


@query("a14_schema_profile", "SELECT key AS field, CASE WHEN json_type(props, '$.' || key) = 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.' || key) END AS type, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2")
def schema_profile(spark, sf):
    v = table(spark, sf, "events").select(F.try_parse_json("props").alias("v"))
    fields = v.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return fields.groupBy(F.col("key").alias("field"), F.schema_of_variant("value").alias("type")).agg(F.count("*").alias("n"))


_FLAGS = (("has_digit", r"[0-9]"), ("has_pipe", r"\|"), ("has_at", "@"), ("has_parenthesis", r"\("), ("has_percent", "%"), ("has_plus", r"\+"), ("has_slash", "/"))


@query("a15_pattern_flags", "SELECT lang, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in _FLAGS) + " FROM documents GROUP BY lang")
def pattern_flags(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(F.col("text").rlike(p)).alias(n) for n, p in _FLAGS))


@query("a15_unit_histogram", r"SELECT unit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z]{2,4}')) AS unit FROM documents) GROUP BY unit")
def unit_histogram(spark, sf):
    return docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z]{2,4})"), 1)).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query("a16_popularity", """WITH w AS (SELECT lower(word) AS name, word AS form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM documents) GROUP BY 1, 2)
  SELECT name, sum(n) AS n, min(form) FILTER (n = top) AS form FROM (SELECT *, max(n) OVER (PARTITION BY name) AS top FROM w) GROUP BY name ORDER BY n DESC, name LIMIT 50""")
def popularity(spark, sf):
    words = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]{6,})"), 1)).alias("form"))
    forms = words.groupBy(F.lower("form").alias("name"), "form").agg(F.count("*").alias("n"))
    named = forms.groupBy("name").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), "form")).alias("top"))
    return named.select("name", F.col("total").alias("n"), F.col("top.form").alias("form")).orderBy(F.desc("n"), "name").limit(50)


@query("a17_brand_counts", "SELECT sum(greatest(n - 1, 0)) AS duplicate_brands, count(*) FILTER (t = 1) AS single, count(*) FILTER (t > 1) AS multi FROM (SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS t FROM part GROUP BY p_brand)")
def brand_counts(spark, sf):
    b = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("t"))
    return b.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("duplicate_brands"), F.count_if(F.col("t") == 1).alias("single"), F.count_if(F.col("t") > 1).alias("multi"))


@query("k4_longest", f"WITH {LINES_SQL} SELECT doc_id, line, length(line) AS size FROM (SELECT DISTINCT doc_id, line FROM kept) ORDER BY size DESC, doc_id, line LIMIT 20")
def longest(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(X.blocks(F.col("text")))).alias("line"))
    return lines.withColumn("size", F.length("line")).orderBy(F.desc("size"), "doc_id", "line").limit(20)


@query("k5_most_common", "SELECT n_chars, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY n_chars ORDER BY n DESC, first_seen LIMIT 30")
def most_common(spark, sf):
    return P.most_common(docs(spark, sf), "n_chars", 30, "doc_id")


@query("k6_seeded_sample")
def seeded_sample(spark, sf):
    return P.sample(docs(spark, sf).select("doc_id", "source"), "doc_id", 50)


@query("k6_sample_groups", """SELECT lang, 'longest' AS kind, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5
  UNION ALL SELECT lang, 'shortest', doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents) WHERE k <= 5""")
def sample_groups(spark, sf):
    d = docs(spark, sf)
    long = P.first_by_group(d, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 5).select("lang", F.lit("longest").alias("kind"), "doc_id")
    short = P.first_by_group(d, ["lang"], [F.asc("n_chars"), F.asc("doc_id")], 5).select("lang", F.lit("shortest").alias("kind"), "doc_id")
    return long.unionByName(short)


@query("k9_sorted_output", "SELECT slug, doc_id FROM (SELECT source || '-' || lang AS slug, doc_id FROM documents)")
def sorted_output(spark, sf):
    d = docs(spark, sf).select(F.concat_ws("-", "source", "lang").alias("slug"), "doc_id")
    return d.repartitionByRange("slug", "doc_id").sortWithinPartitions("slug", "doc_id")


@query("a24_failure_histogram", """SELECT CASE WHEN h1 = '' THEN 'missing_title' WHEN n <= 2000 THEN 'too_short' WHEN p < 4 THEN 'too_few_sections' ELSE 'valid' END AS reason, count(*) AS n FROM
  (SELECT regexp_extract(html, '<h1>([^<]*)', 1) AS h1, length(html) AS n, len(string_split(html, '<p>')) - 1 AS p FROM pages) GROUP BY 1""")
def failure_histogram(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("html", "<h1>([^<]*)", 1).alias("h1"), F.length("html").alias("n"), (F.size(F.split("html", "<p>")) - 1).alias("p"))
    reason = F.when(F.col("h1") == "", "missing_title").when(F.col("n") <= 2000, "too_short").when(F.col("p") < 4, "too_few_sections").otherwise("valid")
    return p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("a25_scored_cases", """SELECT result_type, count(*) AS cases, round(avg(score), 4) AS mean_score FROM (SELECT CASE WHEN toxic = 1 THEN 'flagged' ELSE 'clean' END AS result_type,
  30.0 * (quality = 1)::INT + 25.0 * (toxic = 0)::INT + 15.0 * (n_chars >= 200)::INT + 10.0 * contains(text, '.')::INT + 10.0 * (NOT contains(text, '|'))::INT + 10.0 * (lang IN ('en', 'de'))::INT AS score
  FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def scored_cases(spark, sf):
    """Six weighted pass/fail criteria to per cent, then means by result type."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    criteria = ((30.0, F.col("quality") == 1), (25.0, F.col("toxic") == 0), (15.0, F.col("n_chars") >= 200), (10.0, F.contains("text", F.lit("."))), (10.0, ~F.contains("text", F.lit("|"))), (10.0, F.col("lang").isin("en", "de")))
    score = sum((w * c.cast("int") for w, c in criteria), F.lit(0.0))
    kind = F.when(F.col("toxic") == 1, "flagged").otherwise("clean")
    return d.groupBy(kind.alias("result_type")).agg(F.count("*").alias("cases"), F.round(F.avg(score), 4).alias("mean_score"))
