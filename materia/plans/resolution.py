"""Queries on name resolution. Dictionary: ``part``; written names: altered part names, brands and types."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import resolve as R
from materia.registry import query, table


def dictionary(spark, sf):
    """mapping_id, brand_name (name and brand), aliases (name), ingredients (type)."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("mapping_id"), F.concat_ws(" ", "p_name", "p_brand").alias("brand_name"), F.array("p_name").alias("aliases"),
        F.when(F.col("p_size") > 25, F.array("p_type")).otherwise(F.array("p_type", F.concat("p_type", F.lit(" II")))).alias("ingredients"),
        F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "medium").otherwise("low").alias("confidence"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def written_names(spark, sf):
    """Names as a prescription may write them: brand in capitals, alias with a form, or an ingredient."""
    p = table(spark, sf, "part")
    name = (
        F.when(F.col("p_partkey") % 4 == 0, F.upper(F.concat_ws("  ", "p_name", "p_brand"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Viên nén "), "p_name"))
        .when(F.col("p_partkey") % 4 == 2, F.initcap("p_type")).otherwise(F.concat(F.lit("unheard of "), "p_name"))
    )
    return p.select(name.alias("name")).distinct().withColumn("query_id", F.col("name"))


NAMES_SQL = """names AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name || '  ' || p_brand) WHEN 1 THEN 'Viên nén ' || p_name WHEN 2 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE 'unheard of ' || p_name END AS name FROM part),
 asked AS (SELECT name AS query_id, replace(replace(lower(name), '  ', ' '), 'viên nén ', '') AS key FROM names),
 keys AS (SELECT p_partkey AS mapping_id, lower(p_name || ' ' || p_brand) AS key, 2 AS layer FROM part UNION ALL SELECT p_partkey, lower(p_name), 4 FROM part UNION ALL SELECT p_partkey, lower(p_type), 6 FROM part),
 hits AS (SELECT query_id, mapping_id, min(layer) AS layer FROM asked JOIN keys USING (key) GROUP BY 1, 2),
 found AS (SELECT query_id, mapping_id, CASE layer WHEN 2 THEN 'exact_brand' WHEN 4 THEN 'exact_alias' ELSE 'ingredient_name' END AS match_type, CASE WHEN layer <= 4 THEN 1.0 ELSE 0.95 END::DOUBLE AS score
   FROM hits QUALIFY layer = min(layer) OVER (PARTITION BY query_id))"""
RANKED_SQL = NAMES_SQL + """, ranked AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY match_type = 'exact_brand' DESC, match_type = 'exact_alias' DESC, score DESC,
  CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END DESC, p_size > 25 DESC, p_size % 2 = 0, length(p_name || ' ' || p_brand), mapping_id) AS rank FROM found f JOIN part ON p_partkey = mapping_id)"""


def ranked(spark, sf):
    return R.rank_candidates(R.layered_lookup(written_names(spark, sf), dictionary(spark, sf)), dictionary(spark, sf))


@query("j1_layered_lookup", f"WITH {NAMES_SQL} SELECT query_id, match_type, score, count(*) AS candidates, min(mapping_id) AS least_id FROM found GROUP BY ALL")
def layered_lookup(spark, sf):
    found = R.layered_lookup(written_names(spark, sf), dictionary(spark, sf))
    return found.groupBy("query_id", "match_type", "score").agg(F.count("*").alias("candidates"), F.min("mapping_id").alias("least_id"))


@query("k1_candidate_order", f"WITH {RANKED_SQL} SELECT query_id, rank, mapping_id, match_type, score FROM ranked WHERE rank <= 5")
def candidate_order(spark, sf):
    return ranked(spark, sf).select("query_id", "rank", "mapping_id", "match_type", "score")


@query("f13_review_flag", f"WITH {RANKED_SQL} SELECT query_id, match_type = 'ingredient_name' OR p_size % 3 <> 0 OR p_size % 2 = 0 AS requires_review FROM ranked JOIN part ON p_partkey = mapping_id WHERE rank = 1")
def review_flag(spark, sf):
    best = ranked(spark, sf).filter("rank = 1")
    flag = ~F.col("match_type").isin("exact_brand", "exact_alias") | (F.col("confidence") != "high") | (F.size("warnings") > 0)
    return best.select("query_id", flag.alias("requires_review"))


@query("j2_lookup_variants", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'viên nén ' || p_name || ',vien nen ' || p_name || ',' || p_name WHEN 1 THEN p_name ELSE 'crème ' || p_name || ',creme ' || p_name END AS variants FROM part""")
def lookup_variants(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Viên  nén "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("Crème "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.lookup_variants(name), ",").alias("variants"))


def catalog(spark, sf):
    """Catalog of part names; one name in five has no chunks."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return p.select(
        F.col("p_name").alias("catalog_id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.array("p_name").alias("keys"),
        F.when(F.col("first") % 5 == 0, 0).otherwise(F.col("n")).cast("long").alias("chunk_count"), F.array(F.lit("than_trong"), F.lit("x")).alias("sections"),
    )


def ingredient_names(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.initcap("p_name")).when(k == 1, F.concat("p_name", F.lit(" hydrochloride"))).when(k == 2, F.concat(F.lit("DL-"), "p_name")).otherwise(F.concat(F.lit("alias of "), "p_name"))
    return p.select(name.alias("name")).distinct().withColumn("query_id", F.col("name"))


def manual_aliases(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("alias of "), "p_name").alias("alias"), F.col("p_name").alias("target")).distinct()


CATALOG_SQL = """catalog AS (SELECT p_name AS catalog_id, CASE WHEN min(p_partkey) % 5 = 0 THEN 0 ELSE count(*) END AS chunk_count FROM part GROUP BY p_name),
 names AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name[1]) || regexp_replace(p_name[2:], ' (.)', ' ' || upper(p_name[strpos(p_name, ' ') + 1])) WHEN 1 THEN p_name || ' hydrochloride' WHEN 2 THEN 'DL-' || p_name ELSE 'alias of ' || p_name END AS query_id,
   p_name AS target, p_partkey % 4 AS k FROM part),
 found AS (SELECT query_id, catalog_id, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'salt_stripped_exact' WHEN 2 THEN 'prefix_stripped_exact' ELSE 'manual_alias' END AS match_type, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 WHEN 2 THEN 0.94 ELSE 0.99 END::DOUBLE AS score, chunk_count
   FROM names JOIN catalog ON catalog_id = target WHERE k = 0 OR chunk_count > 0)"""


def resolved(spark, sf):
    return R.resolve_ingredients(ingredient_names(spark, sf), catalog(spark, sf), manual_aliases(spark, sf))


@query("j3_ingredient_cascade", f"WITH {CATALOG_SQL} SELECT query_id, catalog_id, match_type, score FROM found")
def cascade(spark, sf):
    return resolved(spark, sf).select("query_id", "catalog_id", "match_type", "score")


@query("j4_manual_aliases", "SELECT DISTINCT 'alias of ' || p_name AS alias, p_name AS target FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING min(p_partkey) % 5 <> 0)")
def manual(spark, sf):
    return manual_aliases(spark, sf).join(catalog(spark, sf).filter("chunk_count > 0"), F.col("target") == F.col("catalog_id"), "left_semi")


@query("k2_evidence_order", f"WITH {CATALOG_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_count DESC, length(catalog_id), catalog_id) AS rank, catalog_id FROM found QUALIFY rank <= 5")
def evidence_order(spark, sf):
    return R.rank_evidence(resolved(spark, sf), catalog(spark, sf)).select("query_id", "rank", "catalog_id")


def misspelt(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    return p.select(F.col("p_name").alias("query_id"), F.replace("p_name", F.lit("i"), F.lit("y")).alias("q"))


@query("j5_fuzzy_join")
def fuzzy(spark, sf):
    """Names with each i written y, against all names; scores of 0.85 and more."""
    choices = table(spark, sf, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("c")).distinct()
    return R.fuzzy_join(misspelt(spark, sf), choices).select("query_id", "id", F.round("score", 6).alias("score"))


@query("d2_levenshtein_join", """WITH n AS (SELECT DISTINCT p_name FROM part) SELECT q.p_name AS query_id, c.p_name AS id, levenshtein(replace(q.p_name, 'i', 'y'), c.p_name) AS distance FROM n q JOIN n c
  ON levenshtein(replace(q.p_name, 'i', 'y'), c.p_name) <= 2""")
def levenshtein(spark, sf):
    """The built-in distance as a backend. Two edits leave one of three parts of the shorter name whole, at most two places off."""
    q = misspelt(spark, sf)
    c = table(spark, sf, "part").select(F.col("p_name").alias("id")).distinct()
    third = lambda s, k: F.floor(F.length(s) * k / 3).cast("int")
    parts = F.array(*(F.struct(F.lit(k).alias("k"), third("id", k).alias("at"), F.substring("id", third("id", k) + 1, third("id", k + 1) - third("id", k)).alias("part")) for k in range(3)))
    kept = c.select("id", F.length("id").alias("n"), F.inline(parts))
    # of each name asked: the parts a choice of each near length would have, at each shift
    lengths = q.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.length("q") - 2), F.length("q") + 2)).alias("n"))
    cut = lambda k: (F.floor(F.col("n") * k / 3).cast("int"))
    shifts = F.sequence(F.lit(-2), F.lit(2))
    asked_part = lambda k: F.transform(shifts, lambda d: F.struct(F.lit(k).alias("k"), F.substring(F.col("q"), cut(k) + d + 1, cut(k + 1) - cut(k)).alias("part")))
    asked = F.flatten(F.array(*map(asked_part, range(3))))
    pairs = lengths.select("query_id", "q", "n", F.inline(asked)).join(kept, ["k", "n", "part"]).select("query_id", "q", "id").distinct()
    return pairs.withColumn("distance", F.levenshtein("q", "id", 2)).filter("distance >= 0").select("query_id", "id", "distance")


@query("j6_pair_guard", """WITH n AS (SELECT DISTINCT p_name, list_filter(string_split(p_name, ' '), lambda x: length(x) >= 3) AS t FROM part) SELECT a.p_name AS query_id, b.p_name AS id FROM n a JOIN n b
  ON list_has_any(a.t, b.t) WHERE len(a.t) <= 1 OR len(list_intersect(a.t, b.t)) >= 2
  OR len(list_filter(b.t, lambda x: (contains(x, a.t[1]) OR contains(a.t[1], x)) AND 2.0 * least(length(x), length(a.t[1])) / (length(x) + length(a.t[1])) >= 0.8)) > 0""")
def pair_guard(spark, sf):
    """Pairs that share a token and that the product guard allows."""
    n = table(spark, sf, "part").select("p_name").distinct()
    a = n.select(F.col("p_name").alias("query_id"), F.explode(R.guard_tokens(F.col("p_name"))).alias("token"))
    b = n.select(F.col("p_name").alias("id"), F.explode(R.guard_tokens(F.col("p_name"))).alias("token"))
    pairs = a.join(b, "token").select("query_id", "id").distinct()
    return pairs.filter(R.pair_allowed(F.col("query_id"), F.col("id")))


@query("j7_deny_list", """SELECT DISTINCT a.l_partkey AS asked, b.l_partkey AS matched FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
  WHERE NOT EXISTS (SELECT 1 FROM part x JOIN part y ON x.p_brand = y.p_brand WHERE x.p_partkey = a.l_partkey AND y.p_partkey = b.l_partkey)""")
def deny_list(spark, sf):
    """Pairs of one order, without pairs on the deny list (here: of one brand)."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    pairs = items.withColumnRenamed("l_partkey", "asked").join(items.withColumnRenamed("l_partkey", "matched"), "l_orderkey").filter("asked < matched").select("asked", "matched").distinct()
    brands = table(spark, sf, "part").select("p_partkey", "p_brand")
    denied = pairs.join(brands.toDF("asked", "ba"), "asked").join(brands.toDF("matched", "bm"), "matched").filter("ba = bm").select("asked", "matched")
    return pairs.join(denied, ["asked", "matched"], "left_anti")


@query("j8_brand_verification", """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 10) FILTER (l_linenumber % 2 = 0)) AS parsed, list_sort(list(DISTINCT l_partkey % 10) FILTER (l_linenumber % 2 = 1)) AS product FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN parsed IS NULL THEN 'not_checked' WHEN product IS NULL THEN 'not_found' WHEN parsed = product THEN 'verified' ELSE 'conflict' END AS verification FROM s""")
def brand_verification(spark, sf):
    slug = (F.col("l_partkey") % 10).cast("string")
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, slug)).alias("parsed"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, slug)).alias("product"))
    return sets.select("l_orderkey", R.verification(F.col("parsed"), F.col("product")).alias("verification"))


@query("j9_generic_first", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 40 THEN 'generic' WHEN p_size > 20 AND NOT (l_quantity > 25 AND p_size % 2 = 0) THEN 'product' WHEN p_size > 10 THEN 'ingredient_only' ELSE 'unmatched' END AS mapping_status
  FROM lineitem JOIN part ON p_partkey = l_partkey""")
def generic_first(spark, sf):
    """Three joins in order; each later one sees only what is unresolved. A product match is refused where a dose is written and it isn't exact."""
    p = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 25).alias("dose"))
    generic = p.filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.lit("generic").alias("g"))
    product = p.filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 2 == 0).alias("inexact"))
    only = p.filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit("ingredient_only").alias("i"))
    rows = lines.join(generic, "l_partkey", "left").join(product, "l_partkey", "left").join(only, "l_partkey", "left")
    kept = F.when(F.col("inexact").isNotNull() & ~(F.col("dose") & F.col("inexact")), F.lit("product"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("g", kept, "i", F.lit("unmatched")).alias("mapping_status"))


@query("a18_normalisation_summary", """WITH s AS (SELECT l_orderkey, l_partkey, CASE WHEN p_size > 25 THEN 'matched' WHEN p_size > 10 THEN 'partial' ELSE 'unmatched' END AS st, p_size % 2 = 0 AS review FROM lineitem JOIN part ON p_partkey = l_partkey)
  SELECT l_orderkey, count(*) FILTER (st = 'matched') AS matched, count(*) FILTER (st = 'partial') AS partial, count(*) FILTER (st = 'unmatched') AS unmatched, bool_or(review) AS requires_review, count(DISTINCT l_partkey) AS slugs FROM s GROUP BY l_orderkey""")
def normalisation_summary(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("st", F.when(F.col("p_size") > 25, "matched").when(F.col("p_size") > 10, "partial").otherwise("unmatched"))
    return rows.groupBy("l_orderkey").agg(*(F.count_if(F.col("st") == s).alias(s) for s in ("matched", "partial", "unmatched")), F.bool_or(F.col("p_size") % 2 == 0).alias("requires_review"),
                                          F.size(F.collect_set("l_partkey")).cast("long").alias("slugs"))


@query("f10_excluded_names", "SELECT count(*) FILTER (p_type = 'ECONOMY') AS invalid, count(*) FILTER (p_name LIKE 'small%') AS excipients, count(*) FILTER (p_type <> 'ECONOMY' AND p_name NOT LIKE 'small%') AS kept FROM part")
def excluded_names(spark, sf):
    p = table(spark, sf, "part").select(X.normalize(F.col("p_type")).alias("t"), X.normalize(F.col("p_name")).alias("n"))
    invalid, excipient = F.col("t").isin("", "none", "null", "nan", "economy"), F.startswith("n", F.lit("small"))
    return p.agg(F.count_if(invalid).alias("invalid"), F.count_if(excipient).alias("excipients"), F.count_if(~invalid & ~excipient).alias("kept"))


@query("f12_confidence_band", "SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'low' WHEN length(p_name) > 12 OR p_size % 7 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM part")
def confidence_band(spark, sf):
    found = F.when(F.col("p_size") > 5, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    warned = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("unparsed_strength"))).otherwise(F.array(F.lit("other")))
    listed = F.array(F.lit("unparsed_strength"), F.lit("missing_strength_unit"))
    band = F.when(F.size(found) == 0, "low").when((F.length("p_name") > 12) | F.arrays_overlap(warned, listed), "medium").otherwise("high")
    return table(spark, sf, "part").select("p_partkey", band.alias("confidence"))


@query("f14_field_recode", """SELECT event_type, CASE event_type WHEN 'click' THEN 'than_trong' WHEN 'view' THEN 'chi_dinh' WHEN 'error' THEN 'chong_chi_dinh' END AS section, count(*) AS n FROM events GROUP BY 1, 2""")
def field_recode(spark, sf):
    to = spark.sql("SELECT * FROM VALUES ('click', 'than_trong'), ('view', 'chi_dinh'), ('error', 'chong_chi_dinh') AS t(event_type, section)")
    return table(spark, sf, "events").join(F.broadcast(to), "event_type", "left").groupBy("event_type", "section").agg(F.count("*").alias("n"))


@query("w6_adjacent_repair", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 25 AS dose, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
  s AS (SELECT *, (l_partkey % 3 <> 0) AND NOT dose AND coalesce(lead(l_partkey) OVER w % 3 = 0 AND lead(dose) OVER w, false) AS opens, l_partkey % 3 = 0 AND dose AND coalesce(lag(l_partkey) OVER w % 3 <> 0 AND NOT lag(dose) OVER w, false) AS eaten,
  lead(l_partkey) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)) SELECT l_orderkey, l_partkey, CASE WHEN opens THEN nxt END AS dose_from FROM s WHERE NOT eaten""")
def adjacent_repair(spark, sf):
    """A named item without a dose takes the dose of the nameless item after it, which goes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    named, dose = F.col("l_partkey") % 3 != 0, F.col("l_quantity") > 25
    at = lambda c, n: F.coalesce(F.lead(c, n).over(order), F.lit(False)) if n > 0 else F.coalesce(F.lag(c, -n).over(order), F.lit(False))
    rows = table(spark, sf, "lineitem").withColumns({"opens": named & ~dose & at(~named & dose, 1), "eaten": ~named & dose & at(named & ~dose, -1), "nxt": F.lead("l_partkey").over(order)})
    return rows.filter("not eaten").select("l_orderkey", "l_partkey", F.when(F.col("opens"), F.col("nxt")).alias("dose_from"))


@query("u3_set_tests", """WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey % 5 ORDER BY l_partkey % 5) AS a, list(DISTINCT l_suppkey % 5 ORDER BY l_suppkey % 5) AS b FROM lineitem GROUP BY 1)
  SELECT l_orderkey, a = b AS equal, len(list_intersect(a, b)) AS shared, len(list_intersect(a, b)) = len(a) AS subset FROM s""")
def set_tests(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 5)).alias("a"), F.array_sort(F.collect_set(F.col("l_suppkey") % 5)).alias("b"))
    return s.select("l_orderkey", (F.col("a") == F.col("b")).alias("equal"), F.size(F.array_intersect("a", "b")).alias("shared"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))
