"""Queries on scalar text functions, over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import evidence as E
from materia.registry import query, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("x1_normalize_text", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm FROM documents")
def normalize(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("norm"))


@query("x2_strip_accents", r"SELECT doc_id, md5(replace(strip_accents(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 'đ', 'd')) AS folded FROM documents")
def accents(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"))


@query("x3_casefold", r"SELECT doc_id, md5(trim(regexp_replace(replace(strip_accents(replace(lower(text), 'ß', 'ss')), 'đ', 'd'), '\s+', ' ', 'g'))) AS folded FROM documents")
def casefold(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.casefold_py(F.col("text")).cast("binary")).alias("folded"))


@query("x4_slugify", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("x5_slug_of_chunk_id", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE source END AS slug,
  'longchau:ingredient:' || source || ':' || lang || ':' || CASE WHEN doc_id > 9999 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END AS chunk_id FROM documents""")
def chunk_ids(spark, sf):
    made = X.chunk_id(F.lit("longchau"), F.col("source"), F.col("lang"), F.col("doc_id"))
    old = F.concat_ws(":", F.lit("trungtamthuoc"), "source", "lang", "doc_id")
    given = F.when(F.col("doc_id") % 3 == 0, made).when(F.col("doc_id") % 3 == 1, old).otherwise(F.concat(F.lit("other:"), old))
    return docs(spark, sf).select("doc_id", X.slug_of_chunk_id(given).alias("slug"), made.alias("chunk_id"))


@query("x6_slug_of_path", """SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' || (p_partkey + 1) END AS slug FROM part""")
def path_slugs(spark, sf):
    stem = F.replace("p_name", F.lit(" "), F.lit("-"))
    number = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") + 1)
    path = F.concat(F.lit("data/"), "p_brand", F.lit("/"), stem, F.lit("-"), number, F.lit(".json"))
    return table(spark, sf, "part").select("p_partkey", X.slug_of_path(path, F.col("p_partkey").cast("string")).alias("slug"))


@query("x7_preview", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300) AS preview FROM documents")
def previews(spark, sf):
    return docs(spark, sf).select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("x8_clean_unicode", r"""SELECT doc_id, md5(regexp_replace(nfc_normalize(t), '[\x{AD}\x{200B}-\x{200D}\x{FEFF}]', '', 'g')) AS cleaned,
  CASE WHEN doc_id % 2 = 0 THEN 'removed_soft_hyphen' ELSE 'removed_zero_width_chars' END AS actions
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(173) ELSE chr(8203) END || text AS t FROM documents)""")
def unicode_clean(spark, sf):
    """Every text is given one character that has to go."""
    dirty = docs(spark, sf).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "­").otherwise("​"), "text").alias("t"))
    return dirty.select("doc_id", F.md5(X.nfc_py(X.clean_unicode(F.col("t"))).cast("binary")).alias("cleaned"), F.array_join(X.unicode_actions(F.col("t")), ",").alias("actions"))


LINES_SQL = r"""lines AS (SELECT doc_id, i, trim(regexp_replace(line, '[\x{A0}\t ]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), kept AS (SELECT * FROM lines WHERE line <> '')"""


@query("x9_block_dedup", f"""WITH {LINES_SQL}, first AS (SELECT doc_id, line, min(i) AS i FROM kept GROUP BY doc_id, line),
  n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
  SELECT f.doc_id, md5(string_agg(line, chr(10) ORDER BY f.i)) AS cleaned, max(n) - count(*) AS duplicates FROM first f JOIN n USING (doc_id) GROUP BY f.doc_id""")
def block_dedup(spark, sf):
    found = docs(spark, sf).select("doc_id", X.dedup_blocks(F.col("text")).alias("b"))
    return found.select("doc_id", F.md5(F.col("b.text").cast("binary")).alias("cleaned"), F.col("b.duplicates").cast("long").alias("duplicates"))


@query("x10_repetition", f"""WITH {LINES_SQL}, long AS (SELECT doc_id, line, count(*) AS n FROM kept WHERE length(line) >= 20 GROUP BY doc_id, line)
  SELECT d.doc_id, coalesce(sum(n - 1), 0) AS repeated, coalesce(sum((n - 1) * length(line)), 0) AS repeated_chars FROM documents d LEFT JOIN long USING (doc_id) GROUP BY d.doc_id""")
def repetition(spark, sf):
    found = docs(spark, sf).select("doc_id", X.repeated_blocks(F.col("text"), 20).alias("r"))
    return found.select("doc_id", F.col("r.count").cast("long").alias("repeated"), F.col("r.chars").cast("long").alias("repeated_chars"))


@query("x10_deflate_ratio")
def deflate(spark, sf):
    """Texts of 10,000 characters or more that deflate to 15 % or less: repetition in the small."""
    found = docs(spark, sf).select("doc_id", F.length("text").alias("size"), X.deflate_ratio_py(F.col("text")).alias("ratio"))
    return found.select("doc_id", F.round("ratio", 6).alias("ratio"), ((F.col("size") >= 10_000) & (F.col("ratio") <= 0.15)).alias("repetitive"))


@query("x12_split_outside_parentheses", """SELECT p_partkey, p_name || ' (' || p_brand || ', ' || p_size || ')' AS first, p_type AS second, 2 AS parts FROM part""")
def split_parts(spark, sf):
    line = F.format_string("%s (%s, %d), %s;\n", "p_name", "p_brand", "p_size", "p_type")
    return table(spark, sf, "part").select("p_partkey", X.split_outside_parentheses(line).alias("p")).select(
        "p_partkey", F.col("p")[0].alias("first"), F.col("p")[1].alias("second"), F.size("p").alias("parts"))


@query("x13_parse_strength", """SELECT p_partkey, p_size + 0.5 AS value, CASE p_partkey % 3 WHEN 0 THEN 'mg' WHEN 1 THEN 'ml' END AS unit,
  CASE WHEN p_partkey % 3 = 2 THEN 'missing_strength_unit' ELSE '' END AS warnings FROM part""")
def strengths(spark, sf):
    unit = F.when(F.col("p_partkey") % 3 == 0, " MG").when(F.col("p_partkey") % 3 == 1, "ml w/v").otherwise("")
    found = table(spark, sf, "part").select("p_partkey", X.parse_strength(F.concat(F.col("p_size").cast("string"), F.lit(",5"), unit)).alias("s"))
    return found.select("p_partkey", "s.value", "s.unit", F.array_join("s.warnings", ",").alias("warnings"))


@query("x15_salt_stripped", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' hydrochloride,' || p_name WHEN 2 THEN p_name ELSE '' END AS names FROM part""")
def salts(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Natri "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" hydrochloride monohydrate"))).when(k == 2, F.concat("p_name", F.lit(" HCl"))).otherwise("natri clorid")
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.salt_stripped(name), ",").alias("names"))


@query("x16_stereo_prefix", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS bare FROM part")
def stereo(spark, sf):
    prefix = F.when(F.col("p_partkey") % 4 == 0, "DL-").when(F.col("p_partkey") % 4 == 2, "l- ").otherwise("")
    return table(spark, sf, "part").select("p_partkey", X.stereo_stripped(F.concat(prefix, "p_name")).alias("bare"))


@query("x17_hashes", "SELECT doc_id, sha256('passage: ' || text) AS text_hash, sha1(left(text, 200)) AS prefix_hash FROM documents")
def hashes(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(F.concat(F.lit("passage: "), "text"), 256).alias("text_hash"), F.sha1(F.substring("text", 1, 200).cast("binary")).alias("prefix_hash"))


@query("x17_uuid5")
def point_ids(spark, sf):
    return docs(spark, sf).select("doc_id", X.uuid5(F.concat_ws(":", "source", "lang", "doc_id")).alias("point_id"))


@query("x18_aliases", """SELECT p_partkey, CASE WHEN len(w) = 2 AND w[1] NOT IN ('gel') THEN p_name || ',' || w[1] ELSE p_name END AS aliases
  FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)""")
def alias_lists(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.aliases(F.concat("p_name", F.lit(" (box of "), "p_size", F.lit(")"))), ",").alias("aliases"))


@query("x20_normalize_url", r"""SELECT page_id, 'https://' || lower(regexp_extract(url, '//([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '//[^/?#]+([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS url,
  regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '([^/]+)$', 1) AS slug FROM pages""")
def urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"), X.slug_of_url(F.col("url")).alias("slug"))


@query("x21_heading_key", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chong_chi_dinh' WHEN 1 THEN 'chi_dinh' WHEN 2 THEN 'lieu_luong_va_cach_dung' ELSE replace(p_name, ' ', '_') END AS section FROM part""")
def headings(spark, sf):
    k = F.col("p_partkey") % 4
    head = F.when(k == 0, "3.1) Chống chỉ định:").when(k == 1, "Chỉ định").when(k == 2, "Cách dùng").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.heading_key(head).alias("section"))


@query("x22_updated_at", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS updated_at FROM orders""")
def dates(spark, sf):
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Ngày cập nhật : ").otherwise("Ngày: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" bởi"))
    return table(spark, sf, "orders").select("o_orderkey", X.updated_at(line).alias("updated_at"))


@query("x23_suffix_chain", "SELECT p_partkey, p_partkey % 2 = 0 AS chain FROM part")
def chains(spark, sf):
    even = F.concat_ws(" | ", F.concat_ws(" ", F.lit("a"), F.lit("b"), "p_name", "p_brand"), F.concat_ws(" ", F.lit("b"), "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_brand"), "p_brand")
    odd = F.concat_ws(" | ", "p_name", "p_brand", "p_type", "p_size")
    return table(spark, sf, "part").select("p_partkey", X.suffix_chain(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)).alias("chain"))


# The wordings that decide the type of a question, first rule first.
QUESTION_RULES = (
    ("contraindication", ("chống chỉ định", "không dùng", "cấm dùng", "không được dùng")),
    ("interaction", ("tương tác", "dùng chung", "phối hợp", "uống chung")),
    ("pregnancy_lactation", ("mang thai", "bà bầu", "thai kỳ", "cho con bú", "đang cho bú")),
    ("adverse_effect", ("tác dụng phụ", "adr", "phản ứng", "quá mẫn", "dị ứng", "sốc phản vệ")),
    ("renal_hepatic", ("suy thận", "suy gan", "child-pugh", "egfr")),
    ("overdose", ("quá liều", "ngộ độc", "xử trí quá liều", "giải độc")),
    ("dose", ("liều", "cách dùng", "uống bao nhiêu", "dùng bao nhiêu")),
)


@query("x24_query_type", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'adr') THEN 'adverse_effect' WHEN contains(lower(text), 'egfr') THEN 'renal_hepatic' ELSE 'general' END AS query_type FROM conversations")
def question_types(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.first_rule(F.lower("text"), QUESTION_RULES, "general").alias("query_type"))


@query("x28_unsafe_wording", r"""SELECT conv_id, turn, regexp_matches(t, '\b(stop\s+taking|discontinue|switch\s+to)\b') AS unsafe FROM
  (SELECT conv_id, turn, strip_accents(lower(text)) || CASE WHEN conv_id % 5 = 0 THEN ' discontinue' ELSE '' END AS t FROM conversations)""")
def unsafe(spark, sf):
    t = F.concat("text", F.when(F.col("conv_id") % 5 == 0, " Discontinue").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.unsafe_wording(t).alias("unsafe"))


@query("x29_display_title", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE CASE WHEN length(t) <= 72 THEN t ELSE rtrim(left(t, 69)) || '...' END END AS title
  FROM (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def titles(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("Ghi chú riêng")
    generic = X.fold(given).isin("", "ghi chu don thuoc", "ghi chu rieng", "doctor note")
    return docs(spark, sf).select("doc_id", F.when(~generic, given).otherwise(X.shorten(F.col("text"))).alias("title"))


@query("x30_safe_casts", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, json_extract_string(props, '$.missing') AS missing,
  json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_number FROM events""")
def casts(spark, sf):
    v = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "long"), F.lit(0).cast("long")).alias("k"), F.try_variant_get("v", "$.missing", "string").alias("missing"),
                    F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.k", "variant")) == "BIGINT", F.lit(False)).alias("is_number"))


@query("x31_egfr", "SELECT o_orderkey, CAST(o_custkey % 90 + 0.5 AS DOUBLE) AS egfr, o_custkey % 90 < 30 AS below_30 FROM orders")
def egfr(spark, sf):
    said = F.concat(F.lit("Suy thận, eGFR "), (F.col("o_custkey") % 90).cast("string"), F.lit(",5 ml/ph"))
    return table(spark, sf, "orders").select("o_orderkey", X.egfr(said).alias("egfr"), X.egfr_below(said).alias("below_30"))
