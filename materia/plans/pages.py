"""Queries on pages (titles, events, sections, records) and on chunks of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from materia.functions import text as X
from materia.operators import chunking as C
from materia.operators import pages as P
from materia.operators.running import running
from materia.registry import query, table
from materia.sources.shared import small_batches


def parsed(spark, sf):
    return P.parsed(table(spark, sf, "pages"))


def _text_sql(tag: str) -> str:
    """The text of the first element of a tag: markup out, references decoded (their semicolon may be missing, ampersands last), white space squeezed."""
    x = f"regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1), '<[^>]*>', ' ', 'g')"
    for names, sign in (("lt|LT", "<"), ("gt|GT", ">"), ("quot|QUOT", '"'), ("amp|AMP", "&")):
        x = f"regexp_replace({x}, '&(?:{names});?', '{sign}', 'g')"
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


@query("t1_main_content", f"SELECT page_id, coalesce({_text_sql('h1')}, {_text_sql('title')}) AS title FROM pages")
def main_content(spark, sf):
    return parsed(spark, sf).select("page_id", "title")


@query("t2_page_events")
def page_events(spark, sf):
    return P.events(parsed(spark, sf)).filter("kind = 'text'").groupBy("page_id").agg(F.count("*").alias("texts"))


@query("t3_table_rows")
def table_rows(spark, sf):
    """Pages made of the tables that documents hold as lines of cells."""
    d = table(spark, sf, "documents")
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.transform(F.split(safe, "\n"), lambda r: F.concat(F.lit("<tr><td>"), F.array_join(F.split(r, r" \| "), "</td><td>"), F.lit("</td></tr>")))
    page = F.concat(F.lit("<article><h1>t</h1><table>"), F.array_join(row, ""), F.lit("</table></article>"))
    made = P.parsed(d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), page.alias("html")))
    return made.select("page_id", "table_rows", F.size("events").alias("rows_read"))


@query("t4_page_sections")
def page_sections(spark, sf):
    return P.sections(P.events(parsed(spark, sf))).select("page_id", "section", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("w7_adjacent_duplicates", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT doc_id, count(*) AS kept FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l) WHERE b IS DISTINCT FROM line GROUP BY doc_id""")
def adjacent_duplicates(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("b", before).filter(~F.col("b").eqNullSafe(F.col("line")) | F.col("b").isNull()).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("w8_forward_fill", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  f AS (SELECT doc_id, i, line, length(line) < 40 AS head, last_value(CASE WHEN length(line) < 40 THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS heading FROM l)
  SELECT doc_id, heading, count(*) AS lines, sum(length(line)) AS chars FROM f WHERE NOT head GROUP BY doc_id, heading""")
def forward_fill(spark, sf):
    """Short lines as headings over the lines that follow."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("i", F.col("pos") + 1)
    head = F.length("line") < 40
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"head": head, "heading": F.last(F.when(head, F.col("i")), ignorenulls=True).over(w)})
    return rows.filter("not head").groupBy("doc_id", "heading").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("f9_page_validity")
def page_validity(spark, sf):
    return P.records(table(spark, sf, "pages")).select("page_id", "signals", F.coalesce("reason", F.lit("valid")).alias("reason"))


@query("s13_page_records")
def page_records(spark, sf):
    """Records and failures, apart by the reason: together all pages."""
    return P.records(table(spark, sf, "pages")).groupBy(F.coalesce("reason", F.lit("record")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("title").isNotNull()).alias("titled"))


def document_sections(spark, sf):
    d = table(spark, sf, "documents")
    prefix = C.prefix(F.col("source"), F.col("source"), F.col("lang"), F.lit("documents"), F.concat(F.lit("https://example.org/"), "doc_id"))
    return d.select(F.concat_ws("-", "source", "doc_id").alias("slug"), F.col("lang").alias("section"), prefix.alias("prefix"), "text")


@query("t5_chunks")
def chunks(spark, sf):
    """All chunks, with the checks that hold for each: within the limit, prefixed, counted."""
    made = C.chunk(document_sections(spark, sf))
    return made.select("chunk_id", "slug", "chunk_index", "strategy", "char_count", F.md5(F.col("content").cast("binary")).alias("content_md5"),
                       ((F.col("char_count") <= 1800) & F.startswith("content", F.lit("Hoạt chất: "))).alias("valid"))


@query("t5_whole_sections", """SELECT count(*) FILTER (n <= 1800) AS whole, count(*) FILTER (n > 1800) AS cut FROM (SELECT length('Hoạt chất: ' || source || chr(10) || 'Slug: ' || source || chr(10) || 'Mục: ' || lang || chr(10) || 'Nguồn: documents' || chr(10)
  || 'URL: https://example.org/' || doc_id || chr(10) || chr(10) || 'Nội dung:' || chr(10)) + length(text) AS n FROM documents)""")
def whole_sections(spark, sf):
    s = document_sections(spark, sf).withColumn("fits", F.length("prefix") + F.length("text") <= 1800)
    return s.agg(F.count_if(F.col("fits")).alias("whole"), F.count_if(~F.col("fits")).alias("cut"))


@query("t6_evidence_schema", """SELECT 'longchau:ingredient:' || source || ':' || lang || ':' || CASE WHEN row_number() OVER w > 9999 THEN CAST(row_number() OVER w AS VARCHAR) ELSE lpad(CAST(row_number() OVER w AS VARCHAR), 4, '0') END AS chunk_id, 'Hoạt chất: ' || source || chr(10) AS head,
  length(text) AS text_chars FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def evidence_schema(spark, sf):
    """Source chunks to evidence rows: id with a running index, context, count. Ids are numbered, texts stay where they are read."""
    prefix = C.prefix(F.col("source"), F.col("source"), F.col("lang"), F.lit("documents"), F.lit("u"))
    full = F.concat(prefix, "text")
    made = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat(F.substring_index(full, "\n", 1), F.lit("\n")).alias("head"), (F.length(full) - F.length(prefix)).cast("long").alias("text_chars"))
    d = running(made, ["source", "lang"], ["doc_id"], i=("count", None))
    number = F.expr("lpad(string(i), greatest(4, length(string(i))), '0')")
    return d.select(F.concat_ws(":", F.lit("longchau:ingredient"), "source", "lang", number).alias("chunk_id"), "head", "text_chars")


@query("f4_short_sections", """SELECT doc_id, length(text) >= 80 OR lang IN ('de') AS kept_chunking, length(text) >= 10 OR lang IN ('de') AS kept_cleaning FROM documents""")
def short_sections(spark, sf):
    key = F.when(F.col("lang") == "de", "Chong_chi_dinh").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", C.keep_section(key, F.col("text"), 80).alias("kept_chunking"), C.keep_section(key, F.col("text"), 10).alias("kept_cleaning"))


@query("x11_table_repair")
def table_repair(spark, sf):
    """Each document's lines as the cells of rows that end as the one before; only eligible texts reach Python."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    long = d.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat_ws(" | ", s, s, F.substring(s, F.lit(2), F.length(s)), F.substring(s, F.lit(3), F.length(s)), F.substring(s, F.lit(4), F.length(s)), F.substring(s, F.lit(5), F.length(s)))), "\n").alias("t"))
    small_batches(spark)
    ratio = X.deflate_ratio_py("t")
    ready = long.withColumn("ratio", ratio).filter(C.repair_eligible(F.col("t"), F.col("ratio")))
    fixed = ready.withColumn("r", C.repair_rows(F.col("t")))
    return fixed.select("doc_id", F.length("t").alias("before"), F.length("r").alias("after"), (F.col("r") != F.col("t")).alias("repaired"))
