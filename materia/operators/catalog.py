"""Ingredient catalog from evidence chunks: one row per slug, by two-level aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from materia.functions import text as X

# Names that are sections, not ingredients; wordings of article titles.
SECTION_NAMES = (
    "chi dinh", "chong chi dinh", "duoc luc hoc", "duoc dong hoc", "lieu luong va cach dung", "tuong tac thuoc", "than trong", "qua lieu va xu tri", "mo ta chung",
)
ARTICLE_WORDS = ("?", " là thuốc gì", " có tác dụng gì", " điều trị ", " dược thư ", " dùng cho ", " bà bầu ")


def field(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def with_identity(rows: DataFrame, slug: Column, chunk_id: Column, name: Column, title: Column, out: str = "identity") -> DataFrame:
    """``rows`` with a struct of slug, entity_name, source of the slug, warnings; slug null where a chunk has no identity.

    Slug: given, else from the chunk id, else from the name. Name: given, else a
    title that is short and no article's, else the words of the slug. Each step
    is a column of its own, so that none is evaluated for each use.
    """
    names = [c for c in rows.columns if c != out]
    key = lambda c: F.nullif(F.replace(X.normalize(c), F.lit(" "), F.lit("-")), F.lit(""))
    rows = rows.withColumns({"_given": key(slug), "_of_id": key(X.slug_of_chunk_id(chunk_id)), "_title": F.trim(title), "_plain": X.normalize(title), "_name": field(name)})
    article = F.col("_plain").rlike("|".join(w.replace("?", r"\?") for w in ARTICLE_WORDS))
    direct = (F.col("_plain") != "") & (F.length("_title") <= 120) & ~article
    rows = rows.withColumns({"_known": F.coalesce("_given", "_of_id"), "_named": F.coalesce("_name", F.when(direct, F.col("_title")))})
    rows = rows.withColumn("_entity", F.coalesce("_named", X.normalize(F.replace("_known", F.lit("-"), F.lit(" ")))))
    rows = rows.withColumns({"_own": F.nullif(X.slugify(F.col("_entity")), F.lit("")), "_tidy": F.nullif(X.slugify(F.col("_known")), F.lit("")), "_folded": X.fold(F.col("_entity"))})
    source = F.when(F.col("_given").isNotNull(), "explicit").when(F.col("_of_id").isNotNull(), "chunk_id").when(F.col("_own").isNotNull(), "entity_name")
    derived = F.when(F.col("_named").isNull() & F.col("_known").isNotNull(), F.lit("entity_name_derived_from_slug"))
    section = F.when(F.col("_folded").isin(*SECTION_NAMES), F.lit("entity_name_is_a_section"))
    final = F.coalesce("_tidy", "_known", "_own")
    made = F.struct(final.alias("slug"), F.when(final.isNotNull(), F.col("_entity")).alias("entity_name"), source.alias("slug_source"), F.array_compact(F.array(derived, section)).alias("warnings"))
    return rows.select(*names, made.alias(out))


def counts(chunks: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """Map from a value to its count, per key: counted first, gathered after."""
    counted = chunks.groupBy(key, *by).count()
    value = F.col(by[0]) if len(by) == 1 else F.concat_ws("/", *by)
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value.alias("k"), F.col("count"))))).alias(name))


def representative(chunks: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Most frequent value of each key; of equal ones the first seen."""
    counted = chunks.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"), F.min(seq).alias("_first"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value), F.count("*").alias(f"{value}_forms"))


def capped_sample(rows: DataFrame, key: str, value: str, seq: str, n: int = 5) -> DataFrame:
    """First ``n`` values of each key in input order."""
    w = Window.partitionBy(key).orderBy(seq)
    kept = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("v")))), lambda x: x.v).alias("sample"))


def in_first_seen_order(rows: DataFrame, key: str, values: str, seq: str) -> DataFrame:
    """Distinct items of an array column per key, in the order they are first met."""
    items = rows.select(key, seq, F.posexplode(values).alias("_p", "_v"))
    firsts = items.groupBy(key, "_v").agg(F.min(F.struct(F.col(seq).alias("s"), F.col("_p").alias("p"))).alias("_at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(values))


def build(chunks: DataFrame) -> DataFrame:
    """Catalog of ``chunks(seq, chunk_id, slug, entity_name, section, source, language, url)``."""
    base = chunks.groupBy("slug").agg(
        F.count("*").alias("chunk_count"), F.array_sort(F.collect_set("source")).alias("sources"), F.min_by("url", "seq").alias("url"),
        F.max_by("source", "seq").alias("last_source"), F.min("seq").alias("first_seq"),
    )
    out = base.join(representative(chunks, "slug", "entity_name", "seq"), "slug")
    out = out.join(representative(chunks, "slug", "language", "seq").drop("language_forms"), "slug")
    out = out.join(counts(chunks, "slug", ["section"], "section_counts"), "slug").join(counts(chunks, "slug", ["source"], "source_counts"), "slug")
    out = out.join(counts(chunks, "slug", ["source", "section"], "section_counts_by_source"), "slug").join(capped_sample(chunks, "slug", "chunk_id", "seq"), "slug")
    name = X.normalize(F.col("entity_name"))
    return out.select(
        F.concat(F.lit("ingredient:"), "slug").alias("catalog_id"), "slug", "entity_name", name.alias("normalized_name"),
        F.filter(F.array_distinct(F.array(name, X.strip_accents(name), F.replace("slug", F.lit("-"), F.lit(" ")), F.col("slug"))), lambda a: a != "").alias("aliases"),
        "sources", "source_counts", "section_counts", "section_counts_by_source", "url", F.col("sample").alias("sample_chunk_ids"), "chunk_count", "language",
        F.when(F.col("entity_name_forms") > 1, F.array(F.lit("multiple_entity_names_for_slug"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
