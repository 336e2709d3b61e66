"""Landing of JSON lines and files: quarantine, strict mode, line numbers; guarded sinks and upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from materia.functions import text as X
from materia.sources.shared import file_system, shared_table


#: Blocks of files whose table of line counts is broadcast at most, about 200 bytes each; more meet their lines by a shuffle.
BROADCAST_BLOCKS = 200_000


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_number, line) of text files, several read as one; numbers start at 1 in each file.

    A line's number is its place in its block of the file and the lines of the blocks before: the blocks' lines are
    counted, and lines are neither sorted nor shuffled.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")
    )
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0)))
    small = blocks.count() <= BROADCAST_BLOCKS
    placed = lines.join(F.broadcast(blocks) if small else blocks, ["path", "block"])
    return placed.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).cast("long").alias("line_number"), "line")


def classify(line: Column, required: list[str]) -> Column:
    """(value variant, reason): invalid_json, invalid_schema for what is no object, missing_required_fields, or null."""
    value = F.try_parse_json(line)
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    missing = missing_fields(lambda n: F.try_variant_get(value, f"$.{n}", "string"), required)
    reason = F.when(value.isNull(), "invalid_json").when(~is_object, "invalid_schema").when(F.size(missing) > 0, "missing_required_fields")
    return F.struct(value.alias("value"), reason.alias("reason"), missing.alias("missing"))


def missing_fields(get: Callable[[str], Column], required: list[str]) -> Column:
    """Names of required fields that are null or empty."""
    return F.array_compact(F.array(*(F.when(F.coalesce(get(n), F.lit("")) == "", F.lit(n)) for n in required)))


def land(lines: DataFrame, required: list[str]) -> DataFrame:
    """Every line with its value, or the reason why it goes to quarantine."""
    return lines.withColumn("c", classify(F.col("line"), required)).select(*lines.columns, "c.value", "c.reason", "c.missing")


def strict(landed: DataFrame) -> DataFrame:
    """``landed``, or an error if a single row is bad; nothing is written before this is known."""
    bad = landed.filter(F.col("reason").isNotNull()).groupBy("reason").count().orderBy("reason").collect()
    if bad:
        raise ValueError("bad input rows: " + ", ".join(f"{r['reason']}: {r['count']}" for r in bad))
    return landed


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, category, stem) of every file below ``root``; the path supplies category and name."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    return files.select(path.alias("path"), F.col("value").alias("text"), F.try_element_at(parts, F.lit(-2)).alias("category"),
                        F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", "").alias("stem"))


def explode_items(files: DataFrame) -> DataFrame:
    """Items of one JSON array per file, numbered from 1."""
    items = files.select("path", F.from_json("text", "array<variant>").alias("a"))
    return items.select("path", F.posexplode("a").alias("i", "item")).select("path", (F.col("i") + 1).alias("item_number"), "item")


def first_with_files(spark: SparkSession, candidates: list[str]) -> str:
    """First of the folders that has files, by the file system of the path."""
    for path in candidates:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and len(fs.listStatus(p)):
            return path
    raise FileNotFoundError(f"no files in any of {candidates}")


def publish(df: DataFrame, path: str, overwrite: bool = False, kind: str = "json") -> None:
    """All or nothing: an existing path is only replaced if asked for, and then only once the new data is written whole.

    The new data is written beside the old and takes its place by two renames; a job that fails leaves the old as it
    was. A path that a crash between the renames left empty has its data at ``<path>.old-...``.
    """
    spark = df.sparkSession
    files, target = file_system(spark, path)
    if not overwrite or not files.exists(target):
        df.write.mode("errorifexists").format(kind).save(path)
        return
    mark = uuid.uuid4().hex
    fresh, gone = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    try:
        df.write.mode("errorifexists").format(kind).save(fresh)
    except BaseException:
        files.delete(file_system(spark, fresh)[1], True)
        raise
    if not files.rename(target, file_system(spark, gone)[1]):
        raise OSError(f"{path} can't be moved aside")
    if not files.rename(file_system(spark, fresh)[1], target):
        files.rename(file_system(spark, gone)[1], target)
        raise OSError(f"{fresh} can't be moved to {path}")
    files.delete(file_system(spark, gone)[1], True)


def report(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One row of counters beside the data."""
    publish(df.coalesce(1), path, overwrite)


def encode(df: DataFrame, text_col: str, make_encoder: Callable[[], object], vector_col: str = "vector", batch: int = 64) -> DataFrame:
    """``df`` with vectors by any object that has ``encode(texts)``; made once a task, called in batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(vector_col, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for frame in frames:
            texts = frame[text_col].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encoder.encode(texts[i : i + batch])]
            yield frame.assign(**{vector_col: [list(map(float, v)) for v in vectors]})

    return df.mapInPandas(run, schema)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``stored`` whose key isn't among them."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def load_vectors(rows: DataFrame, path: str, key: Column, text: Column, make_encoder: Callable[[], object], batch: int = 64, version: str = "1") -> DataFrame:
    """Points (point_id, the columns of ``rows``, text_hash, version, vector) stored at ``path``: only new and changed ones are encoded.

    The id is the UUIDv5 of the key, so a row loaded again takes its own place. Points whose hash of text and version is
    as stored keep their vector; the table is replaced as a whole by ``publish``, so readers see the old or the new one.
    Of rows with the same key the one with the largest hash stays; a null text is empty, a null key is no point.
    """
    spark = rows.sparkSession
    own = rows.withColumns({"point_id": X.uuid5(key), "_text": F.coalesce(text, F.lit(""))}).filter(key.isNotNull())
    own = own.withColumn("text_hash", F.sha2(F.concat_ws("\x00", F.lit(version), "_text"), 256)).withColumn("version", F.lit(version))
    first = own.groupBy("point_id").agg(F.max_by(F.struct(*own.columns), "text_hash").alias("p")).select("p.*")
    files, target = file_system(spark, path)
    if not files.exists(target):
        publish(encode(first, "_text", make_encoder, "vector", batch).drop("_text"), path, kind="parquet")
        return spark.read.parquet(path)
    stored = spark.read.parquet(path)
    same = stored.select("point_id", "text_hash")
    changed = shared_table(first.join(same, ["point_id", "text_hash"], "left_anti"), "changed")
    if not changed.isEmpty():
        made = upsert(stored, encode(changed, "_text", make_encoder, "vector", batch).drop("_text"), "point_id")
        publish(made.select(*stored.columns, *(c for c in made.columns if c not in stored.columns)), path, True, "parquet")
    return spark.read.parquet(path)
