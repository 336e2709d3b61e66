"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch of a Python stage. Texts can be long, so batches are
#: kept small: memory in a Python worker follows this many texts, not 10,000.
ARROW_ROWS = 256


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's own reader, so any file system it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows (hence the text bytes) of the Arrow batches that follow; a lower bound of the session stays.

    Plans read the setting when they run, so it can't be put back here; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or the checkpoint folder set on its context.

    Where neither is set, a session whose master is local (one machine, as in tests) gets one of its own; on a cluster
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="materia-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new to ``df``: temporary columns that can't clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own when the driver ends."""
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)


def delete_now(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own that nothing reads any more."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage: what follows survives the loss of any executor, and a
    costly scan is not repeated by each branch that uses it. The files go when
    the driver ends (the file system's delete-on-exit list).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/materia-{label}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``: the split into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def add_from_text(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[pa.Array]]], fields: str) -> DataFrame:
    """``docs`` with columns ``fields`` (a DDL string) that a Python model makes from a text column.

    ``make`` runs once in each task and returns the function from a batch of
    texts to the new columns. Other columns pass through as they are; those of
    ``docs`` that have the name of a new one give way.
    """
    small_batches(docs.sparkSession)
    added = T._parse_datatype_string(fields)
    names = {n.lower() for n in added.fieldNames()}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in names))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    schema = T.StructType([*docs.schema.fields, *added.fields])
    columns = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            new = model(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=columns)

    return docs.mapInArrow(run, schema)


def hash_share(column: str, salt: str, share) -> "Column":  # noqa: F821
    """True for about ``share`` of the ids, always the same ones."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 30)) < F.round(F.lit(share) * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold, limits: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """Labelled documents of the training folds, about ``limits[y]`` of each label at most.

    The sample bounds what a model is fitted on, at any size of the corpus; the
    share of each label is set from the counts of all labelled rows. It is
    written to the shared folder, so that fitting reads the corpus once.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fold)
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    keep = F.lit(False)
    for y, limit in limits.items():
        keep |= (F.col("_y") == y) & hash_share(id_col, label, min(1.0, limit / max(1, counts.get(y, 0))))
    # about sum(limits) ids, whatever the corpus: small enough to broadcast, so no text is shuffled
    return shared_table(docs.join(F.broadcast(known.filter(keep)), id_col), "sample")


def label_shares(labels: DataFrame, label: str, fold, id_col: str = "doc_id") -> dict[int, float]:
    """Share of each label among the labelled rows of the training folds."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fold)
    counts = {int(r["y"]): r["count"] for r in known.groupBy(F.col(label).alias("y")).count().collect()}
    return {y: n / sum(counts.values()) for y, n in counts.items()}


def with_group(rows: DataFrame, groups: DataFrame, keys: str | list[str], size: str, total: int, hot: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``groups``, which has each key at most once and its number of rows in ``size``.

    Groups of more than one in ``hot`` of ``total`` rows (so fewer than ``hot`` of them) are broadcast, the others meet
    their rows by a shuffle, so no group gathers in one task. Both tables are read twice: give stored ones.
    """
    keys = [keys] if isinstance(keys, str) else keys
    added = [c for c in groups.columns if c not in keys]
    is_hot = F.col(size) * hot > total
    near = rows.join(F.broadcast(groups.filter(is_hot)), keys, "left")
    far = near.filter(F.col(size).isNull()).drop(*added).join(groups.filter(~is_hot), keys, "left")
    return near.filter(F.col(size).isNotNull()).unionByName(far)
