"""Tables in the folder that all executors share: they cut lineage, and what follows survives lost executors. Bounds of Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder set on its context.

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


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/materia-{label}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    files, target = file_system(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch that holds whole texts or pages: what a Python worker holds follows them, not 10,000 rows.
TEXT_ROWS = 128


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the rows of the Arrow batches that follow; a lower bound of the session stays.

    Plans read the setting when they run, so it can't be put back here; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))
