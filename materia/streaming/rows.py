"""Row-local jobs on a stream. They hold no state, so the batch functions run unchanged.

Landing, parsing and classifying a message needs no other row; a stream of JSON
lines or messages goes through the same columns as a batch does and is written
with the sink's own exactly-once commit log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from materia.operators import messages
from materia.sources import landing


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they arrive in ``folder``."""
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def landed(lines: DataFrame, required: list[str]) -> DataFrame:
    """Value or quarantine reason of each line, as in a batch; the value as JSON text, which every sink takes."""
    return landing.land(lines, required).select("line", F.to_json("value").alias("value"), "reason")


def classified(rows: DataFrame, message: str) -> DataFrame:
    """Intent, topic and mentions of each message, as in a batch."""
    return messages.classify(rows, message)


def write(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to Parquet files in ``folder``; run again, it goes on where it stopped."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
