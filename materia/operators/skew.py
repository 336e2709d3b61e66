"""Joins whose large side has hot keys, or whose sides no estimate measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes, about.
ROWS_A_SALT = 50_000
#: Rows that one task gets where the parts follow the table, about.
ROWS_A_TASK = 250_000


def unbounded(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: sorted and merged, never broadcast.

    Before a query runs, Spark goes by the size of the compressed files, and takes a table of some MB for a small one whose
    rows, exploded or not, fill the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *on: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df``, of about ``rows`` rows, by columns into as many parts as keep the rows of one task bounded.

    The session's number of parts is fixed, so the maps and sorts of a task would grow with the table.
    """
    return df.repartition(max(1, math.ceil(rows / rows_a_task)), *on)


def salted_join(few: DataFrame, many: DataFrame, on: str, by: str, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """``few`` joined with ``many`` on a column, the rows of hot keys of ``many`` spread over salts by the column ``by``.

    Keys of ``many`` with more than ``rows_a_salt`` rows (so at most one in that many rows is such a key) are counted
    first and broadcast; their rows in ``few`` are repeated, one a salt. Every pair is made once. Null keys meet nothing.
    """
    salt, salts = (f"_{'_' * sum(c.startswith('_') for c in [*few.columns, *many.columns])}{n}" for n in ("salt", "salts"))
    hot = many.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(salts)).filter(F.col(salts) > rows_a_salt)
    hot = F.broadcast(hot.select(on, F.ceil(F.col(salts) / rows_a_salt).cast("int").alias(salts)))
    parts = F.coalesce(salts, F.lit(1))
    spread = many.join(hot, on, "left").withColumn(salt, F.pmod(F.xxhash64(by), parts).cast("int")).drop(salts)
    repeated = few.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop(salts)
    return repeated.join(spread, [on, salt]).drop(salt)


def hashed(values: list[str], arrays: list[str]) -> dict[str, Column]:
    """Two hashes ``_a`` and ``_b`` that stand for columns, ``arrays`` among them; hashes skip nulls, so where those are is hashed beside."""
    given = [*values, *arrays, *(F.transform(c, lambda x: x.isNotNull()) for c in arrays), *map(F.isnull, arrays)]
    return {"_a": F.xxhash64(*given), "_b": F.xxhash64(F.lit(1), *given)}
