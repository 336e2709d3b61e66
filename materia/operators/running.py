"""Running totals and exact ranks whose groups are spread over many tasks.

Rows are range-partitioned by group and order, so each partition holds a stretch
of the whole order; totals within a stretch are a window over (stretch, group),
and what lies before a stretch is a total of the few groups that several
stretches share. No task holds a whole group, however large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from materia.sources.shared import shared_table

#: By kind: the total of rows, the total of totals, and two totals put together.
KINDS = {
    "count": (lambda c: F.count(F.lit(1) if c is None else c), F.sum, lambda x, y: x + y),
    "sum": (F.sum, F.sum, lambda x, y: x + y),
    "max": (F.max, F.max, F.greatest),
    "xor": (F.bit_xor, F.bit_xor, lambda x, y: x.bitwiseXOR(y)),
}


def _new(taken: list[str], *names: str) -> list[str]:
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def _sort_key(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(rows: DataFrame, group: list[str], order: list[Column | str], **made: tuple[str, Column | None]) -> DataFrame:
    """``rows`` with one column for each of ``made``: the total of a kind (``KINDS``) over the rows of the group up to this one.

    ``idx=("count", None)`` numbers the rows of a group from 1. Rows that are equal in ``order`` get their places in any
    order, so for a settled result they should be equal in what is totalled too. Null group keys are a group of their own;
    without ``group`` all rows are one. An empty table gives no rows. The rows go through two shuffles and the shared
    folder: give it narrow ones, and join wide columns afterwards.
    """
    piece, first = _new([*rows.columns, *made], "piece", "first")
    earlier = dict(zip(made, _new([*rows.columns, *made, piece, first], *(f"before_{n}" for n in made)), strict=True))
    keys = [F.col(g).asc_nulls_first() for g in group]
    held = shared_table(rows.repartitionByRange(*keys, *map(_sort_key, order)).withColumn(piece, F.spark_partition_id()), "stretches")
    within = Window.partitionBy(piece, *group).orderBy(*map(_sort_key, order)).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumns({n: KINDS[kind][0](c).over(within) for n, (kind, c) in made.items()})

    # a group lies in several stretches at the two ends of a stretch only: at most two rows a stretch are left here
    sizes = held.groupBy(piece, *group).agg(*(KINDS[kind][0](c).alias(earlier[n]) for n, (kind, c) in made.items()))
    in_front = Window.partitionBy(*group).orderBy(piece)
    sizes = sizes.withColumn(first, F.min(piece).over(Window.partitionBy(*group)))
    before = {earlier[n]: KINDS[kind][1](earlier[n]).over(in_front.rowsBetween(Window.unboundedPreceding, -1)) for n, (kind, _) in made.items()}
    sizes = sizes.withColumns(before).filter(F.col(piece) > F.col(first)).drop(first)
    names = _new([*local.columns, *earlier.values()], piece, *group)
    sizes = F.broadcast(sizes.withColumnsRenamed(dict(zip([piece, *group], names, strict=True))))
    same = reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip([piece, *group], names, strict=True)))
    joined = local.join(sizes, same, "left")
    whole = {n: F.when(F.col(earlier[n]).isNull(), F.col(n)).otherwise(F.when(F.col(n).isNull(), F.col(earlier[n])).otherwise(KINDS[kind][2](F.col(n), F.col(earlier[n])))) for n, (kind, _) in made.items()}
    return joined.withColumns(whole).select(*rows.columns, *made)
