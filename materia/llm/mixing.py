"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The rows of a source, in the order of a seeded hash of their ids, are cut into
blocks. With integer weights that sum to W, block k of a source of weight w is
released at slot floor(k*W/w) and due by slot ceil((k+1)*W/w); each slot goes
to the released block that is due first (of two due together, to the source of
the smaller name). In every prefix of the slots a source that still has blocks
is less than one block off its target share.

A block is the corpus' rows divided by ``BLOCKS``, one row at least, so the
schedule has about ``BLOCKS`` blocks whatever the data: it is made from the
sources' counts and weights alone, kept as one string of slots a source, and
looked up where the rows are. Weights are exact: integers as given, others to
60 bits.

No row is dropped or repeated. A source that runs out leaves its slots to the
others' windows: a slot for which no block is released is skipped.

Defined results: a null source is the source with the empty name; a null id is
ordered as an empty one; rows that repeat an id keep one place each, in any
order; an empty table gives no rows; columns of the input keep their names and
values, but for those named as a result column, which are replaced.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import struct
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from materia.llm.common import fresh, shared_table

#: Blocks of the whole corpus, about: the resolution of the mix, and the bound of the schedule.
BLOCKS = 1 << 18
#: Rows that one window task numbers, about.
ROWS_A_BUCKET = 4_000
#: Rows of one partition of ``in_order``, about, where the session's shuffle partitions would hold more.
ROWS_A_PARTITION = 200_000
#: Tempered shares are whole multiples of one in this.
PRECISION = 1024

ADDED = ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset"]


def integer_weights(shares: dict[str, float]) -> dict[str, int]:
    """Integers in the proportions of ``shares``: exact if they are integers or few binary digits, else to 60 bits."""
    if any(not (0 < v < math.inf) for v in shares.values()):
        raise ValueError("target shares are finite and positive")
    exact = {s: Fraction(v) for s, v in shares.items()}
    whole = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    found = {s: int(x * whole) for s, x in exact.items()}
    divisor = math.gcd(*found.values()) if found else 1
    found = {s: w // divisor for s, w in found.items()}
    total = sum(found.values())
    if total >= 1 << 60:
        found = {s: max(1, (w << 60) // total) for s, w in found.items()}
    return found


def schedule(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of all blocks: earliest deadline first among the released."""
    total = sum(weights.values())
    due: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    slot = 0
    while waiting or due:
        if not due:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(k + 1) * total // weights[s]), s, k))
        _, s, k = heapq.heappop(due)
        yield s, k, slot
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))


def _counts(docs: DataFrame, source_col: str) -> dict[str, int]:
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return {r["s"]: r["n"] for r in docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).collect()}


def tempered_shares(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> dict[str, int]:
    """Rows of each source to the power ``power``: large sources are held back, small ones lifted."""
    return {s: math.floor(n**power * PRECISION + 0.5) for s, n in _counts(docs, source_col).items()}


def mix(docs: DataFrame, shares: dict[str, float], id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with its source, block, release, deadline, slot and place in the block.

    Order by ``mix_slot, mix_offset``. A source without a share is an error: it
    would have to be dropped.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    counts = _counts(docs, source_col)
    rows = sum(counts.values())
    block_rows = block_rows or max(1, -(-rows // BLOCKS))
    if missing := sorted(set(counts) - set(shares)):
        raise ValueError(f"no target share for source {missing[0]!r}")
    weights = integer_weights(shares)
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in counts}
    for s, _, slot in schedule(weights, {s: -(-n // block_rows) for s, n in counts.items()}):
        slots[s].append(slot)
    table = [{"s": s, "w": weights[s], "at": base64.b64encode(struct.pack(f">{len(x)}q", *x)).decode()} for s, x in slots.items()]
    spark = docs.sparkSession
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<s string, w bigint, at string>>")))
    source, order, bucket, rank, before, weight, at, block = fresh(docs.select("*", *(F.lit(0).alias(c) for c in ADDED)), "source", "order", "bucket", "rank", "before", "weight", "at", "block")
    table = shared_table(table.select(F.col("s").alias(source), F.col("w").alias(weight), F.unbase64("at").alias(at)), "slots")

    # rank of a row in its source: its rank in the bucket, after the rows of the buckets before
    digits = max(1, math.ceil(math.log(max(1.0, rows / ROWS_A_BUCKET), 16)))
    placed = (
        docs.withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
        .withColumn(order, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")))
        .withColumn(bucket, F.substring(order, 1, digits))
    )
    sizes = placed.groupBy(source, bucket).agg(F.count("*").alias(before))
    so_far = F.sum(before).over(Window.partitionBy(source).orderBy(bucket))
    sizes = sizes.select(source, bucket, (so_far - F.col(before)).alias(before))
    in_bucket = Window.partitionBy(source, bucket).orderBy(order, id_col)
    ranked = placed.withColumn(rank, F.row_number().over(in_bucket) - 1).join(sizes, [source, bucket])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).join(F.broadcast(table), source)
    ranked = ranked.withColumn(block, F.expr(f"`{rank}` div {block_rows}"))
    k, w = f"cast(`{block}` as decimal(19, 0))", f"cast(`{weight}` as decimal(19, 0))"
    return ranked.select(
        *docs.columns, F.col(source).alias("mix_source"), F.col(block).alias("mix_block"),
        F.expr(f"({k} * {total}) div {w}").alias("mix_release"),
        F.expr(f"(({k} + 1) * {total} + {w} - 1) div {w}").alias("mix_deadline"),
        F.conv(F.hex(F.substring(F.col(at), F.col(block).cast("int") * 8 + 1, F.lit(8))), 16, 10).cast("long").alias("mix_slot"),
        F.expr(f"`{rank}` % {block_rows}").alias("mix_offset"),
    )


def in_order(docs: DataFrame, shares: dict[str, float], id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, seed: str = "mix") -> DataFrame:
    """The rows and columns of ``docs``, range-partitioned and sorted by their place in the schedule.

    Written as files, their names and the rows in them keep that order
    (``common.as_stored`` reads it back).
    """
    held = {c: n for c, n in zip(docs.columns, fresh(docs, *(f"held_{i}" for i in range(len(docs.columns)))), strict=True) if c.lower() in ADDED}
    placed = mix(docs.withColumnsRenamed(held), shares, held.get(id_col, id_col), held.get(source_col, source_col), block_rows, seed)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_A_PARTITION))
    ordered = placed.repartitionByRange(parts, "mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
    return ordered.select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))


#: The tempered mix of ``documents`` in SQL. The schedule is a recursion over the slots.
ORACLE = f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
size AS (SELECT greatest(1, CAST(ceil(sum(n) / {BLOCKS}) AS BIGINT)) AS block_rows FROM sizes),
raw AS (SELECT s, CAST(floor(sqrt(n) * {PRECISION} + 0.5) AS BIGINT) AS w, CAST(ceil(n / block_rows) AS BIGINT) AS b FROM sizes, size),
divisor AS (SELECT list_reduce(list(w), lambda x, y: gcd(x, y)) AS d FROM raw),
weights AS (SELECT s, CAST(w // d AS BIGINT) AS w, b FROM raw, divisor),
given AS (SELECT list(w ORDER BY s) AS ws, list(b ORDER BY s) AS bs, list(s ORDER BY s) AS names, CAST(sum(w) AS BIGINT) AS total FROM weights),
slots AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ws, lambda w: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM given
  UNION ALL
  SELECT now, list_transform(done, lambda d, i: d + (i = picked)::BIGINT), picked FROM (
    SELECT now, done, list_sort(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < bs[i] AND done[i] * total // ws[i] <= now),
      lambda i: {{'due': ((done[i] + 1) * total + ws[i] - 1) // ws[i], 'i': i}}))[1].i AS picked
    FROM (SELECT done, ws, bs, total, greatest(t + 1, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < bs[i]), lambda i: done[i] * total // ws[i]))) AS now
          FROM slots, given WHERE list_sum(done) < list_sum(bs)))
),
pattern AS (SELECT names[pick] AS s, ws[pick] AS w, total, done[pick] - 1 AS k, t FROM slots, given WHERE pick > 0),
ranks AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('mix:' || doc_id), doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, r // block_rows AS mix_block, r % block_rows AS mix_offset, k * total // w AS mix_release,
  ((k + 1) * total + w - 1) // w AS mix_deadline, t AS mix_slot FROM ranks, size, pattern WHERE pattern.s = ranks.s AND pattern.k = r // block_rows
"""
