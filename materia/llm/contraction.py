"""Subtree totals of a forest by parallel tree contraction, in join rounds.

A round rakes every leaf: its total is settled and goes to its parent. It also
compresses chains: of a node with one child left, that is not a leaf, the child
takes the place, and carries what the node had collected as an offset towards
the next parent. A node is taken out if a bit of its level is one and that of
its child zero, so no two neighbours go together; as the round's bit rises, the
rounds halve a chain of consecutive levels each time. After about as many rounds
as the depth has bits (and as branches lie on a path, once chains are gone) no
node is left. Then the rounds are undone, last one first: the total of a node
taken out is what it had collected and the total of the child that took its place.

Every round is a few joins on node keys, each key once on both sides but for
sums over a parent's children, which are added up before the shuffle: nodes
with very many children are no hot spot. Rounds end in tables of the shared
folder, which shrink geometrically, so neither plans nor lineage grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from materia.llm.common import shared_table

ACTIVE, RAKED, COMPRESSED = 0, 1, 2


def subtree_totals(nodes: DataFrame, key: list[str], parent: list[str], level: str, values: list[str]) -> DataFrame:
    """``key`` and, under the names of ``values``, their sums over the node and all nodes below it.

    ``nodes`` has each key once; a root's ``parent`` columns are null. ``level`` is a whole number from 0 that differs
    between a node and every node below it (a depth does). Values are longs. A cycle raises ``ValueError``; a node whose
    parent isn't a node is a root. An empty table gives no rows.
    """
    k, p, c = ([f"{x}{i}" for i in range(len(key))] for x in "kpc")
    v, off = [f"v{i}" for i in range(len(values))], [f"off{i}" for i in range(len(values))]
    start = nodes.select(*(F.col(a).alias(b) for a, b in zip([*key, *parent], [*k, *p], strict=True)), F.col(level).cast("long").alias("level"),
                         *(F.col(a).cast("long").alias(b) for a, b in zip(values, v, strict=True)), *(F.lit(0).cast("long").alias(o) for o in off))
    kids = start.filter(F.col(p[0]).isNotNull()).groupBy(p).agg(F.count("*").alias("kids")).withColumnsRenamed(dict(zip(p, k, strict=True)))
    state = shared_table(start.join(kids, k, "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "status": F.lit(ACTIVE)}), "round")
    bits = max(1, (state.agg(F.max("level")).first()[0] or 0).bit_length())

    rounds, left = [], state.count()
    while left:
        state = shared_table(_round(state.filter(F.col("status") == ACTIVE), k, p, c, v, off, len(rounds), bits), "round")
        counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
        if not counts.get(RAKED):
            raise ValueError("the nodes have a cycle")
        rounds.append((state, counts))
        left = counts.get(ACTIVE, 0)

    known: list[DataFrame] = []
    for state, counts in reversed(rounds):
        found = [state.filter(F.col("status") == RAKED).select(*k, *v)]
        if counts.get(COMPRESSED):
            later = reduce(DataFrame.unionByName, known).withColumnsRenamed(dict(zip([*k, *v], [*c, *off], strict=True)))
            gone = state.filter(F.col("status") == COMPRESSED).drop(*off)
            found.append(shared_table(gone.join(later, c).select(*k, *((F.col(a) + F.col(b)).alias(a) for a, b in zip(v, off, strict=True))), "undone"))
        known += found
    if not known:
        return nodes.select(*key, *(F.col(x).cast("long").alias(x) for x in values))
    return reduce(DataFrame.unionByName, known).toDF(*key, *values)


def _round(active: DataFrame, k: list[str], p: list[str], c: list[str], v: list[str], off: list[str], number: int, bits: int) -> DataFrame:
    """One rake and one compress of the active nodes; all of them come out, with their new status.

    A leaf's ``v`` are its totals. A compressed node's ``v`` are what its own total has besides the total of the node ``c``.
    """
    leaf = F.col("kids") == 0
    bit, set_first = number % bits, (number // bits) % 2 == 0
    mark = lambda level: F.shiftright(level, bit).bitwiseAND(1) == (1 if set_first else 0)
    raked = [F.sum(F.when(leaf, F.col(a) + F.col(o)).otherwise(0)).alias(f"_{a}") for a, o in zip(v, off, strict=True)]
    child = F.struct(*k, "level", *off)
    below = active.filter(F.col(p[0]).isNotNull()).groupBy(p).agg(F.count_if(~leaf).alias("_kids"), F.max(F.when(~leaf, child)).alias("_child"), *raked)
    below = below.withColumnsRenamed(dict(zip(p, k, strict=True)))
    met = active.join(below, k, "left")
    taken = ~leaf & (F.col("_kids") == 1) & F.col(p[0]).isNotNull() & mark(F.col("level")) & ~mark(F.col("_child.level"))
    met = met.withColumn("status", F.when(leaf, RAKED).when(taken, COMPRESSED).otherwise(ACTIVE))
    out = F.col("status") == COMPRESSED
    met = met.select(
        *k, *p, "level", F.coalesce("_kids", F.lit(0)).alias("kids"), "status", *(F.when(out, F.col(f"_child.{a}")).alias(b) for a, b in zip(k, c, strict=True)),
        *((F.col(a) + F.coalesce(f"_{a}", F.lit(0)) + F.when(out, F.col(f"_child.{o}")).otherwise(0)).alias(a) for a, o in zip(v, off, strict=True)), *off,
    )
    # the child takes the node's place: its parent, and towards it what the node had collected
    moves = met.filter(out).select(*(F.col(a).alias(b) for a, b in zip(c, k, strict=True)), *(F.col(a).alias(f"_{a}") for a in p), *((F.col(a) + F.col(o)).alias(f"_{o}") for a, o in zip(v, off, strict=True)))
    moved = met.join(moves, k, "left")
    has = F.col(f"_{p[0]}").isNotNull()
    return moved.withColumns({n: F.when(has, F.col(f"_{n}")).otherwise(F.col(n)) for n in [*p, *off]}).drop(*(f"_{n}" for n in [*p, *off]))
