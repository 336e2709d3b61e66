"""Running totals over stretches against plain loops."""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import functions as F

from materia.operators.running import running


def brute(rows):
    by = {}
    for g, o, v in rows:
        by.setdefault(g, []).append((o, v))
    out = []
    for g, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sums, xors, tops = accumulate(v for _, v in own), accumulate((v for _, v in own), lambda a, b: a ^ b), accumulate((v for _, v in own), max)
        out += [(g, o, v, i, s, x, m) for i, ((o, v), s, x, m) in enumerate(zip(own, sums, xors, tops, strict=True), 1)]
    return sorted(out, key=repr)


def test_running_against_loops(spark):
    """One group with half of all rows (over many stretches), small ones, a null one, null and tied orders."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "zz"]), rng.choice([None, *range(40)]), rng.randrange(1000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, piece int, v long").repartition(9)
    v = F.col("v")
    found = running(df, ["g"], [F.col("piece").asc_nulls_first(), "v"], idx=("count", None), s=("sum", v), x=("xor", v), m=("max", v))
    assert found.columns == ["g", "piece", "v", "idx", "s", "x", "m"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_running_without_groups_and_rows(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("n")).repartition(7)
    found = running(df, [], ["n"], s=("sum", F.col("n"))).orderBy("n").collect()
    assert [r["s"] for r in found] == list(accumulate(range(100)))
    assert running(df.limit(0), ["n"], ["n"], i=("count", None)).count() == 0


def test_running_null_values(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, None), (4, 1)], "o int, v long").repartition(4)
    found = running(df, [], ["o"], s=("sum", F.col("v")), n=("count", F.col("v"))).orderBy("o").collect()
    assert [(r["s"], r["n"]) for r in found] == [(None, 0), (3, 1), (3, 1), (4, 2)]
