"""The prefix trie and tree contraction against plain recursion."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from materia.llm import conversations as C
from materia.llm.contraction import subtree_totals


def totals_of(nodes):
    kids = {}
    for n, p, *_ in nodes:
        kids.setdefault(p, []).append(n)
    own = {n: v for n, _, *v in nodes}
    done = {}
    for n, *_ in sorted(nodes, key=lambda r: -r[2]):
        done[n] = [sum(x) for x in zip(own[n], *(done[c] for c in kids.get(n, [])), strict=True)]
    return done


def contract(spark, nodes):
    df = spark.createDataFrame([(n, 7, p, None if p is None else 7, d, d, v) for n, p, d, v in nodes], "id long, k int, up long, uk int, level long, deep long, value long").repartition(4)
    found = subtree_totals(df, ["id", "k"], ["up", "uk"], "level", ["deep", "value"])
    assert found.columns == ["id", "k", "deep", "value"]
    return {r["id"]: [r["deep"], r["value"]] for r in found.collect()}


def test_contraction_of_a_chain_and_a_star(spark):
    chain = [(i, i - 1 if i else None, i, i * i) for i in range(70)]
    assert contract(spark, chain) == totals_of(chain)
    star = [(0, None, 0, 5), *((i, 0, 1, i) for i in range(1, 300))]
    assert contract(spark, star) == totals_of(star)


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_of_random_forests(spark, seed):
    """Bushy and stringy parts, several roots, a caterpillar (a chain with a leaf at each node)."""
    rng = random.Random(seed)
    nodes = [(0, None, 0, 1), (1, None, 0, -4)]
    for i in range(2, 250):
        p = nodes[-1] if rng.random() < 0.6 else rng.choice(nodes)
        nodes.append((i, p[0], p[2] + 1, rng.randrange(-50, 50)))
    for i in range(40):
        nodes += [(1000 + i, 999 + i if i else 1, i + 1, 1), (2000 + i, 1000 + i, i + 2, 2)]
    assert contract(spark, nodes) == totals_of(nodes)


def test_contraction_of_nothing_and_of_a_cycle(spark):
    assert contract(spark, []) == {}
    with pytest.raises(ValueError, match="cycle"):
        contract(spark, [(1, 2, 1, 1), (2, 1, 2, 1)])


def brute(rows, family=100, shared=6):
    from xxhash import xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = xxh64_intdigest((1).to_bytes(4, "little"), 42)
    marks = lambda r, t: tuple(signed(xxh64_intdigest(t.encode(), xxh64_intdigest(r.encode(), s))) for s in (42, one))
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, marks(role or "", text or ""), role or "", text or ""))
    listed = {c: [r[3:] for r in sorted(own)] for c, own in convs.items()}
    built = {}
    for c, own in listed.items():
        h = zlib.crc32(str(c).encode()) % shared
        built[c] = listed.get(c - c % family, [])[:h] + own[h:]
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Depth string, a string").repartition(6)
    return sorted(map(tuple, C.prefix_trie(*C.shared_beginnings(C.turns_in_order(df))).collect()), key=repr)


def test_trie_against_recursion(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 12345, 1_000_000, 1_000_003]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "é" * 7, "", None, "x y"]), "d", "a"))
    rows += [(50, t, "user", "go on" if t % 2 else f"step {t}", "d", "a") for t in range(60)]
    rows += [(c, 0, "user", "hello", "d", "a") for c in range(300, 380)]
    rows += [(400, 1, "user", "twice", "d", "a")] * 3 + [(None, 1, "user", "no one's", "d", "a"), (401, 0, None, "y" * 30_000, "d", "a")]
    assert trie(spark, rows) == brute(rows)


def test_trie_of_no_rows_and_of_no_turns(spark):
    assert trie(spark, []) == []
    alone = next(c for c in range(501, 599) if zlib.crc32(str(c).encode()) % 6)
    rows = [(alone, 0, "user", "lost", "d", "a")]
    assert trie(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_ids_of_one_end_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BITS", 2)
    ends = spark.range(0, 1000, 3).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("a"), F.lit(3).cast("long").alias("b"), F.col("id").alias("conv")).repartition(5)
    more = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 0, -5)], "depth long, a long, b long, conv long")
    found = {r["depth"]: r["ends_sha256"] for r in C._digests(ends.unionByName(more)).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, range(0, 1000, 3))).encode()).hexdigest(), 0: hashlib.sha256(b"-5,10").hexdigest()}
