"""Exact dedup, SimHash and its keys, against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from materia.llm import exact_dedup, simhash


def brute_components(marks: dict[int, int]) -> dict[int, int]:
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(marks[a] ^ marks[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_exact_edge_cases(spark):
    rows = [(1, "a", "x"), (5, "a", "y"), (2, None, "x"), (9, "", None), (None, "a", "x"), (5, "a", "y"), (7, "é" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    found = exact_dedup.find_repeats(df).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["keep_id"] for r in by[1] + by[5] + by[None]} == {5} and by[1][0]["group_size"] == 4
    assert sorted(r["kept"] for r in by[5]) == [False, True] and not by[1][0]["kept"] and not by[None][0]["kept"]
    assert by[2][0]["keep_id"] == by[9][0]["keep_id"] == 9 and by[7][0]["kept"] and by[7][0]["group_size"] == 1
    assert exact_dedup.find_repeats(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in exact_dedup.drop_repeats(df).collect()} == {5, 9, 7}


def test_exact_by_either_way_of_the_filter(spark, monkeypatch):
    """A shuffled filter, hot and cold groups, counters that run over: always what grouping the texts gives."""
    rows = [(i, f"t{i % 700}") for i in range(2000)] + [(5000 + i, "hot") for i in range(900)] + [(9000 + i % 2, "same") for i in range(60)] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    for size in (0, exact_dedup.FILTER_BYTES):
        for hot in (1, 1000):
            monkeypatch.setattr(exact_dedup, "HOT", hot)
            found = exact_dedup.find_repeats(df, filter_bytes=size).collect()
            assert len(found) == len(rows)
            for r in found:
                own = groups[r["text"] or ""]
                assert (-1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) == (max(own), len(own))
            kept = [r for r in found if r["kept"]]
            assert sorted(r["text"] or "" for r in kept) == sorted(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_filter_loses_no_repeat_and_rejects_most(spark):
    texts = spark.range(20_000).select(F.concat(F.lit("t"), F.when(F.col("id") < 18_000, F.col("id")).otherwise(F.col("id") % 1000).cast("string")).alias("content"))
    bloom = {r["word"]: r["bits"] for r in exact_dedup.repeated_filter(texts, 20_000).collect()}
    placed = texts.select("content", exact_dedup._word(F.col("content"), 20_000).alias("w"), exact_dedup._counter(F.col("content")).alias("c")).collect()
    passed = [r["content"] for r in placed if bloom.get(r["w"], 0) >> r["c"] & 1]
    repeated = {f"t{i}" for i in range(1000)}
    assert repeated <= set(passed) and len(passed) - 3000 < 0.15 * 17_000


def test_exact_with_clashing_names(spark):
    names = [*exact_dedup.ADDED, "sha", "word", "bits", "again", "most", "size", "copies", "part", "first", "second", "top", "content", "_word"]
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    for n in names:
        df = df.withColumn(n.upper(), F.lit(n))
    found = exact_dedup.find_repeats(df)
    assert sorted((r["doc_id"], r["kept"]) for r in found.collect()) == [(1, False), (2, False), (2, True), (3, True)]
    kept = exact_dedup.drop_repeats(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert all(r[n.upper()] == n for r in kept.collect() for n in names)


def test_no_shuffle_has_a_text(spark):
    """Where the text isn't asked for, a filter too large to be broadcast meets hashes, not texts."""
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string")
    found = exact_dedup.find_repeats(df, filter_bytes=0).select("doc_id", "keep_id", "text_sha256")
    assert sorted(r["keep_id"] for r in found.collect()) == sorted(max(j for j in range(50) if j % 7 == i % 7) for i in range(50))

    def joins(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        return [n for b in below for n in joins(b)] + ([b.output().toString() for b in below] if node.nodeName() == "Join" else [])

    inputs = joins(found._jdf.queryExecution().optimizedPlan())
    assert inputs and not any("text#" in x for x in inputs)


def test_exact_runs_no_python(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    plan = exact_dedup.find_repeats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprint():
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \t\n") == 0
    from xxhash import xxh64_intdigest

    assert simhash.fingerprint_of("One  TWO") == xxh64_intdigest(b"one two", 42)
    words = [f"w{i}" for i in range(5)]
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    wanted = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 3)
    assert simhash.fingerprint_of("w0 w1\nw2\tw3 w4") == wanted
    assert simhash.fingerprint_of("É A") != simhash.fingerprint_of("é a") == simhash.fingerprint_of("é A")


def test_golay_code():
    code = simhash.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 12, 500)
    data = words << 11
    sent = data | code.parity[words]
    for _ in range(20):
        errors = np.zeros(500, np.int64)
        for _ in range(3):
            errors |= 1 << rng.integers(0, 23, 500)
        assert (code.index(sent ^ errors) == words).all()
    near = code.near_indices(rng.integers(0, 1 << 23, 2000))
    assert set((near >= 0).sum(axis=1)) <= {1, 6}


def test_golay_keys_lose_no_link(spark):
    """Every pair two bits apart shares a key."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.choice((1, 2))):
            b ^= 1 << k
        rows += [(2 * i, a), (2 * i + 1, b)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = simhash.bucket_keys(spark.createDataFrame([(i, signed(x)) for i, x in rows], "node long, fp long")).collect()
    by = {}
    for r in keys:
        by.setdefault(r["node"], set()).add(r["key"])
    assert all(by[2 * i] & by[2 * i + 1] for i in range(300))


def test_near_duplicates_by_both_ways(spark, monkeypatch):
    """Pairs compared in small buckets, and neighbours listed for large ones, give the brute-force components."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.choice((0, 1, 2, 30, 400)))
        docs.append((len(docs), " ".join(words)))
        if i % 3 == 0:
            for _ in range(3):
                changed = list(words)
                if changed:
                    changed[rng.randrange(len(changed))] = "changed"
                docs.append((len(docs), " ".join(changed)))
    docs += [(None, "null id"), (1000, None), (1001, ""), (1002, docs[3][1]), (1002, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = brute_components({i: simhash.fingerprint_of(t) for i, t in docs if i is not None})
    for limit in (128, 1):
        found = simhash.near_duplicates(df, bucket_limit=limit).collect()
        assert len(found) == len(docs)
        assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == wanted
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.one_of_each(df)
    assert {r["doc_id"] for r in kept.collect()} == {None, *(i for i, c in wanted.items() if i == c)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}
