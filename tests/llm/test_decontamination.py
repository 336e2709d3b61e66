"""Benchmark decontamination against a plain scan of all windows."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from materia.llm import decontamination as D
from materia.llm.queries import op11_decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        spans = [(i, min(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((doc, len(w), len(hit), spans, sorted(found, key=str.encode), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("Spots", F.lit(1)).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    rows = D.contamination(d, i, **kw).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"], r["contaminated"]) for r in rows), key=repr)


def test_words():
    text = "It's 3x ÉCOLE-été_Ünïon\x00\x7fİstanbul 東京"
    assert [w.decode() for w in D.words_of(text)] == words(text) == ["it", "s", "3x", "École", "été", "Ünïon", "İstanbul", "東京"]
    assert D.words_of(None) == D.words_of("!? \n") == []


def test_against_all_windows(spark):
    rng = random.Random(3)
    pick = lambda n, k=12: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    items = [(1, "One two, three FOUR five six seven eight nine ten eleven twelve"), (2, "tiny item"), (3, "solo"), (None, "null id item"), (4, None), (5, "!!"), (2, "other text of item two"), (6, pick(40, 3)), (7, "x " * 30), (8, pick(14))]
    docs = [(None, items[0][1]), (1, None), (2, ""), (3, "before one-two three four five six seven eight nine ten / after"), (4, "Tiny, item. tiny ITEM tiny"), (4, "Tiny, item. tiny ITEM tiny"),
            (5, "two three four five six seven eight nine ten eleven twelve and null id item"), (6, "solo"), (7, "x " * 100), (8, "y " * 20_000 + items[0][1] + " z" * 20_000),
            (9, "one two three four five six seven eight nine"), *((100 + i, pick(60, 3)) for i in range(30)), *((200 + i, items[-1][1] + " " + pick(5)) for i in range(30))]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, size=4) == brute(docs, items, 4)


def test_either_way_of_the_join_and_a_crowded_bitmap(spark, monkeypatch):
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, pick(12)) for i in range(40)]
    docs = [(i, f"{pick(4)} {rng.choice(items)[1]} {pick(4)}" if i % 3 else "the hot passage " + items[0][1]) for i in range(120)]
    for name, value in (("BROADCAST_WINDOWS", 0), ("BROADCAST_MEMBERS", 0), ("LEAST_BITS", 1 << 15), ("BITS_A_TOKEN", 0)):
        monkeypatch.setattr(D, name, value)
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [(1, "a b c")], []) == [(1, 3, 0, [], [], False)]
    assert found(spark, [], [(1, "a b c")]) == []


def test_rarest_token_is_the_prefix(spark):
    """The common token of an item is never a place: only the rare one is looked up."""
    docs = spark.createDataFrame([(i, "common words here " * 20 + ("common words here and one rare thing" if i == 7 else "")) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common words here and one rare thing")], "item_id long, text string")
    every, hits, _ = D.find_windows(docs, items)
    assert every.count() == 30 and hits.count() == 1
    counts = {r["n_hit"] for r in D.contamination(docs, items).collect()}
    assert counts == {0, 7}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    said = con.sql(D.ORACLE)
    rows = op11_decontamination(spark, f"/root/testdata/{sf}").select(said.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(said.fetchall())
