"""Packing and mixing: invariants, round trips, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from materia.llm import mixing, packing
from materia.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(byte_bpe())


@pytest.fixture(scope="module")
def plain():
    """The tokenizer file as it is."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "<|", "|>", "\n", "é", "endoftext", "1"]), max_size=9).map("".join)))
def test_ids_are_the_tokenizers(encoder, plain, text):
    wanted = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == wanted


def test_ids_of_documents(encoder, plain, spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert np.frombuffer(encoder.encode(r["text"]), "<u4").tolist() == plain.encode(r["text"], add_special_tokens=False).ids


def check(pieces, window=2048):
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
    for parts in by_window.values():
        end = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert 0 < end <= window
    return by_doc, by_window


def test_pack_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs.repartition(7, "doc_id"), byte_bpe()).collect()
    by_doc, by_window = check(pieces)
    for r in docs.collect():
        parts = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist()
        assert ids == [*plain.encode(r["text"], add_special_tokens=False).ids, 1]
        assert all(p["doc_tokens"] == len(ids) for p in parts)
    used = sum(p["length"] for p in pieces)
    assert used / (2048 * len(by_window)) > 0.97


def brute_pack(sizes, window, limit, least):
    """(document, start, length, number of the window, offset) before leftovers are merged, by the stated rules."""
    opened, done, count = [], [], 0
    for doc, total in enumerate(sizes):
        start = 0
        while start < total:
            rest = total - start
            fits = [w for w in opened if window - sum(n for *_, n in w[1]) >= rest]
            if rest >= window:
                done.append((count, [(doc, start, window)]))
                count, start = count + 1, start + window
            elif fits or len(opened) < limit:
                if fits:
                    home = max(fits, key=lambda w: (sum(n for *_, n in w[1]), -w[0]))
                else:
                    home = (count, [])
                    count += 1
                    opened.append(home)
                home[1].append((doc, start, rest))
                start = total
                if sum(n for *_, n in home[1]) == window:
                    opened.remove(home)
                    done.append(home)
            else:
                full = max(opened, key=lambda w: (sum(n for *_, n in w[1]), -w[0]))
                free = window - sum(n for *_, n in full[1])
                if free >= least and rest - free >= least:
                    full[1].append((doc, start, free))
                    start += free
                opened.remove(full)
                done.append(full)
    return done, opened


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 4), st.integers(1, 6))
def test_placing_against_brute_force(sizes, limit, least):
    part = packing._Partition(0, 32, limit, least)
    for doc, n in enumerate(sizes):
        part.add(doc, memoryview(bytes(4 * n)))
    emitted, opened = brute_pack(sizes, 32, limit, least)
    wanted = {(d, a, n, w, sum(x for *_, x in row[:i])) for w, row in emitted for i, (d, a, n) in enumerate(row)}
    assert {(d, a, n, w, o) for d, a, n, _, _, w, o, _ in part.rows} == wanted
    assert [(w, [(d, a, n) for d, a, n, *_ in pieces]) for _, w, pieces in part.open] == opened


def test_small_windows(spark):
    """A window shorter than the least piece: everything still lies in exactly one piece."""
    df = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    pieces = packing.pack(df, byte_bpe(), window=8).collect()
    by_doc, _ = check(pieces, 8)
    assert all(sum(p["length"] for p in parts) == parts[0]["doc_tokens"] for parts in by_doc.values()) and len(by_doc) == 40


def test_stored_order(spark, tmp_path):
    """A mix written and read in other splits is packed in the order of its schedule."""
    df = spark.createDataFrame([(i, "a b c " * (1 + i % 9), "big" if i % 3 else "small") for i in range(3000)], "doc_id long, text string, source string")
    shares = {"big": 1, "small": 1}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        mixing.in_order(df, shares).write.parquet(f"file://{tmp_path}/mixed")
        stored = spark.read.parquet(f"file://{tmp_path}/mixed")
        wanted = [r["doc_id"] for r in mixing.in_order(df, shares).collect()]
        assert [r["doc_id"] for r in packing.in_stored_order(stored).collect()] == wanted
        pieces = packing.pack(packing.in_stored_order(stored), byte_bpe(), window=64).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # while both sources last, any prefix of the windows holds nearly equal parts of both
    ordered = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))][:1500]
    for n in range(100, 1500, 100):
        assert abs(sum(i % 3 == 0 for i in ordered[:n]) - n / 2) < 0.1 * n + 32
    assert packing.in_stored_order(df).count() == 3000


def test_pack_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 30_000), (3, "word " * 30_000), (4, "日本語 " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    pieces = packing.pack(df, byte_bpe(), window=256).collect()
    by_doc, _ = check(pieces, 256)
    assert [p["length"] for p in by_doc[1]] == [1] and [p["doc_tokens"] for p in by_doc[2]] == [1]
    assert sum(p["length"] for p in by_doc[3]) == 2 * by_doc[3][0]["doc_tokens"] and len(by_doc[None]) == 1
    assert packing.pack(df.limit(0), byte_bpe()).count() == 0


def check_fair(weights, blocks):
    """Windows are kept, and no prefix is one block off the shares of the sources that go on."""
    total, placed = sum(weights.values()), {s: [] for s in weights}
    last = -1
    for s, k, slot in mixing.schedule(weights, blocks):
        assert slot > last and k == len(placed[s])
        last = slot
        placed[s].append(slot)
    for s, w in weights.items():
        assert len(placed[s]) == blocks[s]
        for k, slot in enumerate(placed[s]):
            assert k * total // w <= slot < -(-(k + 1) * total // w)
            # the most behind is before a block is placed, the most ahead after it
            assert slot * w < (k + 1) * total and (slot + 1) * w > k * total
    return placed


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.tuples(st.integers(1, 60), st.integers(0, 80)), min_size=1, max_size=9))
def test_schedule_is_fair(given):
    check_fair({s: w for s, (w, _) in given.items()}, {s: b for s, (_, b) in given.items()})


def test_a_million_slots_stay_near_the_true_shares():
    shares = {"a": 1e6**0.5, "b": 3e6**0.5, "c": 77e3**0.5, "d": 500**0.5, "e": 1e-2}
    whole = sum(shares.values())
    placed = check_fair(mixing.integer_weights(shares), {s: round(1e6 * v / whole) for s, v in shares.items()})
    assert max(p[-1] for p in placed.values() if p) >= 999_000
    for s, slots in placed.items():
        t, k, share = np.array(slots), np.arange(len(slots)), shares[s] / whole
        assert (share * t - k < 1).all() and ((k + 1) - share * (t + 1) < 1).all()


def test_integer_weights():
    assert mixing.integer_weights({"a": 1, "b": 2, "c": 0.5}) == {"a": 2, "b": 4, "c": 1} and mixing.integer_weights({}) == {}
    third = mixing.integer_weights({"a": 1 / 3, "b": 1e-12})
    assert abs(third["b"] / third["a"] / 3e-12 - 1) < 1e-6
    for bad in ({"a": -1.0}, {"a": 0.0}, {"a": float("nan")}):
        with pytest.raises(ValueError, match="shares"):
            mixing.integer_weights(bad)


def brute_mix(rows, weights, block_rows, seed="mix"):
    """Slot by slot: the released block that is due first."""
    import hashlib

    total, own, slot, taken = sum(weights.values()), {}, {}, {}
    for s in weights:
        own[s] = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i, x in rows if (x or "") == s)
    blocks, taken, t = {s: -(-len(x) // block_rows) for s, x in own.items()}, dict.fromkeys(own, 0), 0
    while any(taken[s] < blocks[s] for s in own):
        ready = [(-(-(taken[s] + 1) * total // w), s) for s, w in weights.items() if taken[s] < blocks[s] and taken[s] * total // w <= t]
        if ready:
            s = min(ready)[1]
            slot[s, taken[s]] = t
            taken[s] += 1
        t += 1
    return {i: (r // block_rows, slot[s, r // block_rows], r % block_rows) for s in own for r, (_, i) in enumerate(own[s])}


def test_mix_against_brute_force(spark):
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    names = [*mixing.ADDED, "order", "bucket", "rank", "before", "weight", "at", "block", "s", "w", "_slot", "_order"]
    for n in names:
        df = df.withColumn(n.upper(), F.lit(n))
    shares = {"big": 5.0, "small": 2.0, "": 3.0}
    found = mixing.mix(df, shares, block_rows=8)
    wanted = brute_mix(rows, mixing.integer_weights(shares), 8)
    assert {r["doc_id"]: (r["mix_block"], r["mix_slot"], r["mix_offset"]) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    ordered = mixing.in_order(df, shares, block_rows=8)
    assert ordered.columns == df.columns and all(r["MIX_SLOT"] == "mix_slot" and r["RANK"] == "rank" for r in ordered.collect())
    assert [r["doc_id"] for r in ordered.collect()] == sorted(wanted, key=lambda i: wanted[i][1:])
    assert mixing.mix(df.limit(0), {}).count() == 0
    with pytest.raises(ValueError, match="no target share"):
        mixing.mix(df, {"big": 1.0})


def test_mix_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, source string")
    found = mixing.mix(df, mixing.tempered_shares(df)).collect()
    assert sorted(r["mix_block"] for r in found if r["source"]) == [0, 1, 2, 3] and len({r["mix_slot"] for r in found}) == 5


def test_tempered(spark):
    df = spark.createDataFrame([(i, "a" if i else None) for i in range(5)], "doc_id long, source string")
    assert mixing.tempered_shares(df) == {"a": 2048, "": 1024}
