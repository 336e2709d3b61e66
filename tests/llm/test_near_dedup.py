"""Near-duplicates of the pipeline against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from materia.llm import near_dedup, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """ids that stay, and the number of similar pairs"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs, ids = 0, sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in ids if find(i) == i}, pairs


def edited_texts():
    """Copies with a few words changed, of short and long texts, around one that many share; ids out of order."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "One  two", "a b c d e", "a b c d e f"]
    passage = rng.choices(words, k=30)
    for size, copies, most in ((12, 6, 1), (60, 8, 4), (300, 8, 16), (90, 60, 6)):
        for _ in range(4 if copies < 60 else 1):
            base = rng.choices(words, k=size)
            for _ in range(copies):
                new = list(base)
                for at in rng.choices(range(size), k=rng.randrange(most + 1)):
                    new[at] = rng.choice(words)
                texts.append(" ".join(new))
    texts += [" ".join(rng.choices(words, k=50) + passage) for _ in range(40)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("limit", [128, 5])
def test_stage_finds_all_edited_copies(spark, limit):
    rows = edited_texts()
    wanted, pairs = brute(rows)
    assert pairs > 100 and len(wanted) < len(rows) - 40
    docs = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    kept = [r["doc_id"] for r in near_dedup.one_of_each(docs, bucket_limit=limit).collect()]
    assert None in kept and {i for i in kept if i is not None} == wanted and len(kept) == len(wanted) + 1


def test_pipeline_stage_drops_a_copy_with_one_word_changed(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_bitmaps_never_part_similar_texts(spark):
    rows = [(i, t) for i, t in edited_texts() if t]
    sets = {i: shingles(t) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "node long, n int")
    made = near_dedup.parity_bitmaps(docs, "doc_id", "text", 5).join(sizes, "node")
    a, b = made.alias("a"), made.alias("b")
    near = a.join(b, (near_dedup.F.col("a.node") < near_dedup.F.col("b.node")) & near_dedup.not_too_different("a", "b", 0.8))
    left = {(r[0], r[1]) for r in near.select("a.node", "b.node").collect()}
    every = [(i, j) for i in sets for j in sets if i < j]
    similar = {(i, j) for i, j in every if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(similar) > 100 and similar <= left and len(left) < len(every) / 4


def test_golay_links_are_found_without_prefix_keys(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(20):
        base = rng.choices(words, k=800)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base).upper()), (10 * k + 2, " ".join([*base[:400], "other", *base[401:]]))]
    near = {(10 * k, 10 * k + j) for k in range(20) for j in (1, 2) if (simhash.fingerprint_of(rows[3 * k][1]) ^ simhash.fingerprint_of(rows[3 * k + j][1])).bit_count() <= 2}
    assert len(near) > 25
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = near_dedup.prefix_keys
    monkeypatch.setattr(near_dedup, "prefix_keys", lambda *a: made(*a).limit(0))
    assert near <= {(r["u"], r["v"]) for r in near_dedup.similar(docs).collect()}


def test_golay_pairs_are_compared_once(spark, monkeypatch):
    compared = []
    checked = near_dedup.verified

    def kept(pairs, *rest):
        compared.append({(r["u"], r["v"]) for r in pairs.collect()})
        return checked(pairs, *rest)

    monkeypatch.setattr(near_dedup, "verified", kept)
    docs = spark.createDataFrame([(i, "a b c d e f g h" + " " * i) for i in range(1, 7)] + [(7, "other words")], "doc_id long, text string")
    assert [r["doc_id"] for r in near_dedup.one_of_each(docs).orderBy("doc_id").collect()] == [1, 7]
    assert compared == [{(1, i) for i in range(2, 7)}, set()]
