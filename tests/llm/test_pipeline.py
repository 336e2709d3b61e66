"""The pipeline against its stages by brute force, and the registry."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import pytest
from materia.llm import langid, queries
from materia.llm.packing import Encoder


def write_documents(spark, folder):
    rng = random.Random(9)
    words = {"de": "der die das und nicht über schön werden".split(), "en": "the and of which with then before after".split()}
    rows = []
    for i in range(240):
        lang = "de" if i % 3 else "en"
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.choice((5, 40, 300)))) + f" {lang}{rng.randrange(10**6)}", lang, f"s{i % 4}", 0))
    rows += [(1000 + i, rows[5][1], "de", "s1", 0) for i in range(30)] + [(2000, "1234 5678", None, "s0", 0), (2001, "本日は晴天", None, None, 0), (2002, None, None, "s9", 0), (2003, "der die das", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = write_documents(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rejected = {r["doc_id"] for r in langid.identify(docs, langid.fit(docs)).collect() if r["lang_rejected"]}
    assert {2000, 2001, 2002} <= rejected and len(rejected) < 8
    kept = {i: t for i, t, *_ in rows if i not in rejected}
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, i))
    from tests.llm.test_near_dedup import brute

    final, _ = brute([(i, t) for t, i in last.items()])
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == final
    encoder = Encoder(queries.byte_bpe())
    texts = dict((i, t) for t, i in last.items())
    for i in final:
        parts = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == encoder.encode(texts[i]) + b"\x01\0\0\0"


def test_stages_keep_the_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write_documents(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_mix_reaches_the_windows(spark, tmp_path):
    """The stored order of the mix, read back in any splits, is the order of the windows; stage folders are gone."""
    folder = f"file://{tmp_path}"
    rows = [(i, f"the and of which with then before {i} after " * (2 + i % 5), "en", "big" if i % 4 else "small", 0) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.mix_sources(spark, docs, folder).write.parquet(f"{folder}/mixed")
    from materia.llm import mixing

    order = {r["doc_id"]: (r["mix_slot"], r["mix_offset"]) for r in mixing.mix(docs, mixing.tempered_shares(docs)).collect()}
    rank = {i: k for k, i in enumerate(sorted(order, key=order.get))}
    pieces = corpus_pipeline.pack_windows(spark, spark.read.parquet(f"{folder}/mixed"), folder).collect()
    heads = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    # best fit moves a document by some windows, never far
    assert max(abs(rank[i] - k) for k, i in enumerate(heads)) < 250 and heads != sorted(heads)
    early = heads[:200]
    share = 600**0.5 / (600**0.5 + 200**0.5)
    assert abs(sum(i % 4 > 0 for i in early) / 200 - share) < 0.12


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = queries.queries()[name](spark, sf)
    wanted = con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == wanted


def test_registry():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names) and 4 <= len(corpus_pipeline.STAGES) <= 5
