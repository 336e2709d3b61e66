"""The filter interaction audit against applying every order row by row."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from materia.llm import filter_audit as A


def brute(rows, filters, kinds):
    """rows: (part, set of failed filters, weights)."""
    out = {}
    for part in {r[0] or "" for r in rows}:
        own = [r for r in rows if (r[0] or "") == part]
        total = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                alone = sum(r[1] == {f} for r in own)
                out[part, "".join(order), step] = [f, len(kept), len(gone), redundant, alone, *(sum(r[2][k] or 0 for r in gone) for k in range(kinds))]
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row.append(total[row[0]])
    return out


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_against_every_order(spark, n):
    rng = random.Random(n)
    filters = list("PQRST"[:n])
    rows = [(rng.choice(["x", "y", None, ""]), {f for f in filters if rng.random() < 0.4}, (rng.choice([0, 1, None]), rng.randrange(3))) for _ in range(150)]
    df = spark.createDataFrame([(p, *(True if f in s else rng.choice([False, None]) for f in filters), *w) for p, s, w in rows], ", ".join(["part string", *(f"{f} boolean" for f in filters), "mask int, n long"]))
    found = A.audit(df, filters, ["mask", "n"])
    assert found.columns == ["part", "filter_order", "step", "filter", *A.COUNTS, "mask_lost", "n_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found.collect()}
    assert got == brute(rows, filters, 2)
    assert A.audit(df.limit(0), filters, []).count() == 0


def test_ranks_are_min_plus():
    ranks = A.Ranks(4)
    for mask in range(16):
        for o, order in enumerate(ranks.orders):
            wanted = min((step for step, f in enumerate(order, 1) if mask >> f & 1), default=5)
            assert ranks.rank[mask, o] == wanted
    huge = np.zeros((1, 1, 16), np.int64)
    huge[0, 0, 15] = 1 << 60  # beyond what doubles hold
    huge[0, 0, 1] = 1
    assert ranks.tables(huge)["lost"][0, 0, 0, 0] == (1 << 60) + 1
    with pytest.raises(ValueError):
        A.Ranks(A.MOST + 1)


def conditions(rows):
    out = []
    for i, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(i is not None and j is not None and j < i and (t or "") == text for j, t in rows)
        out.append((i, len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), smaller))
    return sorted(out, key=repr)


def test_flags_of_texts(spark):
    varied = " ".join(f"w{i}" for i in range(50))
    rows = [(1, varied), (2, varied), (2, varied), (None, varied), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (6, "a " * 60), (7, f"\x1c{varied}\x1c x y"), (8, "Aé" * 10), (9, "A" + "é" * 19),
            (10, "A" + "é" * 18), (11, varied + " |"), (12, "x\n" * 40_000 + varied), (13, "A a A a B"), *((20 + i, "hot copy") for i in range(60))]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "s", 1) for i, t in rows], "doc_id long, text string, source string, sha int").repartition(4)
    found = A.text_flags(docs).collect()
    assert sorted(((r["id"], r["A"], r["B"], r["C"], r["D"], r["E"]) for r in found), key=repr) == conditions(rows)
    assert {r["part"] for r in found} == {"s", ""}
    assert A.text_flags(docs.limit(0)).count() == 0


def test_marks(spark):
    flags = spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "id long")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, 0, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    found = A.with_marks(flags, labels, {"good": "quality", "bad": "toxic"}).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 1, 1), (2, 0, 0), (2, 0, 0), (None, 0, 0), (3, 0, 0)], key=repr)
