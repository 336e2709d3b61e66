"""Filter interaction audit: what every order of a few filters removes, by removal ranks in min-plus algebra.

A row fails some of the filters: its mask. With ``cost[mask, filter]`` zero where
the mask holds the filter and infinite elsewhere, and ``place[filter, order]``
the inverse permutations (the step at which an order applies the filter), the
min-plus product ``rank[mask, order] = min over filters of cost + place`` is the
step that removes such rows, infinite where none does. The ranks and the masks'
weights give everything else: a weight goes to the cell (order, rank) of its
mask, and rows that fail the filter of a later step are redundant there.

Spark counts rows by part and mask, partially before the shuffle, so a part of
any size is at most ``2 ** filters`` rows when it meets the matrices, which
handle the parts a batch at a time. Orders are all permutations: meant for a
handful of filters (``MOST`` at most).

Defined results: a null part is the part with the empty name; a null flag is no
failure and a null weight zero; an empty table gives no rows; rows that repeat
count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from materia.llm.common import shared_table, with_group

#: Filters that one audit takes: their orders are all enumerated.
MOST = 7
COUNTS = ["kept", "removed", "redundant", "unique_fails"]
BLANKS = "\t\n\x0b\x0c\r "


class Ranks:
    """The matrices of ``n`` filters; rows are masks (bit f: filter f fails), columns orders."""

    def __init__(self, n: int) -> None:
        if not 0 < n <= MOST:
            raise ValueError(f"1 to {MOST} filters")
        self.n = n
        self.orders = np.array(list(permutations(range(n))), np.int64)
        never = n + 1
        self.failing = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
        cost = np.where(self.failing, 0, never)
        place = np.argsort(self.orders, axis=1).T + 1
        self.rank = np.minimum((cost[:, :, None] + place[None, :, :]).min(axis=1), never)

    def tables(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Totals by (part, order, step) from ``weights[kind, part, mask]``, kind 0 the rows themselves.

        ``lost``: of each kind, what the step removes; ``kept`` and the rest count rows.
        """
        kinds, parts, _ = weights.shape
        each = np.arange(len(self.orders))
        lost = np.zeros((kinds, parts, len(self.orders), self.n + 2), np.int64)
        redundant = np.zeros((parts, len(self.orders), self.n), np.int64)
        steps = np.arange(1, self.n + 1)
        for mask, rank in enumerate(self.rank):
            lost[:, :, each, rank] += weights[:, :, mask, None]
            late = self.failing[mask][self.orders] & (rank[:, None] < steps)
            redundant += weights[0, :, mask, None, None] * late
        lost = lost[..., 1 : self.n + 1]
        kept = weights[0].sum(axis=1)[:, None, None] - np.cumsum(lost[0], axis=2)
        alone = weights[0][:, 1 << np.arange(self.n)]
        by_filter = np.zeros((parts, self.n), np.int64)
        for f in range(self.n):
            by_filter[:, f] = (lost[0] * (self.orders == f)).sum(axis=(1, 2))
        return {"lost": lost, "kept": kept, "redundant": redundant, "unique_fails": alone[:, self.orders], "shapley": by_filter[:, self.orders]}


def audit(rows: DataFrame, filters: list[str], weights: list[str], part_col: str = "part") -> DataFrame:
    """One row for each part, order of the filters and step.

    ``filters`` are boolean columns, true for rows that fail; ``weights`` integer columns. Columns: part, filter_order
    (the names one after another), step, filter, kept, removed, redundant, unique_fails, one ``<weight>_lost`` a weight, shapley.
    """
    ranks = Ranks(len(filters))
    mask = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    kinds = ["n", *(f"w{k}" for k in range(len(weights)))]
    narrow = rows.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *(F.coalesce(F.col(w), F.lit(0)).cast("long").alias(f"w{k}") for k, w in enumerate(weights)))
    totals = narrow.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(w).alias(w) for w in kinds[1:]))
    parts = totals.groupBy("part").agg(F.collect_list(F.struct("mask", *kinds)).alias("cells"))
    n_orders = math.factorial(len(filters))
    names = ["".join(filters[f] for f in order) for order in ranks.orders]
    lost = [f"{w}_lost" for w in weights]
    longs = [*COUNTS, *lost, "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            filled = np.zeros((len(kinds), batch.num_rows, 1 << len(filters)), np.int64)
            for p, cells in enumerate(batch.column(1).to_pylist()):
                for cell in cells:
                    filled[:, p, cell["mask"]] = [cell[k] for k in kinds]
            found = ranks.tables(filled)
            columns = {"kept": found["kept"], "removed": found["lost"][0], "redundant": found["redundant"], "unique_fails": found["unique_fails"], "shapley": found["shapley"]}
            columns |= dict(zip(lost, found["lost"][1:], strict=True))
            each = n_orders * len(filters)
            steps = np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), batch.num_rows * n_orders)
            order = np.tile(np.repeat(np.arange(n_orders), len(filters)), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), each))), pa.array(names).take(pa.array(order)), pa.array(steps),
                 pa.array(filters).take(pa.array(np.tile(ranks.orders.ravel(), batch.num_rows))), *(pa.array(columns[c].reshape(-1)) for c in longs)],
                names=["part", "filter_order", "step", "filter", *longs],
            )

    return parts.mapInArrow(run, ", ".join(["part string, filter_order string, step int, filter string", *(f"{c} long" for c in longs)]))


def _words(text: Column) -> Column:
    """Maximal runs of characters other than blanks, as an array (empty for none)."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def text_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E): the five conditions on whole texts, true where a text fails.

    A: under 50 words; B: under 65 distinct words in a hundred; C: over 5 capital letters A-Z in a hundred code points;
    D: holds a character of ``#$%&*|``; E: the same text as a document of a smaller id. A null text is empty; a null id is
    neither smaller nor larger than another.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.select("id", "part", "text", _words(F.col("text")).alias("words"))
    judged = read.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), (F.size("words") < 50).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 5 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    judged = shared_table(judged, "flags")
    groups = judged.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    met = with_group(judged, shared_table(groups, "copies"), "sha", "size", judged.count())
    return met.select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))


def with_marks(flags: DataFrame, labels: DataFrame, marks: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """``flags`` with a 0/1 column for each of ``marks`` (name: label column): any label row of the id is 1."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for n, c in marks.items()))
    joined = flags.join(known, F.col("id") == F.col("labelled"), "left").drop("labelled")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in marks})


ORACLE = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
    coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY x), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id),
masks AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [a, b, c, d, e][i]) AS failing, count(*) AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
ranks AS (SELECT *, coalesce(list_min(list_transform(failing, lambda f: strpos(filter_order, f))), 99) AS rank FROM masks, orders),
cells AS (SELECT part, filter_order, step, filter_order[step] AS f,
    sum(n) FILTER (WHERE rank > step) AS kept, sum(n) FILTER (WHERE rank = step) AS removed,
    sum(n) FILTER (WHERE list_contains(failing, filter_order[step]) AND rank < step) AS redundant,
    sum(n) FILTER (WHERE failing = [filter_order[step]]) AS unique_fails,
    sum(good) FILTER (WHERE rank = step) AS good_lost, sum(toxic) FILTER (WHERE rank = step) AS toxic_lost
  FROM ranks, range(1, 6) AS steps(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM cells
"""
