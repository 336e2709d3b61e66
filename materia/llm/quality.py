"""Quality classification with a factorisation machine.

Inputs are hashed words, structure statistics (cut into ranges) and the length
metadata of a text. Besides a weight, each input has a short vector, and pairs
of inputs interact by the product of theirs; the sum over all pairs is half the
difference of the square of the sum and the sum of the squares, so a text is
scored in time linear in its inputs.

The model is fitted on at most about ``SAMPLE`` labelled texts of each class;
only their inputs reach the driver.

Defined results: null and empty texts have the statistics of an empty text and
a score like others; with no labelled text, or one class only, the score is
the share of label 1 (0.5 if there is none); repeated rows get the same
result; an empty table gives no rows; columns of the input keep their names
and values, unless named as a result column.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from materia.llm.common import add_from_text, labelled_sample

SAMPLE = 4000
WORD_DIMS = 1 << 14
RANGES = 8
RANK = 8

STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "symbols", "pipes", "punctuation",
    "lines", "line_length", "repeated_lines", "two_byte", "shortest_cycle",
)


def describe(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics; places and values of the hashed words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = text.split("\n")
    letters = max(1, int(byte[65:91].sum() + byte[97:123].sum()))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)  # noqa: B905
    stats = np.array([
        np.log1p(len(raw)), np.log1p(len(words)), len(text) / n, len(counts) / n, max(counts.values(), default=0) / n,
        byte[65:91].sum() / letters, byte[48:58].sum() / size, byte[[35, 36, 37, 38, 42, 64, 94, 126]].sum() / size, byte[124] / size,
        byte[[33, 44, 46, 58, 59, 63]].sum() / size, np.log1p(len(lines)), np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines), byte[192:].sum() / size, pairs,
    ])
    places: dict[int, float] = {}
    for word, c in counts.items():
        k = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIMS
        places[k] = places.get(k, 0.0) + c
    at = np.fromiter(places, np.int64, len(places))
    value = np.log1p(np.fromiter(places.values(), np.float64, len(places)))
    return stats, at, value / max(1e-12, float(np.linalg.norm(value)))


@dataclass
class Machine:
    edges: np.ndarray  # (statistics, RANGES - 1)
    bias: float
    weight: np.ndarray
    vector: np.ndarray  # (inputs, RANK)

    def inputs(self, stats: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.array([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, stats, strict=True)])
        ranges = WORD_DIMS + np.arange(len(STATISTICS)) * RANGES + of
        return np.concatenate([at, ranges]), np.concatenate([value, np.full(len(ranges), 0.5)])

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores before the logistic: bias, linear part, and pairs by the sum of squares."""
        starts = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
        at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
        vx = self.vector[at] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.weight[at] * x, starts) + 0.5 * (sums**2 - squares).sum(axis=1)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 8, rate: float = 0.1, penalty: float = 1e-4) -> Machine:
    """Logistic loss, one row at a time, with steps scaled by past gradients; classes weigh alike."""
    size = WORD_DIMS + len(STATISTICS) * RANGES
    rng = np.random.default_rng(7)
    share = float(y.mean()) if len(y) else 0.5
    stats = np.array([s for s, _, _ in rows]) if len(rows) else np.zeros((1, len(STATISTICS)))
    edges = np.quantile(stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    m = Machine(edges, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if not len(y) or not 0 < share < 1:
        m.vector[:] = 0
        return m
    m.bias = 0.0
    ready = [m.inputs(*r) for r in rows]
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(rounds):
        for i in rng.permutation(len(ready)):
            at, x = ready[i]
            v = m.vector[at]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            z = m.bias + m.weight[at] @ x + 0.5 * float(total @ total - (vx * vx).sum())
            d = cost[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i])
            g = d * x + penalty * m.weight[at]
            gw[at] += g * g
            m.weight[at] -= rate * g / np.sqrt(gw[at])
            g = d * x[:, None] * (total - vx) + penalty * v
            gv[at] += g * g
            m.vector[at] = v - rate * g / np.sqrt(gv[at])
            gb += d * d
            m.bias -= rate * d / gb**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, fold, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    def make():
        def run(texts):
            found = [describe(t) for t in texts]
            kinds = ("<f8", "<u2", "<f4")
            return [pa.array([c.astype(kind).tobytes() for c in column], pa.binary()) for column, kind in zip(zip(*found, strict=True), kinds, strict=True)]

        return run

    # hashed inputs as bytes: at most 6 for each of WORD_DIMS places of a text, however long it is
    rows = labelled_sample(docs.select(id_col, text_col), labels, label, fold, {0: sample, 1: sample}, id_col)
    rows = add_from_text(rows, text_col, make, "stats binary, at binary, value binary")
    rows = sorted(rows.select(id_col, "_y", "stats", "at", "value").collect(), key=lambda r: r[0])
    inputs = [(np.frombuffer(r["stats"], "<f8"), np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in rows]
    return train(inputs, np.array([r["_y"] for r in rows]))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score, 0 to 1."""

    def make():
        def run(texts):
            z = machine.raw([machine.inputs(*describe(t)) for t in texts]) if texts else np.zeros(0)
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

        return run

    return add_from_text(docs, text_col, make, "quality_score double")
