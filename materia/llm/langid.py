"""Language identification by nearest centroid over TF-IDF character n-grams.

Texts become hashed counts of 1- to 3-grams of lower-case letters (anything
else is a space), damped by a logarithm, weighted by inverse document frequency
and normalised. Each language has a few centroids from spherical k-means. A
text gets the language of the centroid of largest cosine.

It is rejected if that cosine is below the threshold of its length. Thresholds
are learned: centroids of one half of the sample are compared with the texts of
the other half, once with all languages and once without the text's own, which
shows what texts of an unknown language reach. Where what nearly all known
texts reach is above what nearly all unknown ones do, the threshold lies
between, at a quarter of the way from the unknown; elsewhere known texts are
kept.

The model is fitted on at most about ``sample`` labelled texts a language and
``ROWS`` in all; only their n-gram vectors reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; so is everything if no labelled text exists to learn from; of
equal cosines the language of the smaller name wins; repeated rows get the same
result; an empty table gives no rows; columns of the input keep their names and
values, unless named as a result column.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from materia.llm.common import add_from_text, hash_share

DIMS = 1 << 14
SAMPLE = 600
#: Labelled texts of all languages together that the model is fitted on, about.
ROWS = 6000
CLUSTERS = 3
#: Numbers of n-grams that part short texts from longer ones; each range has its threshold.
LENGTHS = (60, 200, 1000, 5000)
#: Known texts that may be rejected, and unknown ones that may pass, where the two can be told apart.
LOSS, LEAK = 0.005, 0.1
#: A range with fewer texts in the sample has no quantiles; half the least cosine of its known texts (of all, if it has none) is its threshold.
LEAST_TEXTS = 50
UNKNOWN = "und"
_PART = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Ngrams:
    """Hashed n-gram counts of a text, whole, in parts of bounded size."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims = dims
        self.shift = np.uint32(32 - int(dims).bit_length() + 1)
        self.letter = _letters()

    def counts(self, text: str | None) -> np.ndarray | None:
        """None if there is no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        total, any_letter = np.zeros(self.dims, np.int64), False
        for at in range(0, len(codes), _PART):
            part = codes[max(0, at - 2) : at + _PART]
            keep = self.letter[part]
            any_letter = any_letter or bool(keep.any())
            u = np.where(keep, part, 32).astype(np.uint32)
            one = u * np.uint32(2654435761)
            two = (one[:-1] ^ (u[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
            three = (two[:-1] ^ (u[2:] * np.uint32(668265263))) * np.uint32(374761393)
            new = 2 if at else 0
            grams = np.concatenate([one[new:], two[max(0, new - 1) :], three])
            total += np.bincount(grams >> self.shift, minlength=self.dims)
        return total if any_letter else None


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray  # (centroids, dims)
    weight: np.ndarray  # inverse document frequencies
    least: np.ndarray  # cosine below which a text is rejected, by range of length


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from the row nearest the mean, then from the rows farthest from all so far."""
    centres = [rows[np.argmax(rows @ rows.mean(axis=0))]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.argmin((rows @ np.array(centres).T).max(axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(rows @ c.T, axis=1)
        c = _normal(np.array([rows[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


class Sample:
    """The sampled texts as weighted unit vectors: kept sparse, made dense for the rows asked for (a language at a time)."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], dims: int) -> None:
        every = np.concatenate([at for at, _ in grams]) if grams else np.zeros(0, np.int32)
        self.dims, self.at = dims, [at for at, _ in grams]
        self.weight = (np.log((1 + len(grams)) / (1 + np.bincount(every, minlength=dims))) + 1).astype(np.float32)
        self.size = np.array([n.sum() for _, n in grams], np.int64)
        self.value = [np.log1p(n).astype(np.float32) * self.weight[at] for at, n in grams]
        self.value = [v / max(float(np.linalg.norm(v)), 1e-12) for v in self.value]

    def rows(self, which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), self.dims), np.float32)
        for k, i in enumerate(which):
            x[k, self.at[i]] = self.value[i]
        return x


def thresholds(sample: Sample, owner: np.ndarray, clusters: int) -> np.ndarray:
    """The least cosine of each range of lengths, from halves of the sample held against each other."""
    size = sample.size
    known, unknown = np.zeros(len(size)), np.full(len(size), -1.0)
    at = np.arange(len(size))
    for part in (0, 1):
        centres = {o: spherical_kmeans(sample.rows(at[(at % 2 == part) & (owner == o)]), clusters) for o in np.unique(owner[at % 2 == part])}
        for o in np.unique(owner[at % 2 != part]) if centres else []:
            mine = at[(at % 2 != part) & (owner == o)]
            rows = sample.rows(mine)
            cosine = {q: (rows @ c.T).max(axis=1) for q, c in centres.items()}
            known[mine] = np.max(list(cosine.values()), axis=0)
            if others := [c for q, c in cosine.items() if q != o]:
                unknown[mine] = np.max(others, axis=0)
    ranges = np.searchsorted(LENGTHS, size, side="right")
    least = np.zeros(len(LENGTHS) + 1)
    for r in range(len(least)):
        mine, other = known[ranges == r], unknown[(ranges == r) & (unknown >= 0)]
        if len(mine) < LEAST_TEXTS:
            least[r] = 0.5 * float(min(mine, default=known.min() if len(known) else 0.0))
            continue
        keeps = float(np.quantile(mine, LOSS))
        passes = float(np.quantile(other, 1 - LEAK)) if len(other) else 0.0
        least[r] = (keeps + 3 * passes) / 4 if 0 < passes < keeps else keeps
    # a short text is never held to more than a longer one
    return np.minimum.accumulate(least[::-1])[::-1]


def fit(docs: DataFrame, fold=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
        clusters: int = CLUSTERS, dims: int = DIMS) -> Model:
    """Learn from rows with a language (and in ``fold``, a condition, if given)."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.filter(fold) if fold is not None else known
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    sample = min(sample, max(2, ROWS // max(1, len(counts))))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep |= (F.col("lang") == lang) & hash_share("id", "lang", min(1.0, sample / n))

    def make():
        grams = Ngrams(dims)

        def run(texts):
            found = [grams.counts(t) for t in texts]
            packed = [None if c is None else (np.flatnonzero(c).astype("<i4"), c) for c in found]
            at = [None if p is None else p[0].tobytes() for p in packed]
            n = [None if p is None else p[1][p[0]].astype("<i4").tobytes() for p in packed]
            return [pa.array(at, pa.binary()), pa.array(n, pa.binary())]

        return run

    rows = add_from_text(known.filter(keep), "text", make, "at binary, n binary").select("id", "lang", "at", "n").filter("at is not null").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], str(r["id"])))
    languages = sorted({r["lang"] for r in rows})
    owner = np.array([languages.index(r["lang"]) for r in rows], int)
    held = Sample([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in rows], dims)
    del rows
    centroids = [spherical_kmeans(held.rows(np.flatnonzero(owner == i)), clusters) for i in range(len(languages))]
    of = np.repeat(np.arange(len(languages)), [len(c) for c in centroids])
    return Model(languages, of, np.concatenate(centroids) if centroids else np.zeros((0, dims), np.float32), held.weight, thresholds(held, owner, clusters))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (largest cosine, 0 to 1), lang_rejected."""

    def make():
        grams = Ngrams(len(model.weight))
        sides = np.ascontiguousarray(model.centroids.T)

        def run(texts):
            pred, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for at in range(0, len(texts), 32):
                found = [grams.counts(t) for t in texts[at : at + 32]]
                have = [i for i, c in enumerate(found) if c is not None]
                if not have or not model.languages:
                    continue
                x = np.log1p(np.array([found[i] for i in have], np.float32)) * model.weight
                cosine = (x @ sides) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                best = np.argmax(cosine, axis=1)
                ranges = np.searchsorted(LENGTHS, [found[i].sum() for i in have], side="right")
                for i, b, c, r in zip(have, best, cosine.max(axis=1), ranges, strict=True):
                    pred[at + i], score[at + i], out[at + i] = model.languages[model.owner[b]], min(1.0, max(0.0, float(c))), c < model.least[r]
            return [pa.array(pred), pa.array(score), pa.array(out)]

        return run

    return add_from_text(docs, text_col, make, "lang_pred string, lang_score double, lang_rejected boolean")


def keep_known(docs: DataFrame, fold=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that a model learned from them rejects."""
    model = fit(docs, fold, id_col, text_col, lang_col)
    return identify(docs, model, text_col).filter("not lang_rejected").select(docs.columns)
