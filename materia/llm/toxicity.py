"""Toxicity: a learned lexicon matched by Levenshtein automata over its trie.

The lexicon is learned from labelled texts: whole words, and stems (prefixes
with several completions), that are far likelier in toxic texts than in others.
A trie of its terms is run together with the Levenshtein automaton of each term
(one edit for whole words from five letters, inflected ones included, none for
stems): a state is the set of (trie node, edits so far), made when first met
and remembered, so nearly every word dies after a few letters.

Each match is scored in its window of words: quotation marks around it count
for quotation, further matches near it for abuse. A logistic model weighs the
sums of a text; misspelt terms that are no inflection, and inflected ones, have
weights of their own. As labelled texts seldom hold misspelt terms, the model
also learns from each labelled text as if its terms were misspelt, all of them
and one alone. Lexicon and weights are fitted on at most about ``TOXIC`` and
``CLEAN`` labelled texts.

Defined results: null and empty texts, like all without a match, get the score
of no match; with no labelled text the lexicon is empty and the score 0; of
terms that match one word the one with fewer edits counts, of equal ones the
one of larger weight; repeated rows get the same result; an empty table gives
no rows; columns of the input keep their names and values, unless named as a
result column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from materia.llm.common import add_from_text, label_shares, labelled_sample

TOXIC, CLEAN = 4000, 8000
WINDOW = 8
STEM = (4, 8)
LEAST_LETTERS = 3
#: A term is in so many toxic texts of the sample at least, and so many times likelier in toxic texts, which by its
#: log-likelihood ratio (a chance of about one in ten million) is no accident.
SUPPORT, ODDS, RATIO = 5, 10.0, 28.0
#: Weight of what a text would be if misspelt, of all its weight in fitting.
MISSPELT = 0.1
REMEMBER = 300_000
_WORD = re.compile(r"[^\W_]+")
# Marks that open or close a quotation.
_QUOTES = "\"“”„«»‹›‘’"
FEATURES = 7


@dataclass
class Term:
    text: str
    stem: bool
    weight: float
    inflected: bool = False  # a whole word that begins with a stem of the lexicon

    @property
    def edits(self) -> int:
        return int(not self.stem and len(self.text) >= 5)


#: Minus the edits, weight of the term, whether it is inflected.
Hit = tuple[int, float, bool]


class Automaton:
    """Deterministic states over (trie node, edits), made as words are read."""

    def __init__(self, terms: list[Term]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[Term | None] = [None]
        self.reach: list[int] = [0]  # most edits that a term below allows
        for t in terms:
            at = 0
            self.reach[0] = max(self.reach[0], t.edits)
            for c in t.text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], t.edits)
            if self.term[at] is None or t.weight > self.term[at].weight:
                self.term[at] = t
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.stems: list[Hit | None] = []
        self.ends: list[Hit | None] = []
        self.next: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """Skipping letters of a term (deletions) is done here, at once."""
        queue = list(items)
        while queue:
            node, e = queue.pop()
            for child in self.children[node].values():
                new = (child, e + 1)
                if e + 1 <= self.reach[child] and new not in items:
                    items.add(new)
                    queue.append(new)
        key = frozenset((n, e) for n, e in items if not any((n, x) in items for x in range(e)))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            hits = [(t, e) for n, e in key if (t := self.term[n]) and e <= t.edits]
            best = lambda of: max(((-e, t.weight, t.inflected) for t, e in of), default=None)
            self.stems.append(best([h for h in hits if h[0].stem]))
            self.ends.append(best(hits))
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if c in self.children[node]:
                items.add((self.children[node][c], e))
            if e < self.reach[node]:
                items.add((node, e + 1))
            items |= {(child, e + 1) for child in self.children[node].values() if e < self.reach[child]}
        return self._state(items)

    def match(self, word: str) -> Hit | None:
        """The best term that the word is, or begins with."""
        state, best = self.start, None
        for c in word:
            key = (state, c)
            state = self.next.get(key, -1)
            if state < 0:
                state = self.next[key] = self._step(*key)
            if not self.states[state]:
                return best
            hit = self.stems[state]
            if hit and (best is None or hit > best):
                best = hit
        hit = self.ends[state]
        return hit if hit and (best is None or hit > best) else best


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    #: words near a term that clean texts use
    harmless: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: np.array([-20.0] + [0.0] * (FEATURES - 1)))


class Matcher:
    def __init__(self, model: Model) -> None:
        self.automaton = Automaton(model.terms)
        self.harmless = model.harmless
        self.known: dict[str, Hit | None] = {}
        self.editable: dict[str, Hit] = {t.text: (-1, t.weight, t.inflected) for t in model.terms if t.edits}

    def _look(self, word: str) -> Hit | None:
        if word not in self.known:
            if len(self.known) > REMEMBER:
                self.known.clear()
            hit = self.automaton.match(word)
            self.known[word] = None if hit and hit[0] < 0 and word in self.harmless else hit
        return self.known[word]

    def hits(self, text: str | None) -> tuple[str, dict[str, Hit]]:
        low = (text or "").lower()
        return low, {w: h for w in set(_WORD.findall(low)) if (h := self._look(w))}

    def features(self, text: str | None, misspelt: bool = False, alone: bool = False) -> np.ndarray:
        """1; logarithms of abuse, quotation, inexact plain and inflected matches, different exact terms, and the densest window.

        ``misspelt``: as if every exact match that allows an edit had one; ``alone``: as if the first match were the only one.
        """
        low, hit = self.hits(text)
        out = np.zeros(FEATURES)
        out[0] = 1.0
        if not hit:
            return out
        words = list(_WORD.finditer(low))
        places = [i for i, w in enumerate(words) if w[0] in hit]
        if alone:
            places = places[:1]
            hit = {words[places[0]][0]: hit[words[places[0]][0]]}
        if misspelt:
            hit = {w: self.editable.get(w, h) for w, h in hit.items()}
        abuse = quoted = densest = 0.0
        inexact = [0.0, 0.0]
        left = 0
        for k, i in enumerate(places):
            while places[left] < i - WINDOW:
                left += 1
            near = k - left
            edits, weight, inflected = hit[words[i][0]]
            before = low[words[max(0, i - WINDOW)].start() : words[i].start()].rpartition("\n")[2]
            after = low[words[i].end() : words[min(len(words) - 1, i + WINDOW)].end()].partition("\n")[0]
            # a quotation is opened on the line before and closed after, within the window
            is_quoted = sum(before.count(q) for q in _QUOTES) % 2 == 1 and any(q in after for q in _QUOTES)
            score = min(weight, 6.0) / 6.0 * (1.0 + 0.25 * near)
            if is_quoted:
                quoted += score
            elif edits:
                inexact[inflected] += score
            else:
                abuse += score
                densest = max(densest, near + 1.0)
        exact = sum(e == 0 for e, _, _ in hit.values())
        out[1:] = np.log1p([abuse, quoted, *inexact, exact, densest])
        return out


def learn_terms(sample: DataFrame, text_col: str, support: int = SUPPORT, odds: float = ODDS) -> list[Term]:
    """Terms by the texts of each label that have them, counted by Spark; only terms reach the driver."""
    # copies of a text would lift its rare words
    texts = sample.select(F.lower(text_col).alias("t"), "_y").filter("t is not null").dropDuplicates(["t"])
    totals = texts.agg(F.sum("_y").alias("toxic"), F.sum(1 - F.col("_y")).alias("clean")).first()
    toxic, clean = totals["toxic"] or 0, totals["clean"] or 0
    if not toxic:
        return []
    # shares of each label's own texts, so the sizes of the two samples don't matter
    likelier = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    share = toxic / (toxic + clean)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((F.col("toxic") + F.col("clean")) * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), share) + (part(F.col("clean"), 1 - share) if clean else F.lit(0.0)))
    strong = (F.col("toxic") >= support) & (likelier >= odds) & ((ratio >= RATIO) | F.lit(not clean))
    words = texts.select("_y", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(\p{L}+)"), 1))).alias("word"))
    words = words.filter(F.length("word") >= LEAST_LETTERS)
    counted = words.groupBy("word").agg(F.sum("_y").alias("toxic"), F.sum(1 - F.col("_y")).alias("clean"))
    whole = counted.withColumn("odds", likelier).filter(strong).collect()
    # prefixes: summed over the words first, as a text seldom has two completions of one stem
    low, high = STEM
    stems = counted.filter(F.length("word") >= low).select(
        F.explode(F.expr(f"transform(sequence({low}, least({high}, length(word))), n -> left(word, n))")).alias("stem"), "toxic", "clean", "word"
    )
    stems = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("top"))
    stems = stems.filter(strong & (F.col("toxic") >= 1.3 * F.col("top"))).withColumn("odds", likelier).collect()
    found = {r["stem"]: r for r in stems}
    # of a chain of prefixes, the longest that covers nearly what the shortest does
    chosen: dict[str, Term] = {}
    for s in sorted(found, key=lambda s: (len(s), s)):
        if any(s[:k] in chosen or s[:k] in found for k in range(low, len(s))):
            continue
        longer = [x for x in found if x.startswith(s) and found[x]["toxic"] >= 0.95 * found[s]["toxic"]]
        best = max(longer, key=lambda x: (len(x), x))
        chosen[best] = Term(best, True, float(np.log(found[best]["odds"])))
    terms = list(chosen.values())
    stem_of = lambda w: any(w[:k] in chosen for k in range(low, len(w) + 1))
    terms += [Term(r["word"], False, float(np.log(r["odds"])), stem_of(r["word"])) for r in whole]
    return sorted(terms, key=lambda t: (-t.weight, t.text, t.stem))


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1e-5, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model; ``cost`` weighs the rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (cost * p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (cost * (p - y)) / len(y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fold, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    sample = labelled_sample(docs.select(id_col, text_col), labels, label, fold, {1: toxic, 0: clean}, id_col)
    model = Model(learn_terms(sample, text_col))
    if not model.terms:
        return model

    def near():
        matcher = Matcher(model)
        return lambda texts: [pa.array([[w for w, h in matcher.hits(t)[1].items() if h[0] < 0] for t in texts], pa.list_(pa.string()))]

    # forms near a term that clean texts use: weights are fitted with those of one half of the sample, so that the other
    # half shows how many are left; then those of the whole sample are taken
    def harmless(part: DataFrame) -> set[str]:
        forms = add_from_text(part, text_col, near, "form array<string>").select("_y", F.explode("form").alias("form"))
        forms = forms.groupBy("form").agg(F.sum("_y").alias("toxic"), F.sum(1 - F.col("_y")).alias("clean")).filter("clean > 0.1 * toxic")
        return {r["form"] for r in forms.collect()}

    every_form = harmless(sample)
    model.harmless = harmless(sample.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("half")), F.lit(2)) == 0))

    def make():
        matcher = Matcher(model)
        every = lambda t: [*matcher.features(t), *matcher.features(t, misspelt=True), *matcher.features(t, misspelt=True, alone=True)]
        return lambda texts: [pa.array([every(t) for t in texts], pa.list_(pa.float64()))]

    rows = add_from_text(sample, text_col, make, "x array<double>").select("_y", "x").collect()
    y = np.array([r["_y"] for r in rows], float)
    if 0 < y.mean() < 1:
        # the sample holds the labels in other shares than the corpus does; rows weigh what they stand for
        shares = label_shares(labels, label, fold, id_col)
        cost = np.where(y == 1, shares.get(1, 0.0) / y.mean(), shares.get(0, 0.0) / (1 - y.mean()))
        parts = np.tile([1 - MISSPELT, MISSPELT / 2, MISSPELT / 2], len(y))
        x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
        model.weights = _logistic(x, np.repeat(y, 3), np.repeat(cost, 3) * parts)
    model.harmless = every_form
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and toxic_terms (matched words, sorted)."""

    def make():
        matcher = Matcher(model)

        def run(texts):
            z = np.array([matcher.features(t) @ model.weights for t in texts]) if texts else np.zeros(0)
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array([sorted(matcher.hits(t)[1]) for t in texts], pa.list_(pa.string()))]

        return run

    return add_from_text(docs, text_col, make, "toxic_score double, toxic_terms array<string>")
