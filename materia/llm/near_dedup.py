"""Near-duplicates by the Jaccard similarity of word shingles, exactly.

First comes SimHash through Golay-code fuzzy hashing, as in ``simhash``: the
keys of the fingerprints are joined, and fingerprints at most two bits apart,
or equal, give pairs, which are linked if their sets of shingles are similar.
Similar texts whose fingerprints are further apart (at a similarity of 0.8 by
ten bits or so) have no such key in common; an exact way finds them, as
follows, and compares no pair that the first step put together.

Texts become sets of hashed shingles (five lower-case words). If two sets are
as similar as ``least``, they share at least ``ceil(least * n)`` shingles, n the
size of the larger; in any common order of all shingles, the first
``n - ceil(least * n) + SHARED`` of both then have ``SHARED`` in common (fewer
only if the sets are smaller). So these prefixes are the keys, and no similar
pair is lost, whatever the order. Shingles that are frequent in a sample come
late in it, and after them those that, in this first order, are keys of more
than ``bucket_limit`` documents, the most frequent last (of both lists at most
``FREQUENT`` shingles: they set the order, not what is found). So a passage that
many documents share makes few keys, and documents that have nothing else in
common are not compared. Pairs with enough common keys are compared by their
whole sets.

A key of more than ``bucket_limit`` documents is not paired with itself: each
document is first compared with a few of the key's documents, and then each
document outside the largest group of the key with those of other groups. What
is left out are pairs that are in one group already, so groups are the same.
Two documents often share many such keys; they are compared at those only where
none of the ``EARLIER`` keys before it, in the order of the keys' values, is a key
of both: at the first key of both that is so, and at few others. Of these
comparisons, those whose parity bitmaps prove the sets too different make no row: a set's bitmap tells of each of ``64 * WORDS`` bins whether it holds
an odd number of the shingles, so two bitmaps differ in at most as many bins as
the sets in shingles, and similar sets differ in few.

Defined results: words are as in ``simhash``; a text with fewer words than a
shingle is one shingle, and so are null and empty texts, which are alike; a
document with a null id is in no group; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from materia.llm.common import fresh, hash_share, shared_table, small_batches
from materia.llm.simhash import _WORDS, components, fingerprints, links

SHINGLE = 5
LEAST = 0.8
#: Keys that a pair must have in common to be compared.
SHARED = 8
BUCKET_LIMIT = 16
#: Documents of a large key that all its documents are compared with first.
PIVOTS = 2
#: Documents, and shingles found in three of them or more, that set the order.
SAMPLE, FREQUENT = 4000, 200_000
#: Keys before a crowded one that a document carries along, to tell whether a pair has met already.
EARLIER = 8
#: Longs of a parity bitmap.
WORDS = 16
#: Sets with this number of shingles together are broadcast.
BROADCAST_SHINGLES = 4_000_000
_EPS = 1e-9
_BITMAP = [f"b{k}" for k in range(WORDS)]


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.words = size, {}
        self.odd = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(size)]

    def of(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = _WORDS((text or "").encode("utf-8", "surrogatepass").lower())
        if len(self.words) > 500_000:
            self.words.clear()
        known = self.words
        for w in words:
            if w not in known:
                known[w] = xxh64_intdigest(w, 42)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.size, len(h))
        total = np.full(max(1, len(h) - self.size + 1), width + 1, np.uint64)
        for k in range(width):
            part = h[k : k + len(total)] * self.odd[k]
            total = (total ^ part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(32)))


def _least_shared(n: int, least: float) -> int:
    return math.ceil(least * n - _EPS)


def _made(docs: DataFrame, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, schema)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(shingle)
        for batch in batches:
            sets = [made.of(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return _made(docs, id_col, text_col, "node long, shingles array<long>", run)


def parity_bitmaps(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, b0, b1, ...): of each bin, whether it holds an odd number of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(shingle)
        for batch in batches:
            odd = [np.bincount((made.of(t.as_py()) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1 for t in batch.column(1)]
            words = np.packbits(np.array(odd, np.uint8).reshape(-1, 64 * WORDS), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w) for w in np.ascontiguousarray(words.T))], names=["node", *_BITMAP])

    return _made(docs, id_col, text_col, ", ".join(["node long", *(f"{b} long" for b in _BITMAP)]), run)


def not_too_different(a: str, b: str, least: float):
    """False only where the bitmaps of rows ``a`` and ``b`` prove that their sets of ``n`` shingles are less similar than ``least``."""
    differing = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _BITMAP))
    return differing <= F.lit((1 - least) / (1 + least)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + _EPS


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the ``FREQUENT`` largest counts in ``rows(s, count)``, and the counts."""
    table = rows.orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    return table["s"].to_numpy().view(np.uint64), table["count"].to_numpy()


def frequent(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in three documents of a sample or more, sorted, and in how many."""
    sample = docs.filter(hash_share(id_col, "shingles", min(1.0, SAMPLE / max(1, docs.count()))))
    counts = shingle_sets(sample, id_col, text_col, shingle).select(F.explode("shingles").alias("s")).groupBy("s").count()
    known, count = _counts(counts.filter("count > 2"))
    order = np.argsort(known)
    return known[order], count[order]


def with_crowded(order: tuple[np.ndarray, np.ndarray], keys: DataFrame, bucket_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``order`` with the most crowded keys put behind all others, by their counts."""
    crowded, count = _counts(keys.groupBy(F.col("key").alias("s")).count().filter(F.col("count") > bucket_limit))
    other = ~np.isin(order[0], crowded)
    known = np.concatenate([order[0][other], crowded])
    rank = np.concatenate([order[1][other], count + (1 << 40)])
    at = np.argsort(known)
    return known[at], rank[at]


def prefix_keys(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, node, n): the first shingles of each document in the common order, and the size of its set."""
    known, counts = order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles(shingle)
        for batch in batches:
            keys, sizes = [], []
            for t in batch.column(1):
                s = made.of(t.as_py())
                seen = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    seen = np.where(known[at] == s, counts[at], 0)
                first = np.argsort(seen, kind="stable")[: len(s) - _least_shared(len(s), least) + SHARED]
                keys.append(s[first])
                sizes.append(len(s))
            many = np.array(list(map(len, keys)), np.int64)
            rows = pa.array(np.repeat(np.arange(len(many)), many))
            every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), batch.column(0).take(rows), pa.array(np.repeat(np.array(sizes, np.int32), many))], names=["key", "node", "n"])

    return _made(docs, id_col, text_col, "key long, node long, n int", run)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets are similar; only texts of pairs are read into sets."""
    pairs = shared_table(pairs, "pairs")
    held = pairs.select(F.explode(F.array("u", "v")).alias(id_col)).distinct()
    sets = shared_table(shingle_sets(docs.join(held, id_col, "left_semi"), id_col, text_col, shingle), "sets")
    if (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        sets = F.broadcast(sets)
    a, b = sets.toDF("u", "su"), sets.toDF("v", "sv")
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("su", "sv")))
    similar = F.col("common") >= F.lit(least) * (F.size("su") + F.size("sv") - F.col("common")) - _EPS
    return shared_table(both.filter(similar).select("u", "v"), "similar")


def golay_links(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """(u, v), u < v: links of ``simhash`` whose sets are similar; documents of one fingerprint meet the smallest of them."""
    marks = shared_table(fingerprints(docs.filter(F.col(id_col).isNotNull()), id_col, text_col), "fingerprints")
    nodes = shared_table(marks.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    equal = marks.join(nodes, "fp").filter("doc_id > node").select(F.col("node").alias("u"), F.col("doc_id").alias("v")).distinct()
    return verified(links(nodes).unionByName(equal), docs, id_col, text_col, shingle, least)


def apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` that ``linked(u, v)`` doesn't put together, neither by a link nor by one smallest neighbour of both."""
    least = linked.groupBy("v").agg(F.min("u").alias("m"))
    both = pairs.join(least.toDF("u", "mu"), "u", "left").join(least.toDF("v", "mv"), "v", "left")
    return both.filter(F.coalesce("mu", "u") != F.coalesce("mv", "v")).select("u", "v").join(linked, ["u", "v"], "left_anti")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(u, v), u < v: links that connect all documents whose sets of shingles are similar."""
    linked = golay_links(docs, id_col, text_col, shingle, least)
    order = frequent(docs, id_col, text_col, shingle)
    order = with_crowded(order, prefix_keys(docs, id_col, text_col, shingle, least, order), bucket_limit)
    keys = prefix_keys(docs, id_col, text_col, shingle, least, order)
    members = shared_table(keys.withColumn("count", F.count("*").over(Window.partitionBy("key"))).filter("count > 1"), "members")
    sized = F.least("a.n", "b.n") >= F.lit(least) * F.greatest("a.n", "b.n") - _EPS
    pair = [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]

    small = members.filter(F.col("count") <= bucket_limit)
    a, b = small.alias("a"), small.alias("b")
    needed = F.least(F.lit(SHARED), F.ceil(F.lit(least) * F.greatest("a.n", "b.n") - _EPS))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & sized).groupBy(*pair, needed.alias("needed")).count()
    pairs = met.filter("count >= needed").select("u", "v")

    large = members.filter(F.col("count") > bucket_limit).drop("count")
    crowded = not large.isEmpty()
    if crowded:
        held = large.select(F.col("node").alias(id_col)).distinct()
        bitmaps = shared_table(parity_bitmaps(docs.join(held, id_col, "left_semi"), id_col, text_col, shingle).dropDuplicates(["node"]), "bitmaps")
        # a document's crowded keys are a part of its own shingles, so they are gathered by document
        listed = large.groupBy("node", "n").agg(F.array_sort(F.collect_set("key")).alias("keys"))
        listed = listed.select("node", "n", F.posexplode("keys").alias("at", "key"), "keys")
        listed = listed.withColumn("earlier", F.slice("keys", F.greatest(F.col("at") - EARLIER, F.lit(0)) + 1, F.least(F.col("at"), F.lit(EARLIER)))).drop("keys", "at")
        large = listed.join(bitmaps, "node")
        alike = sized & not_too_different("a", "b", least)
        heads = [F.min_by(F.struct("node", "n", *_BITMAP), F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)]
        stars = large.groupBy("key").agg(F.array(*heads).alias("p")).select("key", F.inline(F.array_distinct("p")))
        a, b = large.alias("a"), stars.alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") != F.col("b.node")) & alike)
        pairs = pairs.unionByName(met.select(*pair)).distinct()
    found = linked.unionByName(verified(apart(pairs, linked), docs, id_col, text_col, shingle, least))
    if not crowded:
        return found
    roots = shared_table(components(found), "roots")
    rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("key", "root").count()
    main = groups.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = rooted.join(main, "key").filter("root != main")
    a, b = rest.alias("a"), rooted.alias("b")
    # of a pair's common keys the first one always makes a row: one of the two is outside its largest group, whichever that is
    anew = ~F.arrays_overlap("a.earlier", "b.earlier")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & anew & alike)
    return found.unionByName(verified(met.select(*pair).distinct(), docs, id_col, text_col, shingle, least))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs`` without near-duplicates: of each group of linked documents the one with the smallest id stays.

    Documents with a null id are in no group and stay.
    """
    gone = components(similar(docs, id_col, text_col, shingle, least, bucket_limit)).filter("node != root")
    (name,) = fresh(docs, "gone")
    return docs.join(gone.select(F.col("node").alias(name)), F.col(id_col) == F.col(name), "left_anti")
