"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Two
fingerprints that differ in at most two bits agree in one segment wholly
(pigeonhole), and in each other segment by two bits at most. The perfect binary
Golay code (23, 12) decodes every 23-bit word to one of 4096 codewords; the
words within one bit of a segment decode to one to six codeword indices, and
two segments two bits apart always share one of them. So a fingerprint's keys
are, for each segment taken as exact, its bits with each index of the next
segment; equal keys are joined and the bits compared.

A key with more than ``bucket_limit`` distinct fingerprints would make too many
comparisons. Its members go another exact way: two words are at most two bits
apart if and only if some word is within one bit of both, so each member is
listed under its 65 nearest words, and those under one word are all linked.

Links hold between distinct fingerprints only; equal ones share a node. Groups
are the connected components, found by large-star and small-star steps.

Defined results: null and empty texts have fingerprint zero and are linked like
others; a text with fewer words than a shingle is one shingle; a document with
a null id gets its fingerprint, links nothing and has a null component; rows
repeated with one id come out repeated; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from materia.llm.common import fresh, shared_table, small_batches

SHINGLE = 3
SEED = 42
BUCKET_LIMIT = 128
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: lower-case A-Z, word shingles, XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = _WORDS((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), _CHUNK):
        part = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], last[at : at + _CHUNK], strict=False)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and signed 64-bit fingerprint, in one pass over the texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Golay:
    """The perfect (23, 12) code in systematic form: an index is a word's upper 12 bits."""

    GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a factor of x^23 - 1

    def __init__(self) -> None:
        words = np.arange(1 << 12, dtype=np.int64)
        self.rest = np.array([self._remainder(1 << k) for k in range(23)], dtype=np.int64)
        # parity of the data bits, by lookup; then the error of each of the 2048 syndromes
        self.parity = np.zeros(1 << 12, dtype=np.int64)
        for k in range(12):
            self.parity ^= np.where(words >> k & 1, self.rest[k + 11], 0)
        self.error = np.zeros(1 << 11, dtype=np.int64)
        flips = [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a in range(23) for b in range(a)),
                 *(1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b))]
        flips = np.array(flips, dtype=np.int64)
        self.error[self._syndrome(flips)] = flips

    def _remainder(self, x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= self.GENERATOR << (k - 11)
        return x

    def _syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parity[words >> 11] ^ (words & 0x7FF)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self._syndrome(words)]) >> 11

    def near_indices(self, words: np.ndarray) -> np.ndarray:
        """The indices of a word and of the 23 words one bit off; -1 in place of repeats."""
        ball = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)[None, :]
        found = np.sort(self.index(ball), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, fp) of distinct fingerprints ``nodes(node, fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [(marks >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18))]
            rows, keys = [], []
            for kind in range(3):
                near = code.near_indices(parts[(kind + 1) % 3])
                row, col = np.nonzero(near >= 0)
                rows.append(row)
                keys.append(kind << 40 | parts[kind][row] << 12 | near[row, col])
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(row), batch.column(1).take(row)], names=["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp long")


def links(nodes: DataFrame, bits: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(u, v), u < v: links that connect all nodes whose fingerprints differ in at most two bits."""
    if bits != 2:
        raise ValueError("the keys are made for links of at most two differing bits")
    keys = shared_table(bucket_keys(nodes), "keys")
    sizes = keys.groupBy("key").count().filter("count > 1")
    small = keys.join(sizes.filter(F.col("count") <= bucket_limit), "key")
    a, b = small.alias("a"), small.alias("b")
    close = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
    close &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    compared = a.join(b, close).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    # large buckets: all within one bit of a word are linked; at most 65 distinct fingerprints are
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    large = keys.join(sizes.filter(F.col("count") > bucket_limit).select("key"), "key", "left_semi").select("node", "fp").distinct()
    under = large.select("node", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    stars = under.groupBy("word").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)
    stars = stars.select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v")).filter("u < v").distinct()
    return compared.unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges(u, v)``, for nodes that have an edge.

    Large-star and small-star steps until nothing changes; each round is a table
    in the shared folder, of which the driver sees only a count and a checksum.
    """
    edges = shared_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        edges = shared_table(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"the components have not settled in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = 2,
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fp (signed), component_id: the smallest doc_id of the document's group."""
    marks = shared_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = marks.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = shared_table(nodes, "nodes")
    roots = components(links(nodes, bits, bucket_limit))
    groups = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    joined = marks.join(groups, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each group the document with the smallest id stays.

    Documents with a null id are in no group and stay.
    """
    gone = near_duplicates(docs, id_col, text_col).filter(F.col("component_id") != F.col("doc_id"))
    (name,) = fresh(docs, "gone")
    return docs.join(gone.select(F.col("doc_id").alias(name)), F.col(id_col) == F.col(name), "left_anti")


def hex_digits(fp: str = "fp"):
    """16 lower-case hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
