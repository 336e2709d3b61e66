"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is a stretch of an item's words, ``size`` of them (all words of a
shorter item). Its tokens are its shingles of ``SHINGLE`` words. Documents that
contain a window contain all its tokens, so in any order of the tokens the
first one is a prefix that loses nothing; the order is by rarity in the
documents, counted over all of them, so it is the token that fewest places
have. A token that no document has rules its window out at once.

Places of documents with a prefix token join the windows on it. The token's
place in the window fixes where the window would begin: it must begin and end
within the document (position and length bounds), and the words found there are
compared with the window's, exactly.

What goes to all tasks is a bitmap of the wanted tokens, of ``MOST_BITS`` bits at
most: with more tokens it lets more places through to the join, which is exact.
Windows are broadcast where their counted size allows, and meet the places by a
shuffle beyond it. Items that share a window share its one row.

Defined results: a null text has no words; a null item id is the item with the
empty name; rows that repeat an item id are one item; rows that repeat a
document id are judged each; an empty table of items leaves all documents clean,
an empty table of documents gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from materia.llm.common import shared_table, small_batches

WINDOW = 10
SHINGLE = 3
#: Bits for each wanted token, and of the whole bitmap at least and at most (16 MB).
BITS_A_TOKEN, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 27
#: Windows, and rows (window, item), that are broadcast at most: about 250 and 60 bytes each.
BROADCAST_WINDOWS, BROADCAST_MEMBERS = 100_000, 500_000
#: Windows of one Arrow batch.
BATCH = 4096

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b in _KEPT or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def tokens(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit keys of all stretches of ``width`` words."""
    count = max(0, len(hashes) - width + 1)
    key = np.full(count, width, np.uint64)
    for k in range(width):
        key = (key ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, window, n, width, keys): every stretch of words of every item, as text, with the keys of its tokens."""
    schema = "item string, window string, n int, width int, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = min(size, len(words))
                width = min(SHINGLE, n)
                keys = tokens(_hashes(words), width).view(np.int64) if n else ()
                for at in range(0, len(words) - n + 1 if n else 0, BATCH):
                    starts = range(at, min(at + BATCH, len(words) - n + 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(starts)), pa.array([b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass") for i in starts]), pa.array([n] * len(starts), pa.int32()),
                         pa.array([width] * len(starts), pa.int32()), pa.array([keys[i : i + n - width + 1] for i in starts], pa.list_(pa.int64()))],
                        names=["item", "window", "n", "width", "keys"],
                    )

    small_batches(items.sparkSession)
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


class Bitmap:
    """A set of 64-bit keys as bits, made by Spark in blocks and held by tasks; false positives only."""

    BLOCK = 1 << 15

    def __init__(self, keys: DataFrame) -> None:
        """``keys``: one column ``key``."""
        count = keys.count()
        self.bits = LEAST_BITS
        while self.bits < min(MOST_BITS, count * BITS_A_TOKEN):
            self.bits *= 2
        place = F.pmod(F.col("key"), F.lit(self.bits))
        blocks = keys.groupBy(F.expr(f"bigint(pmod(key, {self.bits}L) div {self.BLOCK})").alias("block")).agg(F.bitmap_construct_agg((place % self.BLOCK).cast("int")).alias("held"))
        whole = bytearray(self.bits // 8)
        for row in blocks.toLocalIterator():  # at most MOST_BITS in all
            whole[row["block"] * self.BLOCK // 8 : (row["block"] + 1) * self.BLOCK // 8] = row["held"]
        self.sent = keys.sparkSession.sparkContext.broadcast(bytes(whole))

    def holder(self):
        """The test of an array of keys, for use in a task; the bytes come by broadcast."""
        held, bits = np.frombuffer(self.sent.value, np.uint8), np.uint64(self.bits - 1)

        def holds(keys: np.ndarray) -> np.ndarray:
            place = keys & bits
            return (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        return holds


def _texts(docs: DataFrame, text_col: str, *others) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*others, F.col(text_col).cast("string").alias("text"))


def token_counts(docs: DataFrame, text_col: str, wanted: Bitmap, widths: list[int]) -> DataFrame:
    """(key, count): in how many places of all documents each token is, for the tokens that ``wanted`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = wanted.holder()
        for batch in batches:
            found = []
            for text in batch.column(0):
                hashes = _hashes(words_of(text.as_py()))
                for width in widths:
                    keys = tokens(hashes, width)
                    found.append(keys[holds(keys)])
            keys, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "count"])

    return _texts(docs, text_col).mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))


def places(docs: DataFrame, id_col: str, text_col: str, wanted: Bitmap, widths: list[int], size: int) -> DataFrame:
    """(row, id, n_words, spots) of every document; a spot is a token that ``wanted`` lets through.

    ``spots``: key, at (its first word's place), before (words of ``around`` in front of it) and ``around``, the words
    that a window with this token could cover.
    """
    spot = pa.struct([("key", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())])
    at_id = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = wanted.holder()
        for batch in batches:
            counts, spots = [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                hashes = _hashes(words)
                own = []
                for width in widths:
                    keys = tokens(hashes, width)
                    for at in np.flatnonzero(holds(keys)).tolist():
                        first = max(0, at - size + 1)
                        around = b" ".join(words[first : at + size]).decode("utf-8", "surrogatepass")
                        own.append({"key": int(keys[at : at + 1].view(np.int64)[0]), "at": at, "before": at - first, "around": around})
                counts.append(len(words))
                spots.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(at_id), pa.array(counts, pa.int64()), pa.array(spots, pa.list_(spot))], names=["row", "id", "n_words", "spots"])

    rows = _texts(docs, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, n_words long, spots array<struct<key: long, at: long, before: int, around: string>>")


def find_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (row, id, n_words), the occurrences (row, start, n, window) in them, and the items (window, item)."""
    made = shared_table(windows(items, item_col, item_text_col, size), "item-windows")
    each = made.dropDuplicates(["window"])
    widths = sorted(r["width"] for r in made.select("width").distinct().collect())  # SHINGLE values at most
    listed = each.select("window", "n", F.posexplode("keys").alias("place", "key"))
    wanted = Bitmap(listed.select("key").distinct())
    counts = token_counts(docs, text_col, wanted, widths)
    first = listed.join(counts, "key").groupBy("window", "n").agg(F.count("*").alias("known"), F.min(F.struct("count", "key", "place")).alias("rarest"))
    # a window with a token that no document has isn't in any
    possible = first.filter(F.col("known") == F.col("n") - F.least(F.lit(SHINGLE), F.col("n")) + 1)
    prefixes = shared_table(possible.select(F.col("rarest.key").alias("key"), F.col("rarest.place").alias("place"), F.col("window").alias("words"), "n").withColumn("window", F.monotonically_increasing_id()), "prefixes")
    found = shared_table(places(docs, id_col, text_col, Bitmap(prefixes.select("key").distinct()), widths, size), "places")

    small = prefixes.count() <= BROADCAST_WINDOWS
    spots = found.select("row", "n_words", F.inline("spots"))
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("before") >= F.col("place"))
    there = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("n")), " ")
    met = spots.join(F.broadcast(prefixes) if small else prefixes, "key").filter(inside & (there == F.col("words")))
    hits = shared_table(met.select("row", start.alias("start"), "n", "window"), "hits")
    members = made.select("item", F.col("window").alias("words")).distinct().join(prefixes.select("window", "words"), "words").select("window", "item")
    return found.select("row", "id", "n_words"), hits, shared_table(members, "members")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row a document: its id, n_words, n_hit (words inside any occurrence), spans, items, contaminated.

    ``spans``: start and stop (exclusive) of the stretches of hit words, in order; ``items``: ids as text, sorted.
    """
    every, hits, members = find_windows(docs, items, id_col, text_col, item_col, item_text_col, size)
    stop = F.col("start") + F.col("n")
    in_row = Window.partitionBy("row").orderBy("start", "n")
    reached = F.max(stop).over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")
    islands = hits.select("row", "start", stop.alias("stop"), "n").withColumn("apart", apart).withColumn("island", F.sum("apart").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    if members.count() <= BROADCAST_MEMBERS:
        members = F.broadcast(members)
    whose = hits.select("row", "window").distinct().join(members, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = "array<struct<start: long, stop: long>>"
    return every.join(spans, "row", "left").join(whose, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(none)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


ORACLE = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM item, unnest(range(1, greatest(2, len(w) - 8))) AS spot(i) WHERE len(w) > 0),
there AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM doc, (SELECT DISTINCT n FROM wanted) AS sizes, unnest(range(1, len(w) - n + 2)) AS spot(i)),
hit AS (SELECT doc_id, i, n, item_id FROM there JOIN wanted USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
whose AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words ON words.doc_id = doc.doc_id LEFT JOIN whose ON whose.doc_id = doc.doc_id
"""
