"""Packing token sequences into fixed windows, with bounded space per partition.

Every partition keeps at most ``open_windows`` windows open. A document is cut
into full windows; its remainder goes to the open window it fits best. When it
fits none and no further window may be opened, the fullest one is completed
with the head of the remainder (if neither part would be a sliver), emitted,
and the rest is placed. At the end of the partition what is open is merged into
full windows and one leftover, and the leftovers of neighbouring partitions are
merged in groups of bounded size.

Sequence numbers follow the partitions, and in a partition the order in which
windows are opened. Ties: of windows that fit equally well, and of equally full
ones, the one opened first is taken.

Defined results: a null or empty text is its end token alone; a null id keeps
its pieces under a null id; repeated rows are packed once each; an empty table
gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from materia.llm.common import fresh, shared_table, small_batches

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 32
#: No cut makes a piece shorter than this, so this is also the most padding of
#: an emitted window that a remainder failed to fill.
MIN_PIECE = 16
#: Partitions whose leftover windows, one each, are merged by one task.
MERGE_PARTITIONS = 1024
_SHIFT = 31

#: Texts with these characters go to the slower library: the two may class them
#: differently (white space among control characters, letters from U+0250 on).
_UNUSUAL = "[\x1c-\x1f\u0250-\U0010ffff]"

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("leftover", T.BooleanType()),
    ]
)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The ids are those of the byte-level BPE file ``path``. Its vocabulary, where
    an id is a merge rank, also drives the faster rank encoder, which takes the
    texts of common characters (nearly all) without a special token; the others
    go to ``tokenizers``. Both give the same ids; the tests compare them.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.exact = Tokenizer.from_file(path)
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        # the file writes each byte as a printable character
        printable = [c for c in range(256) if chr(c) in pre_tokenizers.ByteLevel.alphabet()]
        of_char = {chr(c): c for c in printable}
        of_char |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(printable))}
        ranks = {bytes(map(of_char.__getitem__, word)): i for word, i in self.exact.get_vocab().items() if word not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile("|".join([_UNUSUAL, *map(re.escape, sorted(special))])).search

    def encode(self, text: str) -> bytes:
        if self.unusual(text):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return array("I", ids).tobytes()


class _Partition:
    """Open windows of one partition and the finished pieces not yet sent."""

    def __init__(self, number: int, window: int, limit: int, least: int) -> None:
        self.first, self.window, self.limit, self.least = number << _SHIFT, window, limit, least
        self.made = 0
        self.open: list[list] = []  # [free, sequence id, pieces]
        self.rows: list[tuple] = []
        self.bytes = 0

    def _new(self) -> int:
        self.made += 1
        return self.first + self.made - 1

    def _send(self, rows: list[tuple], leftover: bool) -> None:
        for row in rows:
            self.rows.append((*row, leftover))
            self.bytes += len(row[3])

    def _put(self, slot: list, doc, start: int, ids: memoryview, total: int) -> None:
        slot[2].append((doc, start, len(ids) // 4, ids, total, slot[1], self.window - slot[0]))
        slot[0] -= len(ids) // 4

    def add(self, doc, ids: memoryview) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self._send([(doc, start, self.window, ids[4 * start : 4 * (start + self.window)], total, self._new(), 0)], False)
            start += self.window
        while start < total:
            rest = total - start
            best = min((s for s in self.open if s[0] >= rest), key=lambda s: s[0], default=None)
            if best is None and len(self.open) < self.limit:
                best = [self.window, self._new(), []]
                self.open.append(best)
            if best is not None:
                self._put(best, doc, start, ids[4 * start :], total)
                start = total
                if best[0] == 0:
                    self._close(best)
            else:
                fullest = min(self.open, key=lambda s: s[0])
                if fullest[0] >= self.least and rest - fullest[0] >= self.least:
                    end = start + fullest[0]
                    self._put(fullest, doc, start, ids[4 * start : 4 * end], total)
                    start = end
                self._close(fullest)

    def _close(self, slot: list) -> None:
        self.open = [s for s in self.open if s is not slot]
        self._send(slot[2], False)

    def finish(self) -> None:
        """Close the open windows: their pieces fill windows one after another; the last one is left over."""
        pieces = [p for slot in self.open for p in slot[2]]
        self.open = []
        slot = None
        for doc, start, length, ids, total, _, _ in pieces:
            at = 0
            while at < length:
                slot = slot or [self.window, self._new(), []]
                rest = length - at
                size = min(slot[0], rest)
                if 0 < rest - size < self.least:
                    size = rest - self.least
                if size < min(self.least, rest):
                    self._send(slot[2], False)
                    slot = None
                    continue
                self._put(slot, doc, start + at, ids[4 * at : 4 * (at + size)], total)
                at += size
                if slot[0] == 0:
                    self._send(slot[2], False)
                    slot = None
        if slot:
            self._send(slot[2], True)

    def take(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(map(bytes, c) if k == pa.binary() else c, type=k) for c, k in zip(columns, kinds, strict=True)], names=PIECES.fieldNames()
        )


def place(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, end_id: int = END_ID) -> DataFrame:
    """Tokenise and place; pieces of windows still open carry ``leftover``.

    One pass without a shuffle. ``tokenizer`` is the path of a byte-level BPE
    file that every executor has. ``ids``: little-endian unsigned 32-bit ids.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        part = _Partition(TaskContext.get().partitionId(), window, open_windows, min_piece)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part.add(doc, memoryview(encoder.encode(text.as_py() or "") + end))
                if part.bytes > 4_000_000:
                    yield part.take()
        part.finish()
        yield part.take()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def merge_leftovers(pieces: DataFrame, window: int = WINDOW, partitions: int = MERGE_PARTITIONS) -> DataFrame:
    """Merge the leftover windows of ``place``, whatever columns go along.

    ``pieces`` is written once to the shared folder, so that placing (which
    tokenises) isn't run again for the pieces and for the fill of the windows.
    Only the few leftover pieces are shuffled.
    """
    pieces = shared_table(pieces, "pieces")
    columns = [c for c in pieces.columns if c != "leftover"]
    left = pieces.filter("leftover").drop("leftover")

    def fit(rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows.column("window_id").to_pylist(), rows.column("fill").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
        bins: list[list[int]] = []  # [free, sequence id]
        out = []
        for name, fill in order:
            best = min((b for b in bins if b[0] >= fill), key=lambda b: b[0], default=None)
            if best is None:
                best = [window, name]
                bins.append(best)
            out.append((name, best[1], window - best[0]))
            best[0] -= fill
        return pa.table(dict(zip(("window_id", "merged_id", "base"), (pa.array(c, pa.int64()) for c in zip(*out, strict=True)), strict=True)))

    filled = left.groupBy(F.col("sequence_id").alias("window_id")).agg(F.sum("length").alias("fill"))
    filled = filled.withColumn("merge_group", F.shiftright("window_id", _SHIFT).cast("long") / partitions)
    merged = (
        filled.withColumn("merge_group", F.floor("merge_group"))
        .groupBy("merge_group")
        .applyInArrow(fit, "window_id long, merged_id long, base long")
    )
    moved = (
        left.join(merged, left.sequence_id == merged.window_id)
        .withColumn("sequence_id", F.col("merged_id"))
        .withColumn("offset", F.col("offset") + F.col("base"))
        .select(columns)
    )
    return pieces.filter("not leftover").select(columns).unionByName(moved)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, end_id: int = END_ID) -> DataFrame:
    """Pieces with their token ids, each in its place of a window.

    Columns: doc_id, start, length, ids, doc_tokens, sequence_id, offset.
    """
    return merge_leftovers(place(docs, tokenizer, id_col, text_col, window, open_windows, min_piece, end_id), window)


def in_stored_order(docs: DataFrame, rows: int = 200_000) -> DataFrame:
    """Rows of a table read from files, partitioned and sorted as they were written: by file name, then place in the file.

    Spark reads files in any order; a table whose order means something (as ``mixing.in_order`` writes it) is put
    back in order here. A table that isn't read from files comes out as it is.
    """
    file, row = fresh(docs, "file", "row")
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows))
    return placed.repartitionByRange(parts, file, row).sortWithinPartitions(file, row).drop(file, row)


def digests(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by its unsigned crc32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
