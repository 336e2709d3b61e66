"""Media columns: interleaved document sequences with stored, resolved payloads.

An HTML document becomes an ordered array of structs, text and media reference
in turn, each with its position; a reference names its payload by digest and
carries the caption of its figure. Payloads are stored once as lossless 8-bit
greyscale PNG images in a table keyed by digest; a join on the digest resolves
references against what is read back from that table.

Defined results: a null document is an empty one (no items), a null text an
empty payload of one row of padding; equal payloads share a digest and all
that is computed from it; a reference without a stored payload resolves to
nulls; a caption goes to all references of its figure that have none yet, a
caption outside a figure to the last reference; repeated rows come out
repeated; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from materia.llm.common import add_from_text, fresh, shared_table, small_batches

WIDTH = 576
PADDING = 255
#: A digest of more references than all divided by this is hot.
HOT = 1000
_MAGIC = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"

# Tags that begin or end a block of text.
_BLOCKS = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p "
    "pre section table td th tr ul".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>]*)>", re.DOTALL | re.IGNORECASE)
_SOURCE = re.compile(r"""\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_MEDIA = re.compile(r"(?:media|sha256):([0-9a-f]{64})$")


def payload(text: Column, width: int = WIDTH) -> Column:
    """UTF-8 bytes of a text, padded with 255 to a positive multiple of ``width``."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    fill = F.when(F.octet_length(raw) == 0, F.lit(width)).otherwise(F.pmod(-F.octet_length(raw), F.lit(width)))
    return F.concat(raw, F.unhex(F.repeat(F.lit(f"{PADDING:02X}"), fill.cast("int"))))


def encode_png(data: bytes, width: int = WIDTH) -> bytes:
    """8-bit greyscale, one byte of payload a sample, no row filter."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    body = np.zeros((len(rows), width + 1), np.uint8)
    body[:, 1:] = rows
    chunk = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    """The samples of an image that ``encode_png`` made; every checksum is verified."""
    if image[:8] != _MAGIC:
        raise ValueError("not a PNG image")
    at, width, packed = 8, 0, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, content = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + content) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", content)[0]
        elif kind == b"IDAT":
            packed.append(content)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(data: bytes) -> str:
    """Mean and deviation of the samples, and an average hash of 64 stretches of them."""
    samples = np.frombuffer(data, np.uint8)
    edges = np.linspace(0, len(samples), 65).astype(np.int64)
    sums = np.add.reduceat(samples.astype(np.int64), edges[:-1])
    means = sums / np.diff(edges)
    bits = np.packbits(means > samples.mean())
    return f"{samples.mean():.4f}:{samples.std():.4f}:{bits.tobytes().hex()}"


def store(payloads: DataFrame, digest_col: str = "digest", payload_col: str = "payload") -> DataFrame:
    """Write (digest, media) to a table in the shared folder and return it read back.

    Rows are stored where they are read; payloads are never shuffled, so copies
    of one are stored by each task that has them (``features`` takes one).
    """
    small_batches(payloads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[str, int] = {}
            for i, d in enumerate(batch.column(0).to_pylist()):
                first.setdefault(d, i)
            media = [encode_png(batch.column(1)[i].as_py()) for i in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    rows = payloads.select(F.col(digest_col).alias("digest"), F.col(payload_col).alias("payload"))
    return shared_table(rows.mapInArrow(run, "digest string, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """One row per digest, all from the stored bytes: sizes, digests, tail checksum, feature."""
    small_batches(media.sparkSession)
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = image.as_py()
                data = decode_png(image)
                rows.append((d, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(data)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    made = media.select("digest", "media").mapInArrow(
        run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return made.groupBy("digest").agg(*(F.min(n).alias(n) for n in names[1:]))


def sequence_of(document: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, "text" or "media", text, digest, caption) of one HTML document, in order."""
    items: list[list] = []
    words: list[str] = []
    figure: int | None = None  # where the open figure's items begin
    caption: list[str] | None = None

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            items.append(["text", text, None, None])

    document = document or ""
    at = 0
    for m in _TAG.finditer(document):
        (words if caption is None else caption).append(entities.unescape(document[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        name, closing = m[3].lower(), bool(m[2])
        if name == "figcaption":
            if not closing:
                flush()
                caption = []
            elif caption is not None:
                text = " ".join("".join(caption).split())
                caption = None
                for item in items[figure if figure is not None else max(0, len(items) - 1) :]:
                    if item[0] == "media" and item[3] is None:
                        item[3] = text
        elif name == "img" and not closing:
            flush()
            source = _SOURCE.search(m[4])
            target = next((g for g in source.groups() if g is not None), "") if source else ""
            digest = _MEDIA.search(entities.unescape(target))
            items.append(["media", None, digest[1] if digest else None, None])
        elif name == "br":
            words.append(" ")
        elif name in _BLOCKS and caption is None:
            flush()
            if name == "figure":
                figure = None if closing else len(items)
    (words if caption is None else caption).append(entities.unescape(document[at:]))
    if caption is not None:
        words.extend(caption)
    flush()
    return [(i, *item) for i, item in enumerate(items)]


def sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the column ``items``, the interleaved sequence of each document."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    names = ("position", "kind", "text", "digest", "caption")

    def make():
        return lambda texts: [pa.array([[dict(zip(names, x, strict=True)) for x in sequence_of(t)] for t in texts], kind)]

    return add_from_text(pages, html_col, make, f"items {ITEMS}")


def resolve(pages: DataFrame, resolved: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each media reference: columns ``keep`` of its document, position, caption, and what its digest resolves to.

    A digest of more than one in ``HOT`` of all references (so fewer than ``HOT`` digests) is broadcast to them; the
    other references meet theirs by a shuffle, so no task gets all copies of one payload.
    """
    (ref,) = fresh(pages, "ref")
    refs = pages.select(*keep, F.explode(F.filter("items", lambda x: x.kind == "media")).alias(ref))
    refs = refs.select(*keep, F.col(f"{ref}.position").alias("position"), F.col(f"{ref}.caption").alias("caption"), F.col(f"{ref}.digest").alias("digest"))
    refs, resolved = shared_table(refs, "refs"), shared_table(resolved, "resolved")
    rows = refs.count()
    sizes = refs.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    hot = shared_table(sizes.filter(F.col("n") * HOT > rows).select("digest"), "hot")
    known = resolved.join(F.broadcast(hot), "digest", "left_semi")
    warm = refs.join(F.broadcast(hot), "digest", "left_semi").join(F.broadcast(known), "digest", "left")
    return warm.unionByName(refs.join(F.broadcast(hot), "digest", "left_anti").join(resolved, "digest", "left"))


def text_and_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each text as an HTML document that shows its payload as a figure after the text; and its payload by digest."""
    data = payload(F.col(text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    digest = F.sha2(data, 256)
    page = F.concat(
        F.lit("<article><p>"), safe, F.lit('</p><figure><img src="media:'), digest, F.lit('"><figcaption>document '),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"),
    )
    documents = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), page.alias("html"))
    return documents, docs.select(digest.alias("digest"), data.alias("payload"))
