"""Exact deduplication with two passes of Bloom filtering, in DataFrame operations only.

Pass one puts the hash of every text into a counting filter: words of 15
counters of four bits, as many words as rows, filled by tasks and merged by
adding words. A counter that is two or more, and any word whose counters ran
over, marks a text as possibly repeated; the marked counters alone, as words of
15 bits, are the filter of pass two. It grows with the repeated texts and is
broadcast while its measured size is at most ``filter_bytes``; a larger one
meets the rows by a shuffle on the word. Rows that pass two rejects are unique
and go straight through, unshuffled; only the others are grouped, by their
SHA-256. What the filter lets through in excess changes no result.

Groups of more than one in ``HOT`` of all rows (so fewer than ``HOT`` groups)
are broadcast to their rows; the rows of the other groups meet theirs by a
shuffle, so no group gathers in one task.

Defined results: a null text equals an empty one; a null id is smaller than any
other; of rows that repeat both id and text one stays, any of them; an empty
table gives no rows; columns of the input keep their names and values, but for
those named as a result column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from materia.llm.common import fresh, shared_table

#: Most bytes of the filter of pass two that are broadcast; its rows are counted first.
FILTER_BYTES = 64_000_000
_WORD_BYTES = 48
COUNTERS = 15
#: A group of more rows than all rows divided by this is hot.
HOT = 1000

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def _word(content, words: int):
    return F.pmod(F.xxhash64(content), F.lit(words))


def _counter(content):
    return F.pmod(F.shiftrightunsigned(F.xxhash64(content, F.lit("counter")), 8), F.lit(COUNTERS)).cast("int")


def repeated_filter(texts: DataFrame, rows: int) -> DataFrame:
    """(word, bits): the counters of two or more over a column ``content``, for a filter of ``rows`` words."""
    placed = texts.select(_word(F.col("content"), max(1, rows)).alias("word"), _counter(F.col("content")).alias("counter"))
    filled = placed.groupBy("word").agg(F.try_sum(F.expr("shiftleft(1L, 4 * counter)")).alias("counts"), F.count("*").alias("n"))
    counts = [F.expr(f"shiftrightunsigned(counts, {4 * i}) & {15 if i < COUNTERS - 1 else 127}") for i in range(COUNTERS)]
    bits = sum((F.when(c >= 2, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(counts)), F.lit(0))
    whole = F.col("counts").isNotNull() & (sum(counts, F.lit(0)) == F.col("n"))
    return filled.select("word", F.when(whole, bits).otherwise(F.lit((1 << COUNTERS) - 1)).alias("bits")).filter("bits != 0")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept, text_sha256."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.count()
    bloom = shared_table(repeated_filter(docs.select(content.alias("content")), rows), "filter")
    small = bloom.count() * _WORD_BYTES <= filter_bytes
    sha, word, counter, bits, again, most, size, copies, part, first, second = fresh(docs, "sha", "word", "counter", "bits", "again", "most", "size", "copies", "part", "first", "second")
    bloom = bloom.toDF(word, bits)
    passed = F.coalesce(F.getbit(bits, F.col(counter)) == 1, F.lit(False))
    # all that is made of a text is made before the join: where the text itself isn't asked for, no shuffle has it
    marked = docs.withColumns({word: _word(content, max(1, rows)), counter: _counter(content), sha: F.sha2(content, 256)})
    seen = marked.join(F.broadcast(bloom) if small else bloom, word, "left").withColumn(again, passed).drop(word, bits, counter)

    # of each text that repeats: its largest id, its rows, and its rows with that id
    each = seen.filter(again).groupBy(sha, F.col(id_col).alias(most)).agg(F.count("*").alias(copies))
    top = F.max(F.struct(most, copies))
    groups = each.groupBy(sha).agg(top.alias("top"), F.sum(copies).alias(size)).filter(F.col(size) > 1)
    groups = shared_table(groups.select(sha, f"top.{most}", f"top.{copies}", size), "groups")
    is_hot = F.col(size) * HOT > rows
    with_hot = seen.join(F.broadcast(groups.filter(is_hot)), sha, "left")
    settled = ~F.col(again) | F.col(size).isNotNull()
    shuffled = with_hot.filter(~settled).drop(most, copies, size).join(groups.filter(~is_hot), sha, "left")
    every = with_hot.filter(settled).unionByName(shuffled)

    repeats = F.col(size).isNotNull()
    result = every.withColumns({
        "keep_id": F.when(repeats, F.col(most)).otherwise(F.col(id_col)), "group_size": F.coalesce(F.col(size), F.lit(1).cast("long")),
        "kept": ~repeats | F.col(id_col).eqNullSafe(F.col(most)), "text_sha256": F.col(sha),
    })
    columns = [*docs.columns, *ADDED]
    several = repeats & (F.col(copies) > 1) & F.col("kept")
    if groups.filter(F.col(copies) > 1).isEmpty():
        return result.select(columns)
    # rows that repeat the id as well: the first of each partition, and the first of those
    tied = result.filter(several).withColumn(part, F.spark_partition_id())
    tied = tied.withColumn(first, F.row_number().over(Window.partitionBy(sha, part).orderBy(F.lit(0))))
    alone = F.when(F.col(first) > 1, F.struct(part, first))
    tied = tied.withColumn(second, F.row_number().over(Window.partitionBy(F.col(sha), alone).orderBy(F.lit(0))))
    tied = tied.withColumn("kept", (F.col(first) == 1) & (F.col(second) == 1))
    return result.filter(~several).select(columns).unionByName(tied.select(columns))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies that ``find_repeats`` drops; columns that have the name of a result stay."""
    clash = [c for c in docs.columns if c.lower() in ADDED]
    held = dict(zip(clash, fresh(docs, *(f"held_{i}" for i in range(len(clash)))), strict=True))
    found = find_repeats(docs.withColumnsRenamed(held), held.get(id_col, id_col), held.get(text_col, text_col)).filter("kept")
    return found.select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
