"""A corpus pipeline over ``documents``: five stages, each one operator of ``materia.llm``.

Each stage takes the documents its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``. The table of a
stage is deleted once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from materia.llm import exact_dedup, langid, mixing, near_dedup, packing
from materia.llm.common import delete_at_exit, delete_now, load, shared_dir
from materia.llm.queries import byte_bpe


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid model rejects go.

    Null and empty texts, and those without a letter, are rejected; copies are judged alike; an empty table stays empty.
    """
    return langid.keep_known(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null and empty texts are equal; a null id is the smallest; of rows equal in id and text one stays.
    """
    return exact_dedup.drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles of Jaccard similarity 0.8 the smallest doc_id stays.

    Texts without words are alike; documents with a null id are in no group and stay.
    """
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixing schedule, in which the packing stage reads them.

    A null source is one of its own; repeated rows keep one place each.
    """
    return mixing.in_order(docs, mixing.tempered_shares(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of tokens, with their ids, numbered in the order in which the mix was stored.

    A null text is its end token alone; repeated rows are packed once each.
    """
    return packing.pack(packing.in_stored_order(docs), byte_bpe())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express the learned classifier or the tokenizer; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What the last one returns reads only tables of its own."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    before = None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete_now(spark, before)
            before = path
    return docs
