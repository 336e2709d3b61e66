"""The thirteen registered queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from materia.llm import conversations, decontamination, exact_dedup, extraction, filter_audit, langid, media, mixing, packing, pii, quality, simhash, toxicity
from materia.llm.common import crc_mod, load


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.place(load(spark, sf_dir, "documents"), byte_bpe())
    return packing.merge_leftovers(packing.digests(pieces)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.concat_ws(" ", "toxic_terms").alias("terms"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fit(docs, load(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality.score(docs, machine).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_shares(docs)).drop("mix_source")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(load(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "wrapper")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("pii_base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in pii.BASE]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    return found.select("doc_id", *counts, F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, payloads = media.text_and_media(load(spark, sf_dir, "documents"))
    stored = media.features(media.store(payloads))
    pages = media.sequences(documents).select("doc_id", "n_bytes", "items")
    return media.resolve(pages, stored, ["doc_id", "n_bytes"]).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_repeats(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filter_audit.text_flags(load(spark, sf_dir, "documents"))
    marked = filter_audit.with_marks(flags, load(spark, sf_dir, "labels"), {"good": "quality", "toxic": "toxic"})
    return filter_audit.audit(marked, list("ABCDE"), ["good", "toxic"]).drop("filter")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.turns_in_order(load(spark, sf_dir, "conversations"))
    return conversations.prefix_trie(*conversations.shared_beginnings(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_packing, op2_toxicity, op3_quality, op4_mixing, op5_simhash, op6_extraction, op7_language, op8_personal_data, op9_media, op10_exact_dedup,
        op11_decontamination, op12_filter_audit, op13_conversation_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_decontamination": decontamination.ORACLE, "op12_filter_audit": filter_audit.ORACLE,
        "op13_conversation_trie": conversations.ORACLE,
    }
