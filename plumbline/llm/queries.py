"""The operators over the driver's tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, written


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.site_quality import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.matroska import store

    return store(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality_rules import judge

    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.pii import find, span_list

    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("pii_spans")
    base = ("email", "ip", "card", "phone")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(span_list(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.chat import branch_pairs, mask_text, preferences

    made = preferences(branch_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return made.select("pair_id", "status", "prompt_turns", "prompt", "chosen", mask_text(F.col("chosen_mask")).alias("chosen_mask"), "rejected", mask_text(F.col("rejected_mask")).alias("rejected_mask"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import bpe, sstable

    docs = documents(spark, sf_dir)
    shards = written(sstable.write(docs, sstable.shard_path(docs), bpe.default_path()), "shards")
    found = sstable.lookup(shards, docs.where("doc_id % 50 = 0")).groupBy(F.col("doc_id").alias("wanted"))
    found = found.agg(F.sum("n_tokens").alias("lookup_tokens"), F.bit_xor("ids_crc32").alias("lookup_crc32"))
    return sstable.read(shards).join(found, F.col("doc_id") == F.col("wanted"), "left").drop("wanted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import bpe, packing

    return packing.pack(documents(spark, sf_dir), bpe.default_path())


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.hmm import score

    return score(documents(spark, sf_dir))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=4, percent=80)


# what SQL can say of operators that it cannot express as a whole


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of the payloads that op5 reads back from its files."""
    return op5_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind op8 finds."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score that op9 gives beside the model's."""
    return op9_hmm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 1).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_preferences, op2_sstable, op3_mixing, op4_site_quality, op5_matroska, op6_quality_rules, op7_packing, op8_pii, op9_hmm, op10_near_duplicates, media_payloads, pii_counts, unigram_scores)
}
