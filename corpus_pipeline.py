"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before kept, written as Parquet and read again.  Results defined for
all stages: an empty table gives an empty one; a null text counts as empty; rows without doc_id are
kept or dropped by their text like others; columns beyond those of ``documents`` are carried up to
the last stage, whatever their names; rows that repeat count each, but for copies, of which one
stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, near_dup, packing, pii, quality_rules
from plumbline.llm.common import documents, mark, release, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; an empty text is rejected, a long one is not."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that with the smallest doc_id (null last),
    of those the one whose text hashes lowest.  Rows go by a key of their own, so that those which
    repeat a doc_id, or have none, are judged each by its text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), row), "keyed")
    found = near_dup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text"), width=5, percent=80)
    # only groups of several rows are ordered; the others stay as they are
    found = written(found.select(F.col("doc_id").alias("key"), "component_id"), "groups")
    several = written(found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "large-groups")
    grouped = written(found.join(several, "component_id", "left_semi"), "grouped")
    place = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("doc_id"), F.sha2("row.text", 256).alias("text"), "key")
    placed = grouped.join(keyed.select("key", place.alias("place")), "key")
    first = written(placed.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.key").alias("key")), "first")
    dropped = written(grouped.join(first, "key", "left_anti").select("key"), "dropped")
    return keyed.join(dropped, "key", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; ``n_chars`` counts the new text (null for
    a null one)."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, each taken whole; blanks never."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places in the training sequences.  A row per piece: the
    columns of ``documents`` but doc_id end here."""
    return packing.pack(docs, bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("mixed", mixed),
    ("packed", packed),
]

#: Tokens and similar sets have no SQL form; tests/llm/test_whole_pipeline.py holds the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """All stages over ``documents``.  With ``resume``, a folder that driver and executors share,
    each stage's rows stay there, and a run that failed goes on after the last stage that ended."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        last = k == len(STAGES) - 1
        kept = f"{resume.rstrip('/')}/{k}-{name}" if resume and not last else None
        if kept and _ended(spark, kept):
            docs = spark.read.parquet(kept)
            continue
        since = mark(spark)
        docs = stage(spark, docs, sf_dir)
        if last:
            break
        if kept:
            schema = docs.schema
            docs.write.mode("overwrite").option("compression", "zstd").parquet(kept)
            docs = spark.read.schema(schema).parquet(kept)
            release(spark, since)
        else:
            docs = written(docs, name)
            release(spark, since, keep=1)  # what the stage wrote on its way
    return docs


def _ended(spark: SparkSession, path: str) -> bool:
    mark_of_end = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark_of_end.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark_of_end)
