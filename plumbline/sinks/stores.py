"""Findings kept for later runs: baselines, trends, stored runs, edits of texts.

Defined results: a baseline holds each key as often as it occurs; an edit whose span is not inside its
text is skipped; overlapping edits are applied one after the other from the end; a stored run is
found by its key alone and never changes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.sources.config import BASELINE_VERSION


def baseline_rows(findings: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """file, check_id, rule_signature: the key of each finding, its signature from the text of its span
    with blanks collapsed, so that moved lines keep it."""
    text = files.select(F.col("path").alias("__p"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("__t"))
    met = findings.join(text, F.col("file") == F.col("__p"), "left")
    held = F.substr("__t", F.col("span.start_byte") + 1, F.col("span.end_byte") - F.col("span.start_byte"))
    shown = F.coalesce(F.make_valid_utf8(held.cast("string")), F.lit(""))
    return met.select(paths.relative(F.col("file"), root).alias("file") if root else paths.normal(F.col("file")).alias("file"), "check_id", paths.signature(shown).alias("rule_signature"))


def write_baseline(rows: DataFrame, path: str) -> int:
    """One versioned JSON file on the driver's disk, in order of file, check, signature.  Rows come
    one partition at a time; returns their number."""
    ordered = rows.select("file", "check_id", "rule_signature").orderBy("file", "check_id", "rule_signature")
    n = 0
    held = f"{path}.{os.getpid()}.tmp"
    with open(held, "w", encoding="utf-8") as f:
        f.write('{"version": %d, "findings": [' % BASELINE_VERSION)
        for r in ordered.toLocalIterator():
            f.write(("," if n else "") + "\n" + json.dumps(r.asDict(), ensure_ascii=False))
            n += 1
        f.write("\n]}\n")
    os.replace(held, path)
    return n


def append_trend(findings: DataFrame, path: str, date: str) -> None:
    """date, category, count of a run, added to the JSON lines below ``path``."""
    rows = findings.groupBy(F.lower(paths.category(F.col("check_id"))).alias("category")).agg(F.count("*").alias("count"))
    rows.select(F.lit(date).alias("date"), "category", "count").coalesce(1).write.mode("append").json(path)


def store_run(findings: DataFrame, folder: str, key: str) -> None:
    """The findings of a run under its key (a hash of files, rules and options), as Parquet, whose
    dictionaries hold repeated texts once.  Written beside, then moved in one step."""
    spark = findings.sparkSession
    held = f"{folder}/.{key}.tmp"
    findings.write.mode("overwrite").parquet(held)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(held).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{folder}/{key}"), True)
    if not fs.rename(path(held), path(f"{folder}/{key}")):
        raise OSError(f"{folder}/{key} could not be stored")


def stored_run(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """The findings under a key, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{key}/_SUCCESS")
    return spark.read.parquet(f"{folder}/{key}") if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def edit(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with (start, end, new) in bytes, from the last to the first."""
    raw = text.encode("utf-8", "surrogatepass")
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if not 0 <= start <= end <= len(raw):
            continue
        cut = raw[:start] + new.encode() + raw[end:]
        try:
            cut.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            continue  # inside a character
        raw = cut
    return raw.decode("utf-8", "surrogatepass")


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text, n_edits of the files (path, text) with edits (file, start_byte, end_byte, text), one
    row per file that has any: one file's edits meet in its row."""
    one = F.struct("start_byte", "end_byte", F.coalesce(F.col("text"), F.lit("")).alias("new"))
    held = edits.groupBy(F.col("file").alias("__f")).agg(F.collect_list(one).alias("edits"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths_, texts_, lists = (c.to_pylist() for c in batch.columns)
            new = [edit(t or "", [(e["start_byte"], e["end_byte"], e["new"]) for e in es]) for t, es in zip(texts_, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths_, pa.string()), pa.array(new, pa.string()), pa.array([len(es) for es in lists], pa.int64())], ["path", "text", "n_edits"])

    met = files.join(held, F.col("path") == F.col("__f")).select("path", F.col("text").cast("string").alias("text"), "edits")
    return met.mapInArrow(rows, "path string, text string, n_edits long")
