"""Typst packages from a table of files: one row per folder with a manifest.

Defined results: a manifest that is no TOML gives an error and null fields; a field of another type is
missing; files of a package are those right in its folder.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.facts import SPAN
from plumbline.functions import paths
from plumbline.lang.lexer import Places

TEXTS = ("name", "version", "entrypoint", "license", "description")
_FIELDS = ", ".join(f"{t} string" for t in TEXTS)
_MANIFEST = f"root string, {_FIELDS}, authors array<string>, exclude array<string>, spans struct<name:{SPAN},version:{SPAN},license:{SPAN},description:{SPAN}>, error string"


def manifest(text: str) -> dict[str, Any]:
    """The fields of ``[package]`` and the places of their values."""
    out: dict[str, Any] = {"authors": None, "exclude": None, "spans": None, "error": None} | dict.fromkeys(TEXTS)
    try:
        held = tomllib.loads(text).get("package", {})
    except tomllib.TOMLDecodeError as e:
        return out | {"error": str(e)}
    for t in TEXTS:
        out[t] = held.get(t) if isinstance(held.get(t), str) else None
    for t in ("authors", "exclude"):
        out[t] = [x for x in held[t] if isinstance(x, str)] if isinstance(held.get(t), list) else None
    places = Places(text)
    section = re.search(r"^\s*\[package\][^\n]*\n(.*?)(?=^\s*\[|\Z)", text, re.S | re.M)
    spans: dict[str, Any] = {}
    for t in ("name", "version", "license", "description"):
        m = re.search(rf"^[ \t]*{t}[ \t]*=[ \t]*(\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')", section[1], re.M) if section else None
        spans[t] = places.span(section.start(1) + m.start(1), section.start(1) + m.end(1)) if m else None
    return out | {"spans": spans}


def packages(files: DataFrame) -> DataFrame:
    """root, the manifest's fields and places, version_dir (of preview/<name>/<version>), readme,
    has_license, has_changelog, pdfs of every folder with a ``typst.toml``, from (path, text)."""

    schema = to_arrow_schema(StructType.fromDDL(_MANIFEST))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"root": r} | manifest(t or "") for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    held = files.where("path IS NOT NULL").withColumn("root", paths.dirname(F.col("path"))).withColumn("file", paths.basename(F.col("path")))
    own = held.where("file = 'typst.toml'").select("root", F.col("text").cast("string").alias("text")).mapInArrow(rows, _MANIFEST)
    named = held.where(F.col("file").isin("README.md", "LICENSE", "CHANGELOG.md") | F.lower("file").endswith(".pdf"))
    beside = named.groupBy(F.col("root").alias("__r")).agg(
        F.max(F.when(F.col("file") == "README.md", F.coalesce("text", F.lit("")))).alias("readme"),
        F.bool_or(F.col("file") == "LICENSE").alias("has_license"),
        F.bool_or(F.col("file") == "CHANGELOG.md").alias("has_changelog"),
        F.array_sort(F.collect_set(F.when(F.lower("file").endswith(".pdf"), F.col("file")))).alias("pdfs"),
    )
    met = own.join(beside, F.col("root") == F.col("__r"), "left").drop("__r")
    no = lambda c: F.coalesce(c, F.lit(False))
    return met.withColumns({"has_license": no("has_license"), "has_changelog": no("has_changelog"), "pdfs": F.coalesce("pdfs", F.array().cast("array<string>")), "version_dir": F.nullif(F.regexp_extract("root", r"(?:\A|/)preview/[^/]+/([^/]+)\z", 1), F.lit(""))})
