"""What the operators share: the shared folder, written cut points, small expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from plumbline.cut import finished, mark, new_path, release, shared_dir, written

__all__ = ["finished", "mark", "new_path", "release", "shared_dir", "written"]

#: Blanks of all contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``; an alias inside lambdas
    would be expanded at each use."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of non-blanks, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def n_words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def with_field(schema: StructType, name: str, kind: DataType) -> StructType:
    """The schema with the column, which replaces one of that name (names compare without case)."""
    return StructType([f for f in schema.fields if f.name.lower() != name.lower()] + [StructField(name, kind)])
