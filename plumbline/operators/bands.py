"""Joins of points with bands of lines.

Lines are cut into bins of BIN; a band has a row for each bin it touches, a point lies in one.  So the
join is on equal keys and bins, a file with very many points or bands is spread over its bins, and a
point meets the bands of its bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256


def binned(bands: DataFrame, first: str = "first_line", last: str = "last_line") -> DataFrame:
    """A row for each bin a band touches, in ``__bin``; bands that are null or empty have none."""
    held = bands.where((F.col(first) <= F.col(last)) & (F.col(last) - F.col(first) >= 0))
    return held.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.col(last) / BIN))))


def join(points: DataFrame, bands: DataFrame, on: Column, at: str = "line", first: str = "first_line", last: str = "last_line", how: str = "inner") -> DataFrame:
    """Points (alias ``p``) with bands (alias ``b``) that hold them, where ``on``, over both aliases,
    holds too.  For ``left_semi`` and ``left_anti`` only the points' columns."""
    p = points.withColumn("__bin", F.floor(F.col(at) / BIN)).alias("p")
    b = binned(bands, first, last).alias("b")
    hit = (F.col("p.__bin") == F.col("b.__bin")) & F.col(f"p.{at}").between(F.col(f"b.{first}"), F.col(f"b.{last}"))
    return p.join(b, on & hit, how).drop(F.col("p.__bin")) if how in ("left_semi", "left_anti") else p.join(b, on & hit, how)


def overlapping(a: DataFrame, b: DataFrame, on: Column, first: str = "first_line", last: str = "last_line") -> DataFrame:
    """Rows of ``a`` (alias ``p``) whose band meets one of ``b`` (alias ``b``), once for each row of
    ``a``; ``a`` must carry a column ``key`` that tells its rows apart."""
    x, y = binned(a, first, last).alias("p"), binned(b, first, last).alias("b")
    meets = (F.col("p.__bin") == F.col("b.__bin")) & (F.col(f"p.{first}") <= F.col(f"b.{last}")) & (F.col(f"b.{first}") <= F.col(f"p.{last}"))
    hit = x.join(y, on & meets, "left_semi").select("key").distinct()
    return a.join(hit, "key", "left_semi")
