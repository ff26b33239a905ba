"""Connected components of an edge table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a, b) that has a link to another; label is the smallest
    id reachable.  Links with a null end and links of an id with itself count for nothing; repeated
    links count once; an empty table gives an empty one."""
    return graph.components(edges.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
