"""Duplicates, outliers and majorities.

Defined results: null names, values and groups count for nothing where a name or value is asked for,
and are a group of their own in ``local_majority``; repeated rows count each; empty tables give empty
ones.  Statistics of a whole table are scalar subqueries: no job runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_names(rows: DataFrame, name: str, *place: str) -> DataFrame:
    """Names that occur at least twice: the first place, the number of others, and those."""
    one = F.struct(*place)
    found = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), F.min(one).alias("p")).where("n >= 2")
    return found.select(name, *[F.col(f"p.{c}").alias(c) for c in place], (F.col("n") - 1).alias("n_related"))


def related_places(rows: DataFrame, name: str, *place: str) -> DataFrame:
    """The other places of names that occur at least twice, one row each with its rank (the first
    place of a name has rank 0 and is left out).  Only duplicated names are ordered; a name's places
    are ranked in one task, so a name with very many places costs one sort."""
    from pyspark.sql import Window

    twice = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__n")).where("__n >= 2").select(name)
    w = Window.partitionBy(name).orderBy(*place)
    held = rows.join(twice, name, "left_semi").withColumn("rank", F.row_number().over(w) - 1)
    return held.where("rank > 0").select(name, *place, F.col("rank").cast("long").alias("rank"))


def outliers(rows: DataFrame, value: str, sigmas: float = 3.0, least_rows: int = 8, least_value: float = 8.0) -> DataFrame:
    """Rows above mean + ``sigmas`` sample deviations, at least ``least_value``; none where there
    are fewer than ``least_rows`` rows or no spread.  Adds mean, sd and threshold."""
    x = F.col(value).cast("double")
    s = F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    held = rows.withColumn("__s", rows.agg(s).scalar())
    mean, sd = F.col("__s.mean"), F.col("__s.sd")
    limit = mean + sigmas * sd
    out = held.withColumns({"mean": mean, "sd": sd, "threshold": limit})
    return out.where((F.col("__s.n") >= least_rows) & (sd > 0) & (x > limit) & (x >= least_value)).drop("__s")


def local_majority(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """By group: votes for and against, and the strict majority (more than half by integer
    division, and more than the other side), null where there is none."""
    votes = rows.groupBy(group).agg(F.count_if(value).alias("yes"), F.count_if(~value).alias("no"))
    half = F.floor((F.col("yes") + F.col("no")) / 2)
    verdict = F.when((F.col("yes") > half) & (F.col("yes") > F.col("no")), F.lit(True)).when((F.col("no") > half) & (F.col("no") > F.col("yes")), F.lit(False))
    return votes.withColumn("majority", verdict)


def corpus_majority(rows: DataFrame, value: str, least: int = 8, pinned: str | None = None) -> DataFrame:
    """All values with their counts; ``is_majority`` for one with over half of at least ``least``,
    or, where one is ``pinned``, for that one, however often it occurs."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    if pinned is not None:
        return counts.withColumn("is_majority", F.col(value) == pinned)
    total = rows.agg(F.count(value)).scalar()
    return counts.withColumn("__t", total).withColumn("is_majority", (F.col("__t") >= least) & (F.col("n") > F.floor(F.col("__t") / 2))).drop("__t")


def fans(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, fan_in, fan_out: one count per edge row of (src, dst); with ``nodes`` (id), also those
    without edges."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.where("id IS NOT NULL").groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def nearest_rank(rows: DataFrame, value: str, percent: float) -> Column:
    """The percentile by nearest rank, as a scalar: the smallest value that at least ``percent`` of
    the values do not exceed.

    An estimate gives a narrow band of values around it.  Counts below and in the band tell in which
    of the three parts the rank lies (however good the estimate), and only that part's values are
    counted up in order, so that no task gets the values of the table."""
    from pyspark.sql import Window

    part, x = percent / 100.0, F.col(value)
    near = F.percentile_approx(x, [max(0.0, part - 0.001), min(1.0, part + 0.001)], 10_000)
    s = rows.agg(F.struct(F.count(x).alias("n"), near.alias("band"))).scalar()
    held = rows.select(x.alias("x")).where("x IS NOT NULL").withColumn("s", s)
    side = F.when(F.col("x") < F.col("s.band")[0], 0).when(F.col("x") <= F.col("s.band")[1], 1).otherwise(2)
    sided = held.select("x", F.col("s.n").alias("n"), side.alias("side"))
    counts = sided.agg(F.struct(F.count_if(F.col("side") == 0).alias("below"), F.count_if(F.col("side") == 1).alias("within"))).scalar()
    met = lambda c: c / F.col("n") >= part
    below, upto = F.col("c.below"), F.col("c.below") + F.col("c.within")
    mine = F.when((below > 0) & met(below), 0).when((F.col("c.within") > 0) & met(upto), 1).otherwise(2)
    before = F.when(mine == 0, 0).when(mine == 1, below).otherwise(upto)
    own = sided.withColumn("c", counts).where(F.col("side") == mine).groupBy("x", "n", before.alias("before")).agg(F.count("*").alias("k"))
    ranked = own.withColumn("upto", F.col("before") + F.sum("k").over(Window.orderBy("x")))
    return ranked.agg(F.min(F.when(met(F.col("upto")), F.col("x")))).scalar()
