"""Scopes and intervals.

Defined results: rows that repeat are kept each; a null file or place meets nothing; empty tables
give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import bands


def enclosing_scope(points: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """For each point (file, at) the innermost scope (file, scope, first, last) that holds it, else
    the nearest one that starts after it.  What a point gets depends on its file and place only, so
    it is found once for each of those, and points that share a key keep a row each.

    The second is an as-of join in two steps, so that no file is sorted in one task: the next start
    within the point's bin of lines, else the first start of the bins after it."""
    places = points.select("file", "at").where("file IS NOT NULL AND at IS NOT NULL").distinct()
    inside = bands.join(places, scopes, F.col("p.file") == F.col("b.file"), "at", "first", "last")
    best = inside.groupBy(F.col("p.file").alias("file"), F.col("p.at").alias("at")).agg(F.min(F.struct((F.col("b.last") - F.col("b.first")).alias("width"), F.col("b.first"), F.col("b.scope"))).alias("x"))
    # of scopes with one start, the smallest id; a start at the point itself does not follow it
    starts = scopes.where("first IS NOT NULL").groupBy("file", F.col("first").cast("long").alias("first")).agg(F.min("scope").alias("scope"))
    one = F.struct("first", "scope")
    nothing = F.lit(None).cast(starts.select(one.alias("s")).schema["s"].dataType)
    bin_of = lambda c: F.floor(F.col(c) / bands.BIN)
    marks = places.select("file", F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), nothing.alias("s")).unionByName(starts.select("file", F.col("first").alias("at"), F.lit(0).alias("kind"), one.alias("s")))
    marks = marks.withColumn("bin", bin_of("at"))
    later = Window.partitionBy("file", "bin").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = marks.withColumn("next", F.last("s", ignorenulls=True).over(later)).where("kind = 1")
    near = near.withColumn("next", F.when(F.col("next.first") > F.col("at"), F.col("next")))
    firsts = marks.groupBy("file", "bin").agg(F.min("s").alias("s"))
    after = Window.partitionBy("file").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    beyond = firsts.select("file", "bin", F.first("s", ignorenulls=True).over(after).alias("beyond"))
    found = near.join(beyond, ["file", "bin"]).select("file", "at", F.coalesce("next.scope", "beyond.scope").alias("next"))
    held = found.join(best.select("file", F.col("at").cast("long").alias("at"), F.col("x.scope").alias("inside")), ["file", "at"], "left")
    held = held.select(F.col("file").alias("__f"), F.col("at").alias("__a"), "inside", "next")
    joined = points.join(held, (F.col("file") == F.col("__f")) & (F.col("at") == F.col("__a")), "left")
    return joined.select(points[key], F.coalesce("inside", "next").alias("scope"), F.when(F.col("inside").isNotNull(), F.lit("inside")).when(F.col("next").isNotNull(), F.lit("next")).alias("how"))


def drop_self_overlap(starts: DataFrame, width: int, *group: str) -> DataFrame:
    """Of places (group, at) keeps those at least ``width`` after the last kept one of their group.

    Kept places are found by runs: only within a run of places closer than ``width`` does the choice
    depend on what was kept before, and a run is folded by itself, with its last kept place and the
    list of those kept, which grows by a block at a time."""
    w = Window.partitionBy(*group).orderBy("at")
    places = starts.select(*group, "at").where("at IS NOT NULL").distinct()
    broken = F.coalesce(F.col("at") - F.lag("at").over(w) >= width, F.lit(True))
    runs = places.withColumn("__new", broken.cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = runs.groupBy(*group, "__run").agg(F.array_sort(F.collect_list("at")).alias("a"))
    # the next kept place of a run is the first at least ``width`` on: found by stepping, not scanning
    step = lambda acc, x: F.when(x - acc["last"] >= width, F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    first = F.element_at("a", 1)
    folded = F.aggregate("a", F.struct(first.alias("last"), F.array(first).alias("kept")), step, lambda acc: acc["kept"])
    kept = F.when(F.element_at("a", -1) - first < width, F.array(first)).otherwise(folded)
    return gathered.select(*group, F.explode(kept).alias("at"))


def claim(windows: DataFrame, order: list[str], file: str = "file", first: str = "start", last: str = "end") -> DataFrame:
    """Greedy claiming: windows in ``order`` take their lines if no window taken before has any of
    them.  Adds ``taken``.

    A file's windows depend on no other file's, so files are folded apart, and within a file only
    windows that overlap, directly or through others, depend on each other: each such cluster is
    folded by itself."""
    w = Window.partitionBy(file).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    clustered = windows.withColumn("__new", F.coalesce(F.col(first) > reach, F.lit(True)).cast("int")).withColumn("__cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    row = F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in windows.columns]).alias("row"))
    gathered = clustered.groupBy(file, "__cluster").agg(F.array_sort(F.collect_list(row)).alias("a"))
    span = F.struct(F.lit(0).cast(windows.schema[first].dataType).alias("a"), F.lit(0).cast(windows.schema[last].dataType).alias("z"))
    kind = gathered.select(F.array(span).alias("s")).schema["s"].dataType

    def free(taken, x):  # noqa: ANN001, ANN202
        return ~F.exists(taken, lambda t: (x["row"][first] <= t["z"]) & (t["a"] <= x["row"][last]))

    taken = F.aggregate("a", F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x["row"][first].alias("a"), x["row"][last].alias("z"))))).otherwise(acc))
    held = gathered.withColumn("taken", taken).select(F.explode("a").alias("x"), "taken")
    return held.select("x.row.*", F.exists("taken", lambda t: (t["a"] == F.col("x.row")[first]) & (t["z"] == F.col("x.row")[last])).alias("taken"))
