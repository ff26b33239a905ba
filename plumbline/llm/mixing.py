"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight; within a source
the smallest keys are taken until the token budget is met.  Whole epochs of a source come
first, the sample fills what is left of its target.  The running sum over sorted keys is
never made for a whole source at once: keys are counted into fine buckets with their
tokens, whole buckets below the budget's place are taken, and only the bucket that
straddles it is refined, then sorted document by document.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; equal keys are ordered by doc_id, then size; repeated
rows count each; an empty table gives an empty one; a row without doc_id draws by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import n_words_of, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = "mix-1"
BUCKETS = 1 << 12
#: Tables of one row per source are broadcast up to so many rows; beyond it Spark joins as it sees fit.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts: the same on every run."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that are letters or blanks."""
    whole = F.coalesce(text, F.lit(""))
    n = F.char_length(whole)
    return F.when(n == 0, F.lit(0.1)).otherwise(F.lit(0.1) + 0.9 * F.char_length(F.regexp_replace(whole, r"[^\p{L}\x20\x09-\x0D]+", "")) / n)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources in code-point order, null last, weigh ``weights``, repeating.  The budget
    (``share`` of all sizes) is dealt by weight; a target stops at ``most`` times its source,
    the excess goes to the others by weight.  Where that ends, targets are
    min(weight * level, cap); with sources sorted by cap / weight the level is the first
    (budget - caps so far) / (weights left) that no later source's cap undercuts."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("__k", (F.row_number().over(order) - 1) % len(weights))
    weighed = ranked.withColumn("__w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("__k")))
    capped = weighed.withColumn("__cap", (most * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), "__k", F.col("source").isNull(), "source")
    so_far, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(all_rows) * F.lit(share)
    level = (budget - F.coalesce(F.sum("__cap").over(so_far), F.lit(0.0))) / F.sum("__w").over(rest)
    found = capped.withColumn("__level", level).withColumn("__fits", F.col("__level") <= F.col("__cap") / F.col("__w"))
    held = F.max(F.when(F.col("__fits"), F.col("__level"))).over(all_rows)  # levels fall after the first that fits
    target = F.round(F.least(F.col("__cap"), F.coalesce(held * F.col("__w"), F.col("__cap"))), 6)
    return found.select("source", "source_size", target.alias("target"))


def _drawn(seed: str, weight: Column | None) -> dict[str, Column]:
    """Each document's source, size, key and buckets, from the row alone."""
    w = F.greatest(weight if weight is not None else quality_weight(F.col("text")), F.lit(1e-9))
    return {
        "d_id": F.col("doc_id").cast("long"),
        "d_source": F.col("source").cast("string"),
        "d_size": n_words_of(F.col("text")),
        "d_key": -F.log(uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))))) / w,
    }


def _bucketed(drawn: DataFrame) -> DataFrame:
    # a monotone map of keys to (0, 1): about even for weights near 1
    place = F.lit(1.0) - F.exp(-F.col("d_key"))
    fine = F.least(F.floor(place * (BUCKETS * BUCKETS)).cast("long"), F.lit(BUCKETS * BUCKETS - 1))
    return drawn.withColumns({"b1": F.floor(fine / BUCKETS).cast("int"), "b2": (fine % BUCKETS).cast("int")})


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def rules(drawn: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """One row per source: source_size, target, epochs, and where its sample ends."""
    sizes = drawn.groupBy(F.col("d_source").alias("source")).agg(F.sum("d_size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).cast("long")
    plan = written(plan.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), "mix-plan")
    few = plan.count() <= broadcast_sources
    small = lambda df: F.broadcast(df) if few else df

    def straddled(rows: DataFrame, rest: DataFrame, bucket: str) -> DataFrame:
        """By source: the bucket in which the running sum passes the rest, and what is left of it there."""
        counts = rows.groupBy(F.col("d_source").alias("s"), F.col(bucket).alias("b")).agg(F.sum("d_size").alias("n"))
        sums = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("b")))
        passed = sums.join(small(rest), _same("s", "source")).where("upto > rest")
        first = F.min(F.struct("b", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("x")
        return passed.groupBy("source").agg(first).select("source", F.col("x.b").alias("cut"), F.col("x.rest").alias("rest"))

    def within(rows: DataFrame, cuts: DataFrame, bucket: str) -> DataFrame:
        found = small(cuts.select(F.col("source").alias("__s"), F.col("cut").alias("__b"), "rest"))
        return rows.join(found, _same("d_source", "__s") & (F.col(bucket) == F.col("__b"))).drop("__s", "__b")

    first = written(straddled(drawn, plan.select("source", "rest"), "b1"), "mix-cut")
    inner = within(drawn, first, "b1").drop("rest")
    second = written(straddled(inner, first.select("source", "rest"), "b2"), "mix-cut-fine")
    # the documents of the one fine bucket per source, in exact order
    last = within(inner, second, "b2")
    upto = F.sum("d_size").over(Window.partitionBy("d_source").orderBy("d_key", "d_id", "d_size").rowsBetween(Window.unboundedPreceding, 0))
    edge = last.withColumn("upto", upto).where("upto <= rest").groupBy(F.col("d_source").alias("source")).agg(F.max(F.struct("d_key", "d_id", "d_size")).alias("edge"))
    out = plan.select("source", "source_size", "target", "epochs")
    for part in (first.select("source", F.col("cut").alias("cut1")), second.select("source", F.col("cut").alias("cut2")), edge):
        out = out.join(part.withColumnRenamed("source", "__s"), _same("source", "__s"), "left").drop("__s")
    return written(out, "mix-rules")


def _with_times(rows: DataFrame, by_source: DataFrame, broadcast_sources: int) -> DataFrame:
    """The rows with source_size, target and ``times``: how often each is taken."""
    by_source = by_source.withColumnRenamed("source", "__source")
    if by_source.count() <= broadcast_sources:
        by_source = F.broadcast(by_source)
    me = F.struct("d_key", "d_id", "d_size")
    sampled = (
        F.when(F.col("cut1").isNull(), F.lit(False))
        .when(F.col("b1") != F.col("cut1"), F.col("b1") < F.col("cut1"))
        .when(F.col("cut2").isNull() | (F.col("b2") != F.col("cut2")), F.coalesce(F.col("b2") < F.col("cut2"), F.lit(False)))
        .otherwise(F.coalesce(me <= F.col("edge"), F.lit(False)))
    )
    # a blank document adds no words: it is taken 0 times, whatever its place
    times = F.when(F.col("d_size") > 0, F.col("epochs") + sampled.cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.join(by_source, _same("d_source", "__source")).withColumn("times", times)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, seed: str = SEED, weight: Column | None = None, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document.  ``taken`` is its size
    times the epochs of its source, once more if sampled."""
    drawn = _bucketed(written(docs.select(*[v.alias(k) for k, v in _drawn(seed, weight).items()]), "drawn"))
    found = _with_times(drawn, rules(drawn, weights, share, most, broadcast_sources), broadcast_sources)
    return found.select(F.col("d_id").alias("doc_id"), F.col("d_size").alias("size"), "source_size", "target", (F.col("d_size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_EPOCHS, seed: str = SEED, weight: Column | None = None, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The documents themselves, each as often as it is taken, with the input's columns.  Texts
    are not shuffled: the small table of rules meets each row where it is."""
    own = _drawn(seed, weight)
    drawn = _bucketed(written(docs.select(*[v.alias(k) for k, v in own.items()]), "drawn"))
    by_source = rules(drawn, weights, share, most, broadcast_sources)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[v.alias(k) for k, v in own.items()])
    found = _with_times(_bucketed(held), by_source, broadcast_sources).where("times > 0")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*[F.col(f"__row.`{c}`") for c in docs.columns])
