"""Rules on repeated blocks and shapes.

Defined results: windows of one content count each, however often a file holds them; of windows of one
content in a file that overlap, the first stays; two shapes without fields are alike only by equal,
non-empty lists of bases; ties go to the smaller file and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.cut import written
from plumbline.operators import graph, intervals, windows
from plumbline.rules.base import Context, rule, said

WIDTH, LEAST_BYTES = 6, 80
LEAST_FIELDS, PERCENT = 3, 80


def statement_windows(statements: DataFrame, width: int = WIDTH, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """file, block, run, at, exact, shape, line_from, line_to, span: windows of ``width`` consecutive
    statements of one run of one block."""
    w = Window.partitionBy("file", "block", "run").orderBy("at").rowsBetween(0, width - 1)
    one = F.collect_list(F.struct("exact", "shape", "bytes", "span")).over(w)
    held = statements.withColumn("w", one).where(F.size("w") == width)
    total = F.aggregate("w", F.lit(0), lambda n, x: n + x["bytes"])
    last = F.element_at("w", -1)["span"]
    span = F.struct(F.col("span.start_byte").alias("start_byte"), last["end_byte"].alias("end_byte"), F.col("span.line").alias("line"), F.col("span.column").alias("column"))
    return held.where(total >= least_bytes).select("file", "block", "run", "at", F.xxhash64(F.transform("w", lambda x: x["exact"])).alias("exact"), F.xxhash64(F.transform("w", lambda x: x["shape"])).alias("shape"), F.col("span.line").alias("line_from"), last["line"].alias("line_to"), span.alias("span"))


def repeated(found: DataFrame) -> DataFrame:
    """Windows whose shape occurs at least twice, without those of one shape that overlap in a file;
    ``near``: their texts differ."""
    groups = found.groupBy("shape").agg(F.count("*").alias("n"), (F.count_distinct("exact") > 1).alias("near")).where("n >= 2").select("shape", "near")
    twice = written(found.join(groups, "shape"), "repeated")
    kept = intervals.drop_self_overlap(twice.withColumnRenamed("at", "place").select("file", "block", "run", "shape", F.col("place").alias("at")), WIDTH, "file", "block", "run", "shape")
    left = written(twice.join(kept, ["file", "block", "run", "shape", "at"], "left_semi"), "apart")
    again = left.groupBy("shape").agg(F.count("*").alias("n")).where("n >= 2").select("shape")
    return left.join(again, "shape", "left_semi")


def claimed(found: DataFrame) -> DataFrame:
    """Windows of ``repeated`` that no earlier one (by file and place) overlaps, in groups of two at least."""
    order = found.withColumn("start", F.col("span.start_byte")).withColumn("end", F.col("span.end_byte"))
    taken = intervals.claim(order, ["start", "end", "shape"]).where("taken").drop("taken", "start", "end")
    again = taken.groupBy("shape").agg(F.count("*").alias("n")).where("n >= 2").select("shape")
    return taken.join(again, "shape", "left_semi")


def _groups(ctx: Context, near: bool) -> DataFrame:
    found = written(claimed(repeated(statement_windows(ctx.facts.statements))), "blocks").where(F.col("near") == near)
    one = F.struct("file", F.col("span.start_byte").alias("at"), "span")
    held = found.groupBy("shape").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("m"))  # the finding lists all its places
    related = F.transform(F.slice("m", F.lit(2), F.col("n").cast("int") - 1), lambda x: F.struct(x["file"].alias("file"), x["span"].alias("span")))
    message = said("block of {} statements occurs {} times" if not near else "block of {} statements occurs {} times with other literals", F.lit(WIDTH), "n")
    return held.select(F.col("m")[0]["file"].alias("file"), F.col("m")[0]["span"].alias("span"), message.alias("message"), related.alias("related"))


@rule("Refactor.DuplicateBlock", 12, "medium", "A block of statements that occurs again.")
def duplicate_block(ctx: Context) -> DataFrame:
    return _groups(ctx, near=False)


@rule("Refactor.NearDuplicateBlock", 10, "low", "A block of statements that occurs again with other literals.")
def near_duplicate_block(ctx: Context) -> DataFrame:
    return _groups(ctx, near=True)


def shape_tokens(shapes: DataFrame) -> DataFrame:
    """key, file, name, span, tokens (field and type), extends: shapes with enough fields."""
    keyed = shapes.withColumn("key", F.xxhash64("file", F.col("span.start_byte"), "name"))
    tokens = F.transform("fields", lambda f: F.concat_ws(": ", f["name"], f["type"]))
    return keyed.select("key", "file", "name", "span", tokens.alias("tokens"), "extends")


def similar_shapes(shapes: DataFrame) -> DataFrame:
    """(key, label) of shapes that are alike, directly or through others: equal lists of bases, and
    fields of which at least PERCENT are the same."""
    own = written(shape_tokens(shapes), "shapes")
    several = own.where(F.size("tokens") >= LEAST_FIELDS)
    # bases are a token of their own set, so that only shapes with equal lists can meet
    based = several.select(F.col("key").alias("id"), F.transform("tokens", lambda t: F.concat_ws("\n", t, F.array_join("extends", ","))).alias("tokens"))
    pairs = windows.similar_sets(based, PERCENT).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    members = windows.classes(based).select(F.col("id").alias("src"), F.col("class_id").alias("dst"))
    bare = own.where((F.size("tokens") == 0) & (F.size("extends") > 0)).groupBy("extends").agg(F.min("key").alias("first"))
    alike = own.where(F.size("tokens") == 0).join(bare, "extends").select(F.col("key").alias("src"), F.col("first").alias("dst"))
    return graph.components(pairs.unionByName(members).unionByName(alike).where("src <> dst")).withColumnRenamed("id", "key")


@rule("Design.DuplicateTypeShape", 5, "medium", "Types of nearly the same fields.")
def duplicate_shape(ctx: Context) -> DataFrame:
    own = written(shape_tokens(ctx.facts.shapes), "shapes")
    held = own.join(similar_shapes(ctx.facts.shapes), "key")
    one = F.struct("file", F.col("span.start_byte").alias("at"), "name", "span", F.size("tokens").alias("fields"), "extends")
    groups = held.groupBy("label").agg(F.array_sort(F.collect_list(one)).alias("m")).where(F.size("m") >= 2)  # the finding lists all its types
    first, others = F.col("m")[0], F.slice("m", F.lit(2), F.size("m") - 1)
    n = F.size("m") - 1
    names = F.array_join(F.transform(others, lambda x: F.concat(F.lit("`"), x["name"], F.lit("` in "), x["file"])), ", ")
    plural = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    bare = said("`{}` extends the same base (`{}`) as {} other type{}: {} — consider a shared type", first["name"], F.array_join(first["extends"], ", "), n, plural, names)
    full = said("`{}` ({} fields) shares a near-identical field shape with {} other type{}: {} — consider a shared type", first["name"], first["fields"], n, plural, names)
    related = F.transform(others, lambda x: F.struct(x["file"].alias("file"), x["span"].alias("span")))
    return groups.select(first["file"].alias("file"), first["span"].alias("span"), F.when(first["fields"] == 0, bare).otherwise(full).alias("message"), related.alias("related"))
