"""What a change should know: items about changed files, for a digest.

An item: check_id, title, body, score, pinned, related (files), explain.  Defined results: without
changes there are no items; a changed file without ranges is changed as a whole; items of checks that
the policy suppresses for a path are left out, those suppressed without globs everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.cut import written
from plumbline.functions import paths, texts
from plumbline.operators import bands, graph, windows
from plumbline.operators import findings as fi
from plumbline.plans import predicate
from plumbline.rules.base import TEST_PARTS, Context, said
from plumbline.sources import notes as annotations
from plumbline.sources.config import Note

#: Scores of items.
VERIFIED, INDIRECT = 90, 50
ENVELOPE_TOKENS = 20
PRECEDENT_PERCENT, PRECEDENT_FIELDS, SHOWN = 75, 2, 20


def _item(check_id: str, title: Column, body: Column, score: Column, pinned: bool, related: Column, explain: Column) -> list[Column]:
    return [F.lit(check_id).alias("check_id"), title.alias("title"), body.alias("body"), score.cast("int").alias("score"), F.lit(pinned).alias("pinned"), related.cast("array<string>").alias("related"), explain.alias("explain")]


def item_tokens() -> Column:
    """A quarter of the characters of every field shown, and a fixed number for the frame."""
    q = lambda c: F.ceil(F.char_length(F.coalesce(c, F.lit(""))) / 4)
    return (q(F.col("title")) + q(F.col("body")) + q(F.col("check_id")) + q(F.col("explain")) + q(F.to_json("related")) + ENVELOPE_TOKENS).cast("long")


def finding_items(ctx: Context) -> DataFrame:
    """One item for findings on changed lines, counted by check, and one per file for the others."""
    found = ctx.findings.select("check_id", "file", F.col("span.line").alias("line"))
    by_check, by_file = fi.fresh_counts(found, ctx.changes)
    total = by_check.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("check_id", "n"))).alias("m")).where("n > 0")  # a row per check
    listed = F.array_join(F.transform("m", lambda x: F.concat(x["n"].cast("string"), F.lit("× "), x["check_id"])), ", ")
    noun = lambda n: F.when(n == 1, F.lit("finding")).otherwise(F.lit("findings"))
    names = F.array_join(F.transform("m", lambda x: x["check_id"]), ", ")
    none = F.array().cast("array<string>")
    first = total.select(*_item("Context.Findings", said("{} {} in changed lines", "n", noun(F.col("n"))), listed, F.lit(VERIFIED), True, none, said("{} finding(s) from {} on line(s) the diff changed", "n", names)))
    rest = by_file.select(*_item("Context.Findings", said("Legacy debt: {}", "file"), said("This file carries {} baselined {} outside the changed lines.", "n", noun(F.col("n"))), F.lit(INDIRECT), True, F.array("file"), said("{} pre-existing finding(s) in {} outside the lines the diff changed", "n", "file")))
    return first.unionByName(rest)


def changed_exports(ctx: Context) -> DataFrame:
    """(file, name) of exports on changed lines, or of files changed as a whole."""
    rows = ctx.facts.exports.select("file", "name", F.col("span.line").alias("line"))
    ranged = bands.join(rows, ctx.changes.where("first_line IS NOT NULL"), F.col("p.file") == F.col("b.file"), how="left_semi").select("file", "name")
    whole = rows.join(ctx.changes.where("first_line IS NULL").select("file").distinct(), "file", "left_semi").select("file", "name")
    return ranged.union(whole).distinct()


def blast_items(ctx: Context, most_depth: int = 4) -> DataFrame:
    """Files that depend on the changed ones, by how near and by what."""
    names = ctx.facts.names.where("resolved IS NOT NULL").select(F.col("from_file").alias("src"), F.col("resolved").alias("dst"), F.when(F.col("kind") == "default", F.lit("default")).otherwise(F.col("source_name")).alias("name"))
    bare = ctx.facts.imports.where("resolved IS NOT NULL AND size(names) = 0").select(F.col("from_file").alias("src"), F.col("resolved").alias("dst"), F.lit(None).cast("string").alias("name"))
    tests = ctx.facts.listing.where(paths.classified(F.col("file"), TEST_PARTS)).select(F.col("file").alias("id"))
    reached = graph.blast_radius(names.unionByName(bare), ctx.changes.select(F.col("file").alias("id")), most_depth, changed_exports(ctx).withColumnRenamed("file", "id"), tests)
    body = said("{} step(s) away: {}", "depth", F.array_join("path", " ← "))
    return reached.select(*_item("Context.BlastRadius", said("{} depends on {}", "id", "root"), body, F.col("score"), False, F.array("id"), F.when(F.col("hit"), F.lit("imports a name that changed")).otherwise(F.lit("imports a changed file"))))


def annotation_items(ctx: Context) -> DataFrame:
    """Annotations on changed lines, and of files that a changed file imports."""
    scopes = ctx.facts.functions.where("name <> ''").select("file", F.col("name").alias("scope"), F.col("span.line").alias("first"), F.col("span.line").alias("last"))
    found = annotations.touched(annotations.annotations(ctx.facts.lines, scopes), ctx.changes, ctx.facts.imports)
    body = said("{}{}", "text", F.coalesce(said(" ({})", "scope"), F.lit("")))
    why = F.when(F.col("how") == "direct", F.lit("the change touches it")).otherwise(said("imported by {}", "by"))
    return found.select(*_item("Context.Annotations", said("{} in {}", "mark", "file"), body, F.when(F.col("how") == "direct", F.lit(VERIFIED)).otherwise(F.lit(INDIRECT)), False, F.array("file"), why))


def knowledge_items(ctx: Context, notes: list[Note]) -> DataFrame:
    """Notes whose globs, layers or predicate match a changed file; a high one is pinned."""
    one = F.struct("specifier", "resolved", "type_only", "names")
    changed = ctx.changes.select("file").distinct()
    imports = ctx.facts.imports.join(changed.withColumnRenamed("file", "from_file"), "from_file", "left_semi").groupBy(F.col("from_file").alias("__i")).agg(F.collect_list(one).alias("__imports"))
    exports = ctx.facts.exports.join(changed, "file", "left_semi").groupBy(F.col("file").alias("__e")).agg(F.collect_list("name").alias("__exports"))
    files = written(changed.join(imports, F.col("file") == F.col("__i"), "left").join(exports, F.col("file") == F.col("__e"), "left"), "changed-files")
    layer = paths.first_layer(F.col("file"), ctx.policy.layers)
    facts = predicate.Facts(path=F.col("file"), layer=layer, imports=F.col("__imports"), exports=F.col("__exports"), named=True)
    out = None
    for note in notes:
        tests = [paths.matches(F.col("file"), g) for g in note.paths] + [F.coalesce(layer == name, F.lit(False)) for name in note.layers]
        if note.predicate:
            kind, holds = predicate.compile_predicate(note.predicate, facts)
            tests.append(~holds if kind == "forbid" else holds)
        if not tests:
            continue
        hit = files.where(reduce(lambda a, b: a | b, tests)).agg(F.count("*").alias("n"), F.min("file").alias("first"), F.slice(F.array_sort(F.collect_list("file")), 1, SHOWN).alias("files")).where("n > 0")  # changed files only
        rows = hit.select(*_item("Context.Knowledge", F.lit(note.title), texts.truncated(F.lit(note.body)), F.lit(VERIFIED if note.priority == "high" else INDIRECT), note.priority == "high", F.col("files"), said("{} matched {} changed file(s), e.g. {}", F.lit(note.path), "n", "first")))
        out = rows if out is None else out.unionByName(rows)
    return files.where("false").select(*_item("", F.lit(""), F.lit(""), F.lit(0), False, F.array(F.lit("")), F.lit(""))) if out is None else out


def precedent_items(ctx: Context) -> DataFrame:
    """Files beside a changed one whose main shape is like others' there: in its folder, else of its
    kind (the name without the stem's first part)."""
    shapes = ctx.facts.shapes.withColumn("n", F.size("fields")).where(F.col("n") >= PRECEDENT_FIELDS)
    main = shapes.groupBy("file").agg(F.max_by(F.struct(F.transform("fields", lambda f: f["name"]).alias("tokens"), "name"), F.struct("n", (-F.col("ordinal")).alias("o"))).alias("s")).select(F.col("file").alias("id"), "s.tokens", "s.name", paths.dirname(F.col("file")).alias("dir"), F.concat(F.lit("*."), F.regexp_replace(paths.basename(F.col("file")), r"\A[^.]*\.", "")).alias("kind"))
    main = written(main, "main-shapes")
    changed = ctx.changes.select(F.col("file").alias("id")).distinct()
    out, done = None, None
    for group, score in (("dir", VERIFIED - 20), ("kind", INDIRECT)):
        rows = main.select("id", "tokens", F.col(group).alias("group")).join(changed, "id", "left_anti")
        pairs = windows.jaccard_groups(rows, "group", PRECEDENT_PERCENT, PRECEDENT_FIELDS)
        own = windows.classes(rows.select("id", F.transform("tokens", lambda t: F.concat_ws("\n", "group", t)).alias("tokens")))
        links = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(own.where("class_id IS NOT NULL AND id <> class_id").select(F.col("id").alias("src"), F.col("class_id").alias("dst")))
        members = graph.components(links).join(rows.select("id", "group"), "id").select("id", "label", "group")
        best = windows.largest_cluster(members).groupBy("group").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, SHOWN).alias("files")).where("n >= 2")  # the largest cluster of a group
        groups = main.join(changed, "id", "left_semi").select("id", F.col(group).alias("group"))
        groups = groups if done is None else groups.join(done, "id", "left_anti")
        hit = written(groups.join(best, "group"), "precedent")
        done = hit.select("id")
        items = hit.groupBy("group", "n", "files").agg(F.min("id").alias("first")).select(*_item("Context.Precedent", said("Sibling convention in {}", "group"), said("{} files share a shape: {}", "n", F.array_join("files", ", ")), F.lit(score), False, F.col("files"), said("{} changed beside them", "first")))
        out = items if out is None else out.unionByName(items)
    return out


def items(ctx: Context, notes: list[Note] = ()) -> DataFrame:
    """All items of the change, without those that the policy suppresses, with their ``tokens``."""
    found = finding_items(ctx).unionByName(blast_items(ctx)).unionByName(annotation_items(ctx)).unionByName(precedent_items(ctx)).unionByName(knowledge_items(ctx, list(notes)))
    return suppressed_items(found, ctx.policy.context_suppress).withColumn("tokens", item_tokens())


def suppressed_items(found: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Items without those of a suppressed check that are about a path of its globs, or of any without
    globs."""
    for check, globs in rules:
        about = F.lit(True) if not globs else F.exists("related", lambda p: reduce(lambda a, b: a | b, [paths.matches(paths.normal(p), g, True) for g in globs]))
        found = found.where(~((F.col("check_id") == check) & about))
    return found
