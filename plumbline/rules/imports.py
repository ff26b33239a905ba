"""Rules on imports and exports.

Defined results for all of them: only imports that resolve to a file count, unless a rule says
otherwise; a file without a layer is of none; ties go to the smaller path; nothing is found in empty
tables.  Messages are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.cut import spread, written
from plumbline.functions import paths
from plumbline.operators import graph, stats
from plumbline.plans import predicate
from plumbline.rules.base import FRAMEWORK_PARTS, TEST_PARTS, Context, quoted, rule, said, whole_file

#: Modules that act on the world; names of files that gather others; templates of tests.
EFFECTS = "fs fs/promises net http https http2 dgram tls dns child_process cluster pg mysql mysql2 mongodb mongoose sqlite3 better-sqlite3 redis ioredis knex sequelize typeorm prisma @prisma/client".split()
HUBS = "index.ts index.tsx index.js index.jsx index.mjs index.cjs types.ts types.tsx".split()
TEST_TEMPLATES = tuple(f"{folder}{{name}}.{kind}.{ext}" for folder in ("", "__tests__/") for kind in ("test", "spec") for ext in ("ts", "tsx", "js", "jsx", "mjs", "mts", "cts"))


def consumption(ctx: Context, test_parts: tuple[str, ...] = TEST_PARTS) -> DataFrame:
    """By file: what of it is taken, by any file and by files that are not tests (``graph.incoming``)."""
    facts = ctx.facts
    tests = facts.listing.where(paths.classified(F.col("file"), test_parts)).select(graph.node_id("file", "file").alias("id"))
    return graph.incoming(graph.import_edges(facts.imports), tests)


@rule("Design.OrphanExport", 5, "medium", "An export that no file imports.")
def orphan_export(ctx: Context) -> DataFrame:
    me = "Design.OrphanExport"
    tests, entries = tuple(ctx.option(me, "test_file_patterns", TEST_PARTS)), tuple(ctx.option(me, "framework_entry_patterns", FRAMEWORK_PARTS))
    path = F.col("file")
    own = ctx.facts.exports.where((F.col("kind") != "reexport") & ~paths.classified(path, tests) & ~paths.classified(path, entries) & ~ctx.is_public(path))
    if not ctx.option(me, "include_type_only", False):
        own = own.where("NOT type_only")
    met = own.withColumn("id", graph.node_id("file", "file")).join(consumption(ctx, tests), "id", "left")

    def consumed(suffix: str) -> Column:
        named = F.col(f"namespace{suffix}") | F.array_contains(f"names{suffix}", F.col("name"))
        return F.coalesce(F.when(F.col("kind") == "default", F.col(f"default{suffix}")).otherwise(named), F.lit(False))

    shown = F.when(F.col("kind") == "default", F.lit("default export")).otherwise(quoted("name"))
    never = said("{} is exported but never imported in the project", shown)
    if ctx.option(me, "test_imports_count", True):
        return met.where(~consumed("")).select("file", "span", never.alias("message"))
    message = F.when(consumed(""), said("{} is imported only by test files", shown)).otherwise(never)
    return met.where(~consumed("_own")).select("file", "span", message.alias("message"))


@rule("Refactor.DeadExport", 4, "low", "An export that is imported and never used after that.")
def dead_export(ctx: Context) -> DataFrame:
    names = ctx.facts.names.where("resolved IS NOT NULL")
    taken = names.where("kind <> 'namespace'").withColumn("name", F.when(F.col("kind") == "default", F.lit("default")).otherwise(F.col("source_name")))
    counts = taken.groupBy(F.col("resolved").alias("file"), "name").agg(F.count("*").alias("total"), F.count_if(F.col("local_use_count") > 0).alias("used")).where("used = 0")
    shielded = names.where("kind = 'namespace'").select(F.col("resolved").alias("file")).union(ctx.facts.exports.where("resolved_source IS NOT NULL").select("resolved_source")).distinct()
    own = ctx.facts.exports.where("kind <> 'reexport' AND NOT type_only")
    found = own.join(counts, ["file", "name"]).join(shielded, "file", "left_anti")
    shown = F.when(F.col("kind") == "default", F.lit("default export")).otherwise(quoted("name"))
    return found.select("file", "span", said("{} is imported by {} file(s) but never referenced after import", shown, "total").alias("message"))


@rule("Warning.UnusedImport", 7, "low", "A re-export that no file imports.")
def unused_import(ctx: Context) -> DataFrame:
    path = F.col("file")
    own = ctx.facts.exports.where((F.col("kind") == "reexport") & (F.col("name") != "*") & ~F.col("type_only") & ~paths.classified(path, FRAMEWORK_PARTS) & ~ctx.is_public(path))
    names = ctx.facts.names.where("resolved IS NOT NULL").withColumnRenamed("resolved", "file")
    whole = names.where("kind = 'namespace'").select("file").distinct()
    default = names.where("kind = 'default'").select("file").distinct()
    named = names.where("kind = 'named'").select("file", F.col("source_name").alias("name")).distinct()
    left = own.join(whole, "file", "left_anti")
    a = left.where("name = 'default'").join(default, "file", "left_anti").select("file", "span", F.lit("default re-export is never imported by another file").alias("message"))
    b = left.where("name <> 'default'").join(named, ["file", "name"], "left_anti").select("file", "span", said("re-export {} is never imported by another file", quoted("name")).alias("message"))
    return a.unionByName(b)


@rule("Design.LayerViolation", 9, "high", "A value import from one layer to another that the policy does not allow.")
def layer_violation(ctx: Context) -> DataFrame:
    if not ctx.policy.layers:
        return ctx.facts.imports.where("false").select(F.col("from_file").alias("file"), "span", F.lit("").alias("message"))
    placed = ctx.facts.imports.where("resolved IS NOT NULL AND NOT type_only").select(F.col("from_file").alias("file"), "span", paths.layer_of(F.col("from_file"), ctx.policy.layers).alias("a"), paths.layer_of(F.col("resolved"), ctx.policy.layers).alias("b"))
    allowed = [f"{a}\n{b}" for a, held in ctx.policy.allow.items() for b in held]
    crosses = placed.where(F.col("a") != F.col("b")).where(~F.concat_ws("\n", "a", "b").isin(allowed) if allowed else F.lit(True))
    return crosses.select("file", "span", said("layer `{}` may not import from layer `{}`", "a", "b").alias("message"))


@rule("Design.BoundaryFrozen", 0, "low", "A file of a boundary that is frozen.", languages=("typescript", "astro", "rust", "html"))
def boundary_frozen(ctx: Context) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(paths.matches(F.col("file"), g), said("file is in frozen boundary `{}`{}", F.lit(g), F.lit(f": {why}" if why else ""))) for g, why in ctx.policy.frozen])) if ctx.policy.frozen else F.array().cast("array<string>")
    return ctx.facts.listing.select("file", whole_file().alias("span"), F.explode(hits).alias("message"))


def _prefixed(prefixes: list[str]) -> Column:
    """The first of the prefixes that the specifier or the resolved path has."""
    resolved = F.coalesce("resolved", F.lit(""))
    return F.coalesce(*[F.when(paths.has_prefix(F.col("specifier"), p) | paths.has_prefix(resolved, p), F.lit(p)) for p in prefixes])


@rule("Design.InvariantViolation", 5, "medium", "An import that a policy forbids, or a file without one that it requires.")
def invariant_violation(ctx: Context) -> DataFrame:
    imports = ctx.facts.imports.withColumn("layer", paths.layer_of(F.col("from_file"), ctx.policy.layers) if ctx.policy.layers else F.lit(None).cast("string"))
    out = imports.where("false").select(F.col("from_file").alias("file"), "span", F.lit("").alias("message"))
    for name, spec in sorted(ctx.policy.invariants.items()):
        rows = imports.where(F.coalesce(F.col("layer").isin(spec["from_layers"]), F.lit(False))) if spec.get("from_layers") else imports
        if spec.get("forbid_imports"):
            hit = rows.withColumn("p", _prefixed(spec["forbid_imports"])).where("p IS NOT NULL")
            out = out.unionByName(hit.select(F.col("from_file").alias("file"), "span", said("invariant `{}` violated: forbidden import `{}` (matches prefix `{}`)", F.lit(name), "specifier", "p").alias("message")))
        if spec.get("require_imports"):
            needed = spec["require_imports"]
            files = rows.groupBy(F.col("from_file").alias("file")).agg(F.min_by("span", "ordinal").alias("span"), F.bool_or(_prefixed(needed).isNotNull()).alias("met")).where("NOT met")
            listed = "[" + ", ".join(f'"{p}"' for p in needed) + "]"
            out = out.unionByName(files.select("file", "span", F.lit(f"invariant `{name}` violated: file is missing required import matching one of {listed}").alias("message")))
    return out


@rule("Design.ScriptedInvariant", 7, "medium", "A rule of the project's own, in the predicate language.", languages=("typescript", "astro", "rust", "html", "markdown"))
def scripted_invariant(ctx: Context) -> DataFrame:
    facts = ctx.facts
    one = F.struct("specifier", "resolved", "type_only", "names")
    imports = facts.imports.groupBy(F.col("from_file").alias("__i")).agg(F.collect_list(one).alias("__imports"))  # one file's imports
    exports = facts.exports.groupBy(F.col("file").alias("__e")).agg(F.collect_list("name").alias("__exports"))
    files = facts.listing.join(imports, F.col("file") == F.col("__i"), "left").join(exports, F.col("file") == F.col("__e"), "left").drop("__i", "__e")
    files = written(files, "files-with-facts")
    wanted: list[str] = []
    asked: list[Column] = []

    def note(pattern: str) -> Column:
        wanted.append(pattern)
        return F.lit(False)

    def ask(path: Column) -> Column:
        asked.append(path)
        return F.lit(False)

    layer = paths.first_layer(F.col("file"), ctx.policy.layers)
    base = {"path": F.col("file"), "layer": layer, "imports": F.col("__imports"), "exports": F.col("__exports"), "named": True}
    texts = [t for s in ctx.policy.scripted.values() for t in (s.get("when"), s["rule"]) if t]
    for text in texts:  # what the rules ask of other tables
        predicate.compile_predicate(text, predicate.Facts(**base, transitive=note, exists=ask))
    for k, pattern in enumerate(wanted):
        files = files.join(importing(facts.imports, pattern).select(F.col("file").alias(f"__f{k}"), F.lit(True).alias(f"__t{k}")), F.col("file") == F.col(f"__f{k}"), "left").drop(f"__f{k}")
    listing = facts.listing
    for k, path in enumerate(asked):
        files = files.withColumn(f"__p{k}", paths.normal(F.coalesce(path, F.lit(""))))
        files = files.join(listing.select(F.col("file").alias(f"__l{k}"), F.lit(True).alias(f"__x{k}")), F.col(f"__p{k}") == F.col(f"__l{k}"), "left").drop(f"__l{k}", f"__p{k}")
    seen = {"t": 0, "x": 0}

    def transitive(pattern: str) -> Column:
        seen["t"] += 1
        return F.coalesce(F.col(f"__t{seen['t'] - 1}"), F.lit(False))

    def exists(path: Column) -> Column:
        seen["x"] += 1
        return F.coalesce(F.col(f"__x{seen['x'] - 1}"), F.lit(False))

    held = predicate.Facts(**base, transitive=transitive, exists=exists)
    broken = []
    for name, spec in ctx.policy.scripted.items():
        when = predicate.compile_predicate(spec["when"], held)[1] if spec.get("when") else F.lit(True)
        kind, holds = predicate.compile_predicate(spec["rule"], held)
        fails = when & (holds if kind == "forbid" else ~holds)
        broken.append(F.when(fails, F.lit(f"scripted invariant `{name}` failed: {spec.get('message', '')}")))
    hits = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return files.select("file", whole_file().alias("span"), F.explode(hits).alias("message"))


def importing(imports: DataFrame, pattern: str) -> DataFrame:
    """(file): files that reach, over resolved imports, one whose specifier or path is as ``pattern``."""
    named = lambda c: F.coalesce(paths.matches(F.col(c), pattern) if paths.is_glob(pattern) else F.col(c) == pattern, F.lit(False))
    targets = imports.where(named("specifier") | named("resolved")).select(F.col("from_file").alias("id")).distinct()
    edges = imports.where("resolved IS NOT NULL").select(F.col("from_file").alias("src"), F.col("resolved").alias("dst"))
    sources = imports.select(F.col("from_file").alias("id")).distinct()
    return graph.reaching(edges, sources, targets.withColumn("__", F.lit(1)).select("id")).select(F.col("id").alias("file"))


@rule("Design.ImportCycle", 8, "medium", "Files that import each other in a circle.")
def import_cycle(ctx: Context) -> DataFrame:
    facts = ctx.facts
    rows = facts.imports.where("resolved IS NOT NULL")
    if ctx.option("Design.ImportCycle", "ignore_type_only", False):
        rows = rows.where("NOT type_only")
    universe = facts.imports.select(F.col("from_file").alias("file")).union(facts.exports.select("file")).distinct()
    rows = rows.join(universe.withColumnRenamed("file", "resolved").hint("merge"), "resolved", "left_semi")
    edges = written(rows.select(F.col("from_file").alias("src"), F.col("resolved").alias("dst"), "ordinal", "span"), "edges")
    scc = graph.strong_components(edges)
    inside = edges.join(scc.withColumnRenamed("id", "src").hint("merge"), "src").join(scc.select(F.col("id").alias("dst"), F.col("scc").alias("other")).hint("merge"), "dst").where("scc = other")
    first = inside.groupBy("scc", F.col("src").alias("file")).agg(F.min_by("span", "ordinal").alias("span"))
    one = F.struct("file", "span")
    groups = first.groupBy("scc").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("m"))  # the finding lists all its files
    message = F.when(F.col("n") == 1, F.lit("this file imports itself")).otherwise(said("import cycle of {} files", "n"))
    return groups.select(F.col("m")[0]["file"].alias("file"), F.col("m")[0]["span"].alias("span"), message.alias("message"), F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0))).alias("related"))


@rule("Design.ImportFanOutOutlier", 6, "medium", "A file that imports far more files than others do.")
def fan_outlier(ctx: Context) -> DataFrame:
    facts = ctx.facts
    edges = facts.imports.where("resolved IS NOT NULL").where(~F.col("resolved").rlike(r"(\A|/)node_modules/")).select(F.col("from_file").alias("src"), F.col("resolved").alias("dst"))
    fans = stats.fans(edges, facts.listing.select(F.col("file").alias("id"))).withColumnRenamed("id", "file")
    fans = fans.where(~paths.basename(F.col("file")).isin(HUBS) & ~F.col("file").rlike(r"(\A|/)node_modules/") & ~ctx.is_public(F.col("file")))
    fans = written(fans, "fans")
    s = fans.agg(F.struct(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{k}_{c}") for c in ("fan_in", "fan_out") for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])).scalar()
    held = fans.withColumn("s", s)
    over = lambda c: F.coalesce((F.col(f"s.sd_{c}") > 0) & (F.col(c) > F.col(f"s.mean_{c}") + 3.0 * F.col(f"s.sd_{c}")) & (F.col(c) >= 8), F.lit(False))
    one = lambda c: F.format_string("%.1f", F.col(f"s.{c}"))
    both = said("unusually high import fan-in and fan-out: {} files import this one and it imports {} others (project mean fan-in {}, stddev {}) — possible over-centralized hub", "fan_in", "fan_out", one("mean_fan_in"), one("sd_fan_in"))
    alone = said('unusually high import fan-out: this file imports {} others (project mean {}, stddev {}) — possible "god module"', "fan_out", one("mean_fan_out"), one("sd_fan_out"))
    return held.where((F.col("s.n") >= 8) & over("fan_out")).select("file", whole_file().alias("span"), F.when(over("fan_in"), both).otherwise(alone).alias("message"))


@rule("Design.BarrelReexportBloat", 5, "medium", "A file that re-exports far more of its folder than others do.")
def barrel_bloat(ctx: Context) -> DataFrame:
    folder = paths.dirname(F.col("file"))
    own = ctx.facts.exports.groupBy("file").agg(F.count_if(F.col("kind") == "reexport").alias("re"), F.count_if(F.col("kind") != "reexport").alias("real")).withColumn("dir", folder)
    own = written(own, "export-counts")
    beside = own.groupBy("dir").agg(F.sum("real").alias("beside"))
    # sums of a folder and all below it: each file counts for every folder above it
    above = own.select("real", F.explode(_ancestors(F.col("dir"))).alias("dir")).groupBy("dir").agg(F.sum("real").alias("below"))
    met = own.where("re > 0").where(~ctx.is_public(F.col("file"))).join(beside, "dir").join(above, "dir")
    siblings = F.when(F.col("beside") > F.col("real"), F.col("beside") - F.col("real")).otherwise(F.col("below") - F.col("real"))
    ratios = written(met.withColumn("siblings", siblings).where("siblings > 0").select("file", (F.col("re") / F.col("siblings")).alias("ratio")), "ratios")
    found = stats.outliers(ratios, "ratio", least_rows=5, least_value=0)
    percent = lambda c: F.format_string("%.0f", F.col(c) * 100)
    message = said("this barrel re-exports a much larger share of its directory's exports ({}%) than other barrels in the project (mean {}%, stddev {}%) — its real public surface is unclear and tree-shaking is defeated", percent("ratio"), percent("mean"), percent("sd"))
    return found.select("file", whole_file().alias("span"), message.alias("message"))


def _ancestors(folder: Column) -> Column:
    """The folder and all above it; the root is ''."""
    parts = F.split(folder, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), every))


@rule("Design.DuplicateExportName", 6, "medium", "A name that several places export.")
def duplicate_export_name(ctx: Context) -> DataFrame:
    own = written(ctx.facts.exports.where("declares IN ('function', 'class', 'variable')").select("name", "file", F.col("span.start_byte").alias("at"), "span"), "declared")
    twice = own.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2")
    held = own.join(twice, "name").withColumn("sides", F.lit(0))
    one = F.struct("file", "at", "span")
    groups = held.groupBy("name", "n").agg(F.array_sort(F.collect_list(one)).alias("m"))  # the finding lists all its places
    for k, entry in enumerate(ctx.option("Design.DuplicateExportName", "boundaries", [])):
        groups = groups.where(~_claimed(F.transform("m", lambda x: x["file"]), entry).alias(f"b{k}"))
    related = F.transform(F.slice("m", F.lit(2), F.col("n").cast("int") - 1), lambda x: F.struct(x["file"].alias("file"), x["span"].alias("span")))
    return groups.select(F.col("m")[0]["file"].alias("file"), F.col("m")[0]["span"].alias("span"), said("{} is exported from {} files", quoted("name"), "n").alias("message"), related.alias("related"))


def _claimed(files: Column, boundary: str) -> Column:
    """Whether every file takes a side of ``a | b | c`` that no file before it took, in order."""
    sides = [s.strip() for s in boundary.split("|") if s.strip()]
    if len(sides) < 2:
        return F.lit(False)

    def fits(path: Column, g: str) -> Column:
        hit = paths.matches(path, g)
        return hit if g.startswith(("**", "/")) else hit | paths.matches(path, f"**/{g}")

    def take(free: Column, path: Column) -> Column:
        open_ = [F.array_contains(free, k) & fits(path, g) for k, g in enumerate(sides)]
        first = F.coalesce(*[F.when(t, F.lit(k)) for k, t in enumerate(open_)])
        return F.when(first.isNull(), F.array(F.lit(-1))).otherwise(F.filter(free, lambda s: s != first))

    left = F.aggregate(files, F.array(*[F.lit(k) for k in range(len(sides))]), lambda free, p: F.when(F.array_contains(free, -1), free).otherwise(take(free, p)))
    return ~F.array_contains(left, -1)


@rule("Design.MissingTestFile", 4, "low", "A file with exports and no test.")
def missing_test_file(ctx: Context) -> DataFrame:
    me, facts, path = "Design.MissingTestFile", ctx.facts, F.col("file")
    tests, entries = tuple(ctx.option(me, "test_file_patterns", TEST_PARTS)), tuple(ctx.option(me, "framework_entry_patterns", FRAMEWORK_PARTS))
    templates = ctx.option(me, "test_match_patterns", TEST_TEMPLATES)
    _ = facts.stored  # marks are asked for below: files are read once
    known = facts.imports.select(F.col("from_file").alias("p")).union(facts.imports.where("resolved IS NOT NULL").select("resolved")).union(facts.exports.select("file")).distinct()
    real = facts.exports.where("NOT type_only AND kind IN ('named', 'default')").where(~paths.classified(path, tests) & ~paths.classified(path, entries))
    real = written(real.select("file", "name", "span"), "real-exports")
    # the folder and the stem of a path are taken once, not for each template
    folder = F.when(paths.dirname(path) == "", F.lit("")).otherwise(F.concat(paths.dirname(path), F.lit("/")))
    held = spread(real.select("file", "name", "span", folder.alias("folder"), paths.stem(path).alias("stem")), "file")
    anchors = held.groupBy("file", "folder", "stem").agg(F.min_by(F.struct("name", "span"), F.col("span.start_byte")).alias("a"))
    tries = anchors.select("file", F.explode(F.array(*[F.concat("folder", F.replace(F.lit(t), F.lit("{name}"), F.col("stem"))) for t in templates])).alias("p"))
    tested = tries.join(known, "p", "left_semi").select("file").distinct()
    asserted = real.join(asserted_names(ctx), ["file", "name"], "left_semi").select("file").distinct()
    left = anchors.join(tested, "file", "left_anti").join(asserted, "file", "left_anti")
    return left.select("file", F.col("a.span").alias("span"), said("`{}` is exported here but no matching test file was found in the project", F.col("a.name")).alias("message"))


def asserted_names(ctx: Context) -> DataFrame:
    """(file, name): exports whose type some file asserts (instanceof, toThrow), where it imports them
    from, and where that file re-exports them from, one hop."""
    marks = ctx.facts.marks.where("kind = 'asserted'").select(F.col("file").alias("from_file"), F.col("detail").alias("local_name")).distinct()
    met = ctx.facts.names.where("resolved IS NOT NULL AND NOT type_only").join(marks, ["from_file", "local_name"], "left_semi").select(F.col("resolved").alias("file"), F.col("source_name").alias("name")).distinct()
    hops = ctx.facts.exports.where("kind = 'reexport' AND resolved_source IS NOT NULL").select(F.col("file").alias("f"), F.col("name").alias("n"), F.col("resolved_source").alias("s"))
    hop = met.join(hops, (F.col("file") == F.col("f")) & ((F.col("name") == F.col("n")) | (F.col("n") == "*"))).select(F.col("s").alias("file"), "name")
    return met.union(hop).distinct()


def effect_of(specifier: Column, extra: list[str] = ()) -> Column:
    """The effectful module that a specifier names: itself, without ``node:``, or a part of it."""
    bare = F.regexp_replace(specifier, r"\Anode:", "")
    return F.coalesce(*[F.when((bare == m) | bare.startswith(m + "/"), F.lit(m)) for m in [*EFFECTS, *extra]])


@rule("Design.EffectLeakage", 8, "medium", "A file that says it is pure and reaches a module that acts on the world.")
def effect_leakage(ctx: Context) -> DataFrame:
    extra = list(ctx.option("Design.EffectLeakage", "extra_side_effect_modules", []))
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)\A(?:\s*(?:/\*.*?\*/|//[^\n]*))+", 0)
    pure = ctx.facts.files.where(head.rlike(r"(?m)^[ \t/*]*@pure(?:[ \t].*|[ \t*/]*)$")).select(F.col("path").alias("id")).distinct()
    imports = ctx.facts.imports
    outside = written(imports.where("resolved IS NULL").select(F.col("from_file").alias("id"), effect_of(F.col("specifier"), extra).alias("module")).where("module IS NOT NULL").distinct(), "effects")
    edges = imports.where("resolved IS NOT NULL").select(F.col("from_file").alias("src"), F.col("resolved").alias("dst"))
    reached = graph.reaching(edges, pure, outside.select("id"))
    module = outside.groupBy(F.col("id").alias("target")).agg(F.min("module").alias("module"))
    return reached.join(module, "target").select(F.col("id").alias("file"), whole_file().alias("span"), said("declared `@pure`, but transitively imports `{}`, a known side-effecting module", "module").alias("message"))
