"""Rules on single places, functions and lines.

Defined results for all of them: nothing in files that cannot be read; places that repeat count
each; a limit is passed only by more than it.  Messages are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import texts
from plumbline.operators import findings as fi
from plumbline.operators import stats
from plumbline.lang.prose import SPELLINGS
from plumbline.rules.base import REGISTRY, Context, quoted, rule, said
from plumbline.sources import suppressions


def _marks(ctx: Context, kind: str) -> DataFrame:
    return ctx.facts.marks.where(F.col("kind") == kind).select("file", "ordinal", "detail", "span")


def _functions(ctx: Context) -> DataFrame:
    name = F.when(F.col("name") == "", F.lit("anonymous function")).otherwise(said("function `{}`", "name"))
    return ctx.facts.functions.withColumn("shown", name)


@rule("Warning.NoConsoleLog", -10, "low", "A call of console.log.")
def no_console_log(ctx: Context) -> DataFrame:
    methods = list(ctx.option("Warning.NoConsoleLog", "methods", ["log"]))
    return _marks(ctx, "console").where(F.col("detail").isin(methods)).select("file", "span", said("remove `console.{}` call (use a logger or strip in CI)", "detail").alias("message"))


@rule("Warning.NoDebugger", 10, "medium", "A debugger statement.")
def no_debugger(ctx: Context) -> DataFrame:
    return _marks(ctx, "debugger").select("file", "span", F.lit("remove `debugger` statement").alias("message"))


@rule("Warning.NoEval", 18, "high", "A call that runs a text as code.")
def no_eval(ctx: Context) -> DataFrame:
    message = F.when(F.col("detail") == "eval", F.lit("avoid `eval(...)` — executes arbitrary strings as code")).otherwise(F.lit("avoid `new Function(...)` — eval-equivalent code execution"))
    return _marks(ctx, "eval").select("file", "span", message.alias("message"))


def equals_edits(ctx: Context) -> DataFrame:
    """(file, start_byte, end_byte, text): each loose comparison made strict."""
    return _marks(ctx, "loose").select("file", "span.start_byte", "span.end_byte", F.concat("detail", F.lit("=")).alias("text"))


@rule("Warning.TripleEquals", 15, "high", "A loose comparison, but for one with null.", autofix=equals_edits)
def triple_equals(ctx: Context) -> DataFrame:
    return _marks(ctx, "loose").select("file", "span", said("use `{}` instead of `{}`", F.concat("detail", F.lit("=")), "detail").alias("message"))


@rule("Refactor.PreferOptionalChain", 5, "low", "A value tested and then asked for a member.")
def optional_chain(ctx: Context) -> DataFrame:
    return _marks(ctx, "optional").select("file", "span", F.lit("prefer optional chain `?.` over repeated `&&`").alias("message"))


@rule("Refactor.PreferNullishCoalescing", 3, "low", "A default given by ||.")
def nullish(ctx: Context) -> DataFrame:
    return _marks(ctx, "nullish").select("file", "span", F.lit('prefer nullish coalescing `??` for default values (`||` falls through on `0`/`""`/`false`)').alias("message"))


@rule("Refactor.PreferConstOverLet", -5, "low", "A let that is never assigned again.")
def prefer_const(ctx: Context) -> DataFrame:
    return _marks(ctx, "let").select("file", "span", said("{} is declared with `let` but never reassigned — use `const`", quoted("detail")).alias("message"))


@rule("Consistency.QuoteStyle", -5, "info", "A quote other than the file's own.")
def quote_style(ctx: Context) -> DataFrame:
    seen = _marks(ctx, "quote").withColumn("single", F.col("detail").startswith("single"))
    votes = stats.local_majority(seen, "file", F.col("single")).where("majority IS NOT NULL").select("file", "majority")
    odd = seen.join(votes, "file").where((F.col("single") != F.col("majority")) & ~F.col("detail").endswith("forced"))
    name = F.when(F.col("majority"), F.lit("single")).otherwise(F.lit("double"))
    return odd.select("file", "span", said("use {} quotes consistently (dominant style in this file)", name).alias("message"))


@rule("Consistency.BroadSuppression", 0, "info", "A directive that silences every check.", languages=("typescript", "astro", "rust", "html", "markdown"))
def broad_suppression(ctx: Context) -> DataFrame:
    found = suppressions.scan_broad(ctx.facts.files, ctx.tool)
    t = ctx.tool
    message = f"Broad `// {t}-ignore` (no check id) — narrow it to a specific id. Accepted forms: `// {t}-ignore: <CheckId>: <reason>` or `// {t}-ignore <CheckId> — <reason>`."
    return found.select("file", F.struct("start_byte", "end_byte", "line", "column").alias("span"), F.lit(message).alias("message"))


@rule("Consistency.UnusedSuppression", -5, "low", "A directive that silences nothing.", observes=True, languages=("typescript", "astro", "rust", "html", "markdown"))
def unused_suppression(ctx: Context) -> DataFrame:
    own = ctx.directives.where("scoped").where(F.col("check_id").isin(list(REGISTRY)))
    bands = own.withColumnsRenamed({"line_from": "first_line", "line_to": "last_line"})
    found = ctx.findings.select("check_id", "file", F.col("span.line").alias("line"))
    stale = fi.stale_directives(bands, found)
    span = F.struct("start_byte", "end_byte", "line", F.lit(1).alias("column"))
    return stale.select("file", span.alias("span"), said("suppression directive for `{}` covers no findings — the directive is stale", "check_id").alias("message"))


@rule("Consistency.SpellingDialect", -5, "info", "A spelling other than the project's own.", languages=("typescript", "astro", "markdown"))
def spelling_dialect(ctx: Context) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for p in SPELLINGS.items() for x in p])
    back = F.create_map(*[F.lit(x) for a, b in SPELLINGS.items() for x in (b, a)])
    low = F.lower("word")
    seen = ctx.facts.words.withColumn("british", pairs[low].isNotNull()).withColumn("other", F.coalesce(pairs[low], back[low]))
    pinned = ctx.option("Consistency.SpellingDialect", "dialect", "infer")
    if pinned in ("british", "american"):
        right = F.lit(pinned == "british")
    else:
        yes, no = F.count_if(F.col("british")), F.count_if(~F.col("british"))
        verdict = F.when((yes + no >= 8) & (yes > F.floor((yes + no) / 2)) & (yes > no), F.lit(True)).when((yes + no >= 8) & (no > F.floor((yes + no) / 2)) & (no > yes), F.lit(False))
        right = seen.agg(verdict).scalar()
    held = seen.withColumn("right", right)
    label = lambda c: F.when(c, F.lit("British")).otherwise(F.lit("American"))
    message = said("`{}` is the {} spelling; the project uses {} elsewhere — write `{}`", "word", label(F.col("british")), label(F.col("right")), texts.leading_case(F.col("word"), F.col("other")))
    return held.where(F.col("british") != F.col("right")).select("file", "span", message.alias("message"))


@rule("Consistency.ErrorHandlingIdiom", -5, "info", "A function that fails in another way than most of the project's.")
def error_idiom(ctx: Context) -> DataFrame:
    failing = ctx.facts.functions.where("(throws > 0) <> (returns_error > 0)").withColumn("throwing", F.col("throws") > 0)
    yes, no = F.count_if(F.col("throwing")), F.count_if(~F.col("throwing"))
    verdict = F.when((yes + no >= 4) & (yes > F.floor((yes + no) / 2)), F.lit(True)).when((yes + no >= 4) & (no > F.floor((yes + no) / 2)), F.lit(False))
    held = failing.withColumn("right", failing.agg(verdict).scalar()).where(F.col("throwing") != F.col("right"))
    message = F.when(F.col("right"), F.lit("this function returns an error object; the project throws elsewhere")).otherwise(F.lit("this function throws; the project returns error objects elsewhere"))
    return held.select("file", "span", message.alias("message"))


@rule("Readability.MaxLineLength", -5, "low", "A line wider than the limit.", languages=("typescript", "astro", "rust", "html", "markdown", "other"))
def max_line_length(ctx: Context) -> DataFrame:
    limit = int(ctx.option("Readability.MaxLineLength", "limit", 120))
    rows = ctx.facts.lines.where(F.octet_length("text") > limit)
    if not ctx.option("Readability.MaxLineLength", "report_unwrappable", False):
        # a line with one word (or literal) wider than the limit cannot be broken to fit
        widest = F.array_max(F.transform(F.regexp_extract_all(F.col("text"), F.lit(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`[^`]*`|\S+'), F.lit(0)), F.char_length))
        rows = rows.where(F.coalesce(widest, F.lit(0)) + F.char_length(F.regexp_extract("text", r"\A\s*", 0)) <= limit)
    wide = rows.withColumn("width", texts.width_of(F.col("text"))).where(F.col("width") > limit)
    wide = wide.where(~F.col("text").rlike(rf"\A\s*(//|/\*)\s*{ctx.tool}-(ignore|disable|enable)"))
    span = F.struct("start_byte", (F.col("start_byte") + F.octet_length("text")).cast("int").alias("end_byte"), "line", F.lit(limit + 1).alias("column"))
    return wide.select(F.col("path").alias("file"), span.alias("span"), said("line is {} columns, exceeds limit of {}", "width", F.lit(limit)).alias("message"))


@rule("Readability.MaxFunctionLength", -5, "low", "A function with more lines of code than the limit.")
def max_function_length(ctx: Context) -> DataFrame:
    limit = int(ctx.option("Readability.MaxFunctionLength", "limit", 50))
    return _functions(ctx).where(F.col("lines") > limit).select("file", "span", said("{} is {} lines (excluding blanks and comments), exceeds limit of {}", "shown", "lines", F.lit(limit)).alias("message"))


@rule("Design.MaxParameters", 5, "medium", "A function with more parameters than the limit.")
def max_parameters(ctx: Context) -> DataFrame:
    limit = int(ctx.option("Design.MaxParameters", "limit", 5))
    return _functions(ctx).where(F.col("params") > limit).select("file", "span", said("{} has {} parameters, exceeds limit of {}", "shown", "params", F.lit(limit)).alias("message"))


@rule("Refactor.CyclomaticComplexity", 8, "medium", "A function with more branches than the limit.")
def cyclomatic(ctx: Context) -> DataFrame:
    limit = int(ctx.option("Refactor.CyclomaticComplexity", "limit", 10))
    return _functions(ctx).where(F.col("cyclomatic") > limit).select("file", "span", said("{} has cyclomatic complexity {}, exceeds limit of {}", "shown", "cyclomatic", F.lit(limit)).alias("message"))


@rule("Refactor.LongAndComplex", 12, "high", "A function both long and full of branches.")
def long_and_complex(ctx: Context) -> DataFrame:
    lines, branches = int(ctx.option("Refactor.LongAndComplex", "lines", 75)), int(ctx.option("Refactor.LongAndComplex", "cyclomatic", 15))
    rows = _functions(ctx).where((F.col("lines") > lines) & (F.col("cyclomatic") > branches))
    return rows.select("file", "span", said("{} is long ({} lines) AND complex (cyclomatic {}) — exceeds {}/{}", "shown", "lines", "cyclomatic", F.lit(lines), F.lit(branches)).alias("message"))


@rule("Refactor.MixedThrowAndReturnError", -5, "low", "A function that fails in two ways.")
def mixed_errors(ctx: Context) -> DataFrame:
    return _functions(ctx).where("mixed").select("file", "span", said("{} both throws and returns an error-shaped object — pick one error-handling idiom", "shown").alias("message"))


@rule("Refactor.CognitiveComplexity", 10, "medium", "A function that is hard to follow.")
def cognitive(ctx: Context) -> DataFrame:
    limit = int(ctx.option("Refactor.CognitiveComplexity", "limit", 15))
    return _functions(ctx).where(F.col("cognitive") > limit).select("file", "span", said("{} has cognitive complexity {}, exceeds limit of {}", "shown", "cognitive", F.lit(limit)).alias("message"))


def _two(ctx: Context, kind: str) -> DataFrame:
    """Marks whose detail is a name, and what is said of it."""
    cut = F.instr("detail", F.lit(" "))
    return _marks(ctx, kind).select("file", "span", F.left("detail", cut - 1).alias("name"), F.substr("detail", cut + 1).alias("rest"))


@rule("Refactor.UnusedVariable", 10, "low", "A local that nothing reads.")
def unused_variable(ctx: Context) -> DataFrame:
    return _marks(ctx, "unused").select("file", "span", said("{} is declared but never read (prefix with `_` if intentional)", quoted("detail")).alias("message"))


@rule("Refactor.MutatedParameter", 10, "medium", "A parameter that its function changes.")
def mutated_parameter(ctx: Context) -> DataFrame:
    return _two(ctx, "mutated").select("file", "span", said("parameter {} is {} inside the function body", quoted("name"), "rest").alias("message"))


@rule("Design.ReadonlyArrayParam", 5, "low", "An array taken to be changed, and never changed.")
def readonly_array(ctx: Context) -> DataFrame:
    return _two(ctx, "readonly").select("file", "span", said("parameter {} is never mutated — consider {} for a type-checker-enforced guarantee", quoted("name"), quoted("rest")).alias("message"))


@rule("Refactor.PreferArrayMethodOverLoop", -5, "low", "A loop that only pushes.")
def array_method(ctx: Context) -> DataFrame:
    return _two(ctx, "loop").select("file", "span", said("this loop only builds {} by pushing one computed value per iteration — could be written with `.{}()`", quoted("name"), "rest").alias("message"))


@rule("Refactor.SideEffectInMapCallback", -5, "low", "A callback that should compute only.")
def map_effect(ctx: Context) -> DataFrame:
    return _marks(ctx, "map_effect").select("file", "span", said("`.{}` callback has a side effect (mutates outer-scope state or calls `console.*`) instead of purely computing a value", "detail").alias("message"))


@rule("Refactor.PurityHeuristic", -10, "low", "An exported function that reads the module's changing state.", enabled=False)
def purity(ctx: Context) -> DataFrame:
    return _two(ctx, "hidden").select("file", "span", said("exported function {} reads module-level mutable state ({}) not covered by its parameter list — a hidden dependency working against unit-testability", quoted("name"), "rest").alias("message"))


@rule("Design.ClassAsDataBag", -5, "low", "A class that only holds fields.")
def data_bag(ctx: Context) -> DataFrame:
    return _marks(ctx, "data_bag").select("file", "span", said("class {} has no behavior beyond storing fields — consider a plain type/interface instead", quoted("detail")).alias("message"))


def _typed(ctx: Context, kind: str) -> DataFrame:
    """Marks on a value, with what is known of its type: an equi-join on the value's bytes."""
    parts = F.split("detail", "\n")
    place = F.split(F.get(parts, 0), " ")
    rows = _marks(ctx, kind).select("file", "span", F.slice(parts, F.lit(2), F.size(parts) - 1).alias("rest"), F.get(place, 0).cast("int").alias("start_byte"), F.get(place, 1).cast("int").alias("end_byte"))
    return rows.join(ctx.types if ctx.types is not None else ctx.facts.types, ["file", "start_byte", "end_byte"])


@rule("Design.UnionExhaustivenessGap", 8, "medium", "A switch that forgets a member of its union.")
def exhaustiveness(ctx: Context) -> DataFrame:
    rows = _typed(ctx, "switch").where((F.size("members") > 0) & (F.get("rest", 0) == ""))
    missing = F.array_except("members", "rest")
    message = said("switch over a discriminated union doesn't handle every variant and has no default case — missing: {}", F.array_join(missing, ", "))
    return rows.where(F.size(missing) > 0).select("file", "span", message.alias("message"))


@rule("Warning.UnusedNullCheck", 15, "low", "A test for what a type excludes.")
def unused_null_check(ctx: Context) -> DataFrame:
    rows = _typed(ctx, "null_test").where("NOT any")
    what, strict = F.get("rest", 0), F.get("rest", 1) == "strict"
    redundant = F.when(~strict, ~F.col("null") & ~F.col("undefined")).when(what == "null", ~F.col("null")).otherwise(~F.col("undefined"))
    excluded = F.when(strict, what).otherwise(F.lit("null or undefined"))
    return rows.where(redundant).select("file", "span", said("redundant nullish check — value is typed `{}`, which already excludes {}", "text", excluded).alias("message"))


# ---------------------------------------------------------------- other languages


@rule("Rust.NoUnwrapInLib", 12, "medium", "A call of unwrap outside of tests.", languages=("rust",))
def no_unwrap(ctx: Context) -> DataFrame:
    message = '`.unwrap()` in library code panics with no diagnostic context; return `Result` and propagate via `?` or use `.expect("<reason>")` when the value is provably infallible.'
    return _marks(ctx, "rust_unwrap").select("file", "span", F.lit(message).alias("message"))


@rule("Rust.NoUnimplementedInNonTest", 14, "high", "A macro that stops the program, outside of tests.", languages=("rust",))
def no_unimplemented(ctx: Context) -> DataFrame:
    return _marks(ctx, "rust_stop").select("file", "span", said("`{}!()` panics at runtime; implement the function or move the call into a `#[test]`.", "detail").alias("message"))


@rule("Rust.MissingPubDoc", 4, "low", "A public item without a doc comment.", languages=("rust",))
def missing_pub_doc(ctx: Context) -> DataFrame:
    kind, name = F.split_part("detail", F.lit(" "), F.lit(1)), F.split_part("detail", F.lit(" "), F.lit(2))
    return _marks(ctx, "rust_pub").select("file", "span", said("public {} `{}` is missing a `///` doc comment.", kind, name).alias("message"))


@rule("Html.MissingLangAttribute", 12, "medium", "A page whose root element names no language.", languages=("html",))
def missing_lang(ctx: Context) -> DataFrame:
    """Of the first ``<html>`` tag outside of comments; a page without one has no finding.  The place
    is found natively: what stands before the tag tells its line and column."""
    pages = ctx.facts.files.where(F.lower(F.col("path")).rlike(r"\.html?\z"))
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)<!--.*?-->|(?i)(?<=<script)[^<]*(?=</script)", "")
    tag = F.regexp_extract(bare, r"(?is)<html(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*|)>", 0)
    held = pages.select("path", "text", tag.alias("tag")).where("tag <> ''").where(~F.col("tag").rlike(r"(?is)\A<html(?:\s|\"[^\"]*\"|'[^']*'|[^\s\"'>])*?\slang(?:\s|=|>|/)"))
    at = F.instr("text", F.col("tag"))
    before = F.substr("text", F.lit(1), at - 1)
    start, line = F.octet_length(before), F.regexp_count(before, F.lit("\n")) + 1
    span = F.struct(start.cast("int").alias("start_byte"), (start + F.octet_length("tag")).cast("int").alias("end_byte"), line.cast("int").alias("line"), (F.octet_length(F.element_at(F.split(before, "\n"), -1)) + 1).cast("int").alias("column"))
    message = "<html> element has no `lang` attribute; add one (e.g. `lang=\"en\"`) so assistive technology and search engines know the page's language."
    return held.select(F.col("path").alias("file"), span.alias("span"), F.lit(message).alias("message"))


def longest(ctx: Context) -> DataFrame:
    """file, longest_line, longest_function, most_params, most_branches: the extremes of each file."""
    of_lines = ctx.facts.lines.groupBy(F.col("path").alias("file")).agg(F.max(texts.width_of(F.col("text"))).alias("longest_line"))
    of_functions = ctx.facts.functions.groupBy("file").agg(F.max("lines").alias("longest_function"), F.max("params").alias("most_params"), F.max("cyclomatic").alias("most_branches"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("longest_function", "most_params", "most_branches")}
    return of_lines.join(of_functions, "file", "left").withColumns(zero)


def categories() -> dict[str, int]:
    """How many rules each category has."""
    out: dict[str, int] = {}
    for r in REGISTRY.values():
        out[r.category] = out.get(r.category, 0) + 1
    return out


