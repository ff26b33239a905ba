"""What a rule is, where rules are kept, and how their findings become a report.

A rule takes the facts of all files and gives findings; its metadata are added by the run.  The run
unites the findings of all rules, takes away what overrides disable, then what directives silence,
gives each its severity and orders the rest.

Defined results: a rule without facts gives nothing; findings of files that cannot be read are one
Warning.ParseError each; findings that repeat are kept; an override without globs applies nowhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.facts import SPAN, Facts
from plumbline.functions import paths
from plumbline.operators import findings as fi
from plumbline.sources import suppressions

FINDING = f"check_id string, message string, file string, span {SPAN}, priority int, severity string, related array<struct<file:string,span:{SPAN}>>"
#: The place of a finding about a whole file.
WHOLE_FILE = {"start_byte": 0, "end_byte": 0, "line": 1, "column": 1}

#: Parts of paths of tests, and of files that a framework calls.
TEST_PARTS = (".test.", ".spec.", "_test.", "_spec.", "/__tests__/", "/__mocks__/")
FRAMEWORK_PARTS = tuple(
    "/page. /layout. /route. /error. /loading. /not-found. /default. /template. /global-error. /middleware. /instrumentation. /manifest. /robots. /sitemap. /icon. "
    "/apple-icon. /opengraph-image. /twitter-image. /favicon. /_app. /_document. /_error. /+page. /+layout. /+server. /next.config. /vite.config. /vitest.config. "
    "/tsup.config. /tailwind.config. /postcss.config. /astro.config. /svelte.config. /remix.config. /playwright.config. /jest.config. /rollup.config. /webpack.config. "
    "/babel.config. /eslint.config. /prettier.config.".split()
)


@dataclass
class Override:
    """For the files that ``globs`` match: options, severity or disabling of one check (None: all)."""

    globs: list[str]
    check_id: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    severity: str | None = None
    disabled: bool | None = None

    def test(self, path: Column) -> Column:
        return reduce(lambda a, b: a | b, [paths.matches(paths.normal(path), g, True) for g in self.globs], F.lit(False))


@dataclass
class Policy:
    """What a project declares."""

    layers: dict[str, list[str]] = field(default_factory=dict)
    allow: dict[str, list[str]] = field(default_factory=dict)
    frozen: list[tuple[str, str | None]] = field(default_factory=list)
    invariants: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    scripted: dict[str, dict[str, str]] = field(default_factory=dict)
    public_api: list[str] = field(default_factory=list)
    options: dict[str, dict[str, Any]] = field(default_factory=dict)
    severities: dict[str, str] = field(default_factory=dict)
    overrides: list[Override] = field(default_factory=list)
    budgets: dict[str, int] = field(default_factory=dict)
    disabled: list[str] = field(default_factory=list)
    context_suppress: list[tuple[str, list[str]]] = field(default_factory=list)
    knowledge: str | None = None


@dataclass
class Context:
    """What a rule may read: facts, the policy, the changes of the run, other findings, and slots in
    which rules leave tables for each other under a name of their own."""

    facts: Facts
    policy: Policy = field(default_factory=Policy)
    tool: str = suppressions.TOOL
    changes: DataFrame | None = None  # file, first_line, last_line
    pointers: list[str] = field(default_factory=list)  # public paths that the manifest names
    findings: DataFrame | None = None
    slots: dict[str, DataFrame] = field(default_factory=dict)
    types: DataFrame | None = None  # of a type checker (facts.Facts.types); else what files declare

    def option(self, check_id: str, name: str, default: Any) -> Any:
        return self.policy.options.get(check_id, {}).get(name, default)

    @cached_property
    def directives(self) -> DataFrame:
        from plumbline.cut import written

        return written(suppressions.scan(self.facts.files, self.tool), "directives")

    def is_public(self, path: Column) -> Column:
        pointers = F.array(*[F.lit(p) for p in self.pointers]) if self.pointers else None
        return paths.public(path, self.policy.public_api, pointers)


@dataclass(frozen=True)
class Rule:
    """A check: its id, how much it matters, and what gives its findings."""

    id: str
    priority: int
    severity: str
    explanation: str
    evaluate: Callable[[Context], DataFrame]
    languages: tuple[str, ...] = ("typescript",)
    observes: bool = False  # looks at the findings of others
    enabled: bool = True
    extensions: tuple[str, ...] = ()
    layers: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    autofix: Callable[[Context], DataFrame] | None = None

    @property
    def category(self) -> str:
        return self.id.partition(".")[0]

    def applies(self, path: Column, layers: dict[str, list[str]]) -> Column:
        """Whether the rule looks at a path: its extension, its layer, its globs."""
        out = F.lit(True)
        if self.extensions:
            out = out & F.regexp_extract(path, r"\.([^./]*)\z", 1).isin([e.lstrip(".") for e in self.extensions])
        if self.layers:
            out = out & F.coalesce(paths.layer_of(path, layers).isin(list(self.layers)), F.lit(False))
        if self.include:
            out = out & reduce(lambda a, b: a | b, [paths.matches(path, g, True) for g in self.include])
        for g in self.exclude:
            out = out & ~paths.matches(path, g, True)
        return out


REGISTRY: dict[str, Rule] = {}


def rule(id: str, priority: int, severity: str, explanation: str, **more: Any) -> Callable[[Callable[[Context], DataFrame]], Callable[[Context], DataFrame]]:
    """Registers a function that gives ``file``, ``span``, ``message`` and, if it likes, ``related``."""

    def add(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if severity not in fi.SEVERITIES:
            raise ValueError(f"unknown severity {severity!r}")
        REGISTRY[id] = Rule(id, priority, severity, explanation, f, **more)
        return f

    return add


def whole_file() -> Column:
    return F.struct(*[F.lit(v).cast("int").alias(k) for k, v in WHOLE_FILE.items()])


def finding_rows(r: Rule, rows: DataFrame) -> DataFrame:
    """The rows as findings of the rule, with its priority and severity."""
    no_related = F.array().cast(f"array<struct<file:string,span:{SPAN}>>")
    related = F.col("related").cast(f"array<struct<file:string,span:{SPAN}>>") if "related" in rows.columns else no_related
    return rows.select(F.lit(r.id).alias("check_id"), "message", "file", F.col("span").cast(SPAN).alias("span"), F.lit(r.priority).alias("priority"), F.lit(r.severity).alias("severity"), related.alias("related"))


def run_rule(check_id: str, ctx: Context) -> DataFrame:
    """Findings of one rule, as it gives them, inside its own scope."""
    r = REGISTRY[check_id]
    out = finding_rows(r, r.evaluate(ctx))
    if r.extensions or r.layers or r.include or r.exclude:
        out = out.where(r.applies(F.col("file"), ctx.policy.layers))
    return out


def parse_errors(ctx: Context) -> DataFrame:
    r = Rule("Warning.ParseError", 20, "high", "The file could not be read as a program.", lambda c: c.facts.errors)
    return finding_rows(r, ctx.facts.errors.select("file", F.concat(F.lit("parse error: "), "error").alias("message"), whole_file().alias("span")))


def run(ctx: Context, only: list[str] | None = None) -> DataFrame:
    """The report: findings after overrides, directives and severities, in order."""
    from plumbline.cut import written

    chosen = [r for r in REGISTRY.values() if (r.id in only if only is not None else r.enabled) and r.id not in ctx.policy.disabled and not r.id.startswith("Context.")]
    _ = ctx.facts.stored  # several rules: each file is read once, with all its facts
    parts = [run_rule(r.id, ctx) for r in chosen if not r.observes] + [parse_errors(ctx)]
    first = written(reduce(DataFrame.unionByName, parts), "findings")
    ctx.findings = first
    watching = [run_rule(r.id, ctx) for r in chosen if r.observes]
    found = reduce(DataFrame.unionByName, watching, first)
    return report(found, ctx.directives, ctx.policy)


def report(found: DataFrame, directives: DataFrame, policy: Policy) -> DataFrame:
    """Overrides that disable, then directives, then severities, then order."""
    path, check = F.col("file"), F.col("check_id")
    off = F.lit(False)
    severity = F.col("severity")
    for check_id, value in policy.severities.items():
        severity = F.when(check == check_id, F.lit(value)).otherwise(severity)
    for o in policy.overrides:
        applies = o.test(path) if o.check_id is None else o.test(path) & (check == o.check_id)
        if o.disabled is not None:
            off = F.when(applies, F.lit(o.disabled)).otherwise(off)
        if o.severity is not None:
            severity = F.when(applies, F.lit(o.severity)).otherwise(severity)
    left = found.where(~off)
    places = left.withColumn("line", F.col("span.line")).withColumn("__row", F.struct(*[F.col(c) for c in left.columns]))
    places = places.withColumn("related", F.transform("related", lambda r: F.struct(r["file"].alias("file"), r["span"]["line"].alias("line"))))
    bands = directives.select("file", "check_id", F.col("line_from").alias("first_line"), F.col("line_to").alias("last_line"))
    kept = fi.suppressed(places.select("check_id", "file", "line", "related", "__row"), bands).select("__row.*")
    return ordered(kept.withColumn("severity", severity))


def ordered(found: DataFrame) -> DataFrame:
    """Priority falling, then check, file and line; place and message break ties."""
    return found.orderBy(F.desc("priority"), "check_id", "file", "span.line", "span.start_byte", "message")


def summary(found: DataFrame) -> DataFrame:
    """Counts by category and severity."""
    return found.groupBy(paths.category(F.col("check_id")).alias("category"), "severity").agg(F.count("*").alias("n"))


def advisory(files: DataFrame, policy: Policy, rules: list[Rule] | None = None) -> DataFrame:
    """path, check_id, severity, layer, public: every rule that applies to a path, without analysis.

    The rules are a list of fixed length in each row, taken apart in place: no join."""
    path = F.col("path")
    rules = list(REGISTRY.values()) if rules is None else rules
    from plumbline.facts import LANGUAGES

    language = F.lit("other")
    for ext, name in LANGUAGES.items():
        language = F.when(F.lower(path).endswith(ext), F.lit(name)).otherwise(language)
    each = F.array(*[F.when(language.isin(list(r.languages)) & r.applies(path, policy.layers) & F.lit(r.id not in policy.disabled), F.struct(F.lit(r.id).alias("check_id"), F.lit(policy.severities.get(r.id, r.severity)).alias("severity"))) for r in rules])
    return files.select("path", paths.layer_of(path, policy.layers).alias("layer"), paths.public(path, policy.public_api).alias("public"), F.explode(F.array_compact(each)).alias("x")).select("path", "x.check_id", "x.severity", "layer", "public")


def quoted(name: Column | str) -> Column:
    return F.concat(F.lit("`"), F.col(name) if isinstance(name, str) else name, F.lit("`"))


def said(template: str, *values: Column | str) -> Column:
    """A message: columns in the places of ``{}``."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:], strict=True):
        out += [(F.col(v) if isinstance(v, str) else v).cast("string"), F.lit(p)]
    return F.concat(*out)
