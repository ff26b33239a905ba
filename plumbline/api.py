"""What a caller asks for: a check of a folder, advice on paths, what an edit would change, what a rule
means, what a project declares."""

from __future__ import annotations

import posixpath
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import rules
from plumbline.facts import Facts
from plumbline.operators import findings as fi
from plumbline.rules import context, duplicates, imports, packages, places  # noqa: F401  (registers the rules)
from plumbline.rules.base import advisory
from plumbline.sinks import reports, stores
from plumbline.sources import config, discover
from plumbline.sources import packages as package_source


def open_project(spark: SparkSession, root: str, policy: rules.Policy | None = None) -> rules.Context:
    """The files below ``root`` and the policy that is declared there, or the one given."""
    policy = policy or config.load(root)
    files = discover.discover(spark, root, extensions=(*discover.EXTENSIONS, "md", "mdx", "js", "jsx", "mjs", "cjs"))
    manifest = discover.discover(spark, root, extensions=("json",)).where("path = 'package.json'").select("text").first() if policy.public_api else None
    pointers, _ = config.manifest_paths(manifest["text"] if manifest else None, policy.public_api)
    return rules.Context(Facts(files.select("path", "text")), policy, pointers=pointers)


def check(ctx: rules.Context, only: list[str] | None = None) -> DataFrame:
    """The report of a project."""
    return rules.run(ctx, only)


def check_packages(spark: SparkSession, root: str) -> DataFrame:
    """The report of the packages below ``root``."""
    files = discover.discover(spark, root, extensions=("toml", "md", "pdf"))
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "LICENSE").load(root)
    full = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = full.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(full).toUri().getPath()
    licenses = named.select(F.regexp_replace("path", rf"\A\w+:/*{posixpath.normpath(full)}/*".replace("/*/", "/+"), "").alias("path"), F.col("content").cast("string").alias("text"))
    return packages.run(package_source.packages(files.select("path", "text").unionByName(licenses)))


def advise(files: DataFrame, policy: rules.Policy) -> DataFrame:
    """path, line: what applies to each path (path, ...), as JSON, without analysis."""
    return reports.advisory_envelope(advisory(files, policy))


def advise_diff(before: rules.Context, after: rules.Context, only: list[str] | None = None) -> DataFrame:
    """file, check_id, rule_signature, change: findings that an edit would bring (fire) or take away
    (clear), by the text they are about."""
    a = stores.baseline_rows(rules.run(before, only), before.facts.files)
    b = stores.baseline_rows(rules.run(after, only), after.facts.files)
    return fi.would_fire_clear(a, b, "file", "check_id", "rule_signature")


def explain(check_id: str) -> dict:
    return reports.explain(check_id)


def invariants(policy: rules.Policy) -> dict:
    return reports.invariants(policy)


def digest(ctx: rules.Context, budget: int, notes: list[config.Note] = ()) -> DataFrame:
    """The items of a change that fit a budget of tokens, pinned ones first; ``ctx.findings`` are those
    of the run, before directives."""
    if ctx.findings is None:
        rules.run(ctx)
    return fi.digest(context.items(ctx, notes), budget, least=context.ENVELOPE_TOKENS)


def timed(ctx: rules.Context, only: list[str] | None = None) -> DataFrame:
    """check_id, seconds, n: how long each rule takes by itself, and how many findings it gives.  Every
    rule is a job of its own here; a report runs them together."""
    ctx.facts.stored, ctx.facts.imports, ctx.facts.exports  # noqa: B018  (stored once, and not counted)
    rows = []
    for r in rules.REGISTRY.values():
        if r.observes or (only is not None and r.id not in only):
            continue
        began = time.monotonic()
        n = rules.run_rule(r.id, ctx).count()
        rows.append((r.id, time.monotonic() - began, n))
    return ctx.facts.files.sparkSession.createDataFrame(rows, "check_id string, seconds double, n long")
