"""Findings as reports.

Line reports (text, compact, JSON rows) are columns of one string per finding, written by executors in
order; a SARIF file is one document and is made by a single task from its stored findings, as the
format asks.  Defined results: paths have forward slashes; related places are in order; a finding
without a known rule is of category 'unknown'; an empty report has its header alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, texts
from plumbline.rules.base import REGISTRY, Rule, said

DOCS = "https://docs.example.org/checks"
TOOL = "plumbline"
#: Fixed values of the formats.
COMPACT_HEADER = "priority|severity|category|id|file|line|column|message"
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
_LEVELS = {"info": "note", "low": "note", "medium": "warning", "high": "error", "critical": "error"}


def _category() -> Column:
    return F.lower(paths.category(F.col("check_id")))


def text_lines(findings: DataFrame, baseline: bool = False) -> DataFrame:
    """line: ``file:line:column severity check message``, with ``[baselined]`` where the findings carry
    ``in_baseline`` and it is asked for."""
    tag = F.when(F.col("in_baseline"), F.lit(" [baselined]")).otherwise(F.lit("")) if baseline else F.lit("")
    place = said("{}:{}:{}", paths.normal(F.col("file")), F.col("span.line"), F.col("span.column"))
    more = F.when(F.size("related") > 0, said(" (+{} more)", F.size("related"))).otherwise(F.lit(""))
    return findings.select(F.concat(place, F.lit(" "), F.col("severity"), F.lit(" "), F.col("check_id"), F.lit(" "), F.col("message"), more, tag).alias("line"))


def compact_lines(findings: DataFrame) -> DataFrame:
    """line: the fields of COMPACT_HEADER, joined by bars; bars and line breaks of messages are blanks."""
    clean = F.regexp_replace("message", r"[|\r\n]+", " ")
    return findings.select(F.concat_ws("|", "priority", "severity", _category(), "check_id", paths.normal(F.col("file")), "span.line", "span.column", clean).alias("line"))


def json_rows(findings: DataFrame, baseline: bool = False, docs: str | None = DOCS) -> DataFrame:
    """line: a flat JSON object per finding."""
    related = F.transform("related", lambda r: F.struct(paths.normal(r["file"]).alias("file"), r["span"]["line"].alias("line"), r["span"]["column"].alias("column"), r["span"]["start_byte"].alias("start_byte"), r["span"]["end_byte"].alias("end_byte")))
    known = F.col("check_id").isin(list(REGISTRY))
    fields = [
        F.col("check_id").alias("id"),
        _category().alias("category"),
        F.when(known, texts.docs_url(F.col("check_id"), docs)).alias("docs_url") if docs else F.lit(None).cast("string").alias("docs_url"),
        "priority",
        "severity",
        paths.normal(F.col("file")).alias("file"),
        F.col("span.line").alias("line"),
        F.col("span.column").alias("column"),
        F.col("span.start_byte").alias("start_byte"),
        F.col("span.end_byte").alias("end_byte"),
        "message",
        F.when(F.size("related") > 0, related).alias("related"),
    ]
    if baseline:
        fields.append(F.col("in_baseline").alias("baselined"))
    return findings.select(F.to_json(F.struct(*fields)).alias("line"))  # nulls are left out


def summary(findings: DataFrame) -> dict[str, int]:
    """Counts by severity and in all: at most a row per severity."""
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return {"total": sum(counts.values())} | dict(sorted(counts.items()))


def json_report(findings: DataFrame, baseline: bool = False) -> str:
    """The whole report as one document, of findings that were limited before."""
    rows = [json.loads(r["line"]) for r in json_rows(findings, baseline).collect()]
    return json.dumps({"findings": rows, "summary": summary(findings)}, ensure_ascii=False)


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Text files below ``path``, in the order of ``lines``; the header, if any, is a file before them."""
    lines.write.mode("overwrite").text(path)
    if header is not None:
        spark = lines.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header.txt")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray((header + "\n").encode()))
        out.close()


def _rule(r: Rule | None, check_id: str) -> dict:
    if r is None:
        return {"id": check_id, "name": check_id.rpartition(".")[2], "shortDescription": {"text": "(no metadata available)"}, "fullDescription": {"text": "(no metadata available)"}, "defaultConfiguration": {"level": "warning"}, "properties": {"category": "unknown", "priority": 0, "tags": ["unknown"]}}
    category = r.category.lower()
    return {"id": r.id, "name": r.id.rpartition(".")[2], "shortDescription": {"text": r.explanation}, "fullDescription": {"text": r.explanation}, "defaultConfiguration": {"level": _LEVELS[r.severity]}, "properties": {"category": category, "priority": r.priority, "tags": [category]}, "helpUri": f"{DOCS}/{r.id}"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """line: one SARIF result per finding, as JSON, made by executors."""
    level = F.create_map(*[F.lit(x) for p in _LEVELS.items() for x in p])[F.col("severity")]

    def location(file: Column, span: Column) -> Column:
        region = F.struct(span["line"].alias("startLine"), F.greatest(span["column"], F.lit(1)).alias("startColumn"), span["start_byte"].alias("byteOffset"), (span["end_byte"] - span["start_byte"]).alias("byteLength"))
        return F.struct(F.struct(F.struct(paths.normal(file).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))

    own = F.struct(
        F.col("check_id").alias("ruleId"),
        level.alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(location(F.col("file"), F.col("span"))).alias("locations"),
        F.when(F.size("related") > 0, F.transform("related", lambda r: location(r["file"], r["span"]))).alias("relatedLocations"),
        F.struct(F.sha2(F.concat_ws("|", "check_id", paths.normal(F.col("file")), "message"), 256).alias("primaryLocation")).alias("partialFingerprints"),
    )
    return findings.select(F.to_json(own).alias("line"))


def sarif(findings: DataFrame, rules: Iterable[Rule] | None = None) -> str:
    """The document, of findings that were limited before: its rules are those that occur."""
    known = {r.id: r for r in (REGISTRY.values() if rules is None else rules)}
    used = sorted(r["check_id"] for r in findings.select("check_id").distinct().collect())  # at most a row per rule
    results = [json.loads(r["line"]) for r in sarif_results(findings).collect()]
    driver = {"name": TOOL, "version": "1.0", "rules": [_rule(known.get(c), c) for c in used]}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": driver}, "results": results}]}, ensure_ascii=False)


def diagnostics(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file and its diagnostics in order: a row for every known file, also without any."""
    one = F.struct(F.col("span.line").alias("line"), F.col("span.column").alias("column"), "check_id", "severity", "message")
    held = findings.groupBy(F.col("file").alias("__f")).agg(F.array_sort(F.collect_list(one)).alias("diagnostics"))  # one file's
    met = files.select(F.col("path").alias("file")).distinct().join(held, F.col("file") == F.col("__f"), "left").drop("__f")
    return met.withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast(held.schema["diagnostics"].dataType)))


def advisory_envelope(advice: DataFrame) -> DataFrame:
    """path, line: the constraints of each path as JSON, from ``rules.base.advisory``."""
    one = F.struct(F.col("check_id").alias("rule"), _category().alias("category"), "severity")
    held = advice.groupBy("path").agg(F.first("layer").alias("layer"), F.first("public").alias("public_api"), F.array_sort(F.collect_list(one)).alias("constraints"))  # a row per rule
    return held.select("path", F.to_json(F.struct("path", "layer", "public_api", "constraints")).alias("line"))


def digest_markdown(items: DataFrame) -> DataFrame:
    """turn, line: a digest's items, each with its title, check, body and reason."""
    why = F.when(F.col("explain").isNotNull(), said("\n\n_why: {}_", "explain")).otherwise(F.lit(""))
    return items.select("turn", F.concat(said("## {}  `{}`\n\n{}", "title", "check_id", texts.truncated(F.col("body"))), why).alias("line"))


def explain(check_id: str) -> dict:
    """What is known of a rule."""
    return _rule(REGISTRY.get(check_id), check_id)


def invariants(policy) -> dict:  # noqa: ANN001
    """What a policy declares, as plain data."""
    return {"layers": policy.layers, "allow": policy.allow, "frozen": policy.frozen, "invariants": policy.invariants, "scripted": policy.scripted, "public_api": policy.public_api}

