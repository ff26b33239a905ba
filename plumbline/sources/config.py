"""Configuration, baselines, notes and manifests: small files, read on the driver.

Defined results: a file that is not there gives the defaults; a fault in one names the file; unknown
keys are kept in ``options`` of their check and otherwise ignored; the policy file wins over the
project file where both declare a section.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.findings import SEVERITIES
from plumbline.rules.base import Override, Policy

PROJECT_FILE, POLICY_FILE = "plumbline.toml", "plumbline.invariants.toml"
BASELINE_VERSION = 3
#: Fixed value: the versions of graph envelopes that can be read.
ENVELOPE_VERSIONS = ((1, 0), (1, 9))


class ConfigError(ValueError):
    """A configuration that cannot be read, with its file."""


def _toml(path: str) -> dict[str, Any]:
    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except FileNotFoundError:
        return {}
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e


def find_upward(start: str, name: str) -> str | None:
    """The nearest file of that name in ``start`` or a folder above it."""
    at = os.path.abspath(start)
    while True:
        found = os.path.join(at, name)
        if os.path.isfile(found):
            return found
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above


def _severity(value: str, where: str) -> str:
    if value not in SEVERITIES:
        raise ConfigError(f"{where}: unknown severity {value!r}")
    return value


def policy_of(project: dict[str, Any], spec: dict[str, Any] | None = None) -> Policy:
    """The policy that a project file and a policy file declare together."""
    spec = spec or {}
    held = {k: spec.get(k, project.get(k)) for k in ("layers", "public_api", "boundaries", "invariants", "scripted")}
    layers = held["layers"] or {}
    out = Policy()
    for name, x in layers.items():
        if name == "allow":
            continue
        out.layers[name] = [x] if isinstance(x, str) else list(x["globs"] if isinstance(x, dict) else x)
    out.allow = {k: list(v) for k, v in (layers.get("allow") or {}).items()}
    for end in {*out.allow, *(d for v in out.allow.values() for d in v)} - set(out.layers):
        raise ConfigError(f"layers.allow: {end!r} is no layer")
    out.public_api = list((held["public_api"] or {}).get("exports", []))
    for b in held["boundaries"] or []:
        if b.get("frozen", True):
            out.frozen += [(g, b.get("reason")) for g in ([b["glob"]] if "glob" in b else b.get("globs", []))]
    out.invariants = {name: {k: list(v) for k, v in x.items() if k in ("forbid_imports", "require_imports", "from_layers")} for name, x in (held["invariants"] or {}).items()}
    for name, x in (held["scripted"] or {}).items():
        rule = x.get("rule") or (f"require {x['require']}" if "require" in x else f"forbid {x['forbid']}" if "forbid" in x else None)
        if rule is None:
            raise ConfigError(f"scripted.{name}: no rule")
        out.scripted[name] = {"rule": rule, "message": x.get("message", "")} | ({"when": x["when"]} if x.get("when") else {})
    for check, x in (project.get("checks") or {}).items():
        if x is False or x.get("enabled") is False:
            out.disabled.append(check)
            continue
        if "severity" in x:
            out.severities[check] = _severity(x["severity"], f"checks.{check}")
        out.options[check] = {k: v for k, v in x.items() if k not in ("severity", "enabled")}
    for x in project.get("overrides") or []:
        globs = [g.removeprefix("./") for g in x.get("files", [])]
        for check, y in (x.get("checks") or {}).items():
            off = True if y is False else (not y["enabled"] if "enabled" in y else None)
            more = {} if y is False else y
            severity = _severity(more["severity"], f"overrides.{check}") if "severity" in more else None
            out.overrides.append(Override(globs, check, {k: v for k, v in more.items() if k not in ("severity", "enabled")}, severity, off))
    out.budgets = {k: int(v) for k, v in (project.get("budgets") or {}).items()}
    context = project.get("context") or {}
    out.context_suppress = [(x["check"], list(x.get("files", []))) for x in context.get("suppress", [])]
    out.knowledge = context.get("knowledge")
    return out


def load(start: str) -> Policy:
    """The policy of the project that holds ``start``: both files are looked for upwards."""
    project, spec = find_upward(start, PROJECT_FILE), find_upward(start, POLICY_FILE)
    return policy_of(_toml(project) if project else {}, _toml(spec) if spec else {})


def doctor(start: str, known: list[str]) -> list[tuple[str, str, str]]:
    """(what, state, detail) of the configuration's health: files that read, checks that exist, globs
    and predicates that compile."""
    from pyspark.sql import functions as F

    from plumbline.functions.paths import glob_regex
    from plumbline.plans import predicate

    out: list[tuple[str, str, str]] = []
    for name in (PROJECT_FILE, POLICY_FILE):
        found = find_upward(start, name)
        out.append((name, "ok" if found else "absent", found or ""))
    try:
        p = load(start)
    except ConfigError as e:
        return [*out, ("configuration", "error", str(e))]
    for check in sorted({*p.options, *p.severities, *p.disabled, *(o.check_id for o in p.overrides if o.check_id)} - set(known)):
        out.append((check, "warning", "no such check"))
    for glob in [g for v in p.layers.values() for g in v] + [g for g, _ in p.frozen]:
        try:
            re.compile(glob_regex(glob.removeprefix("!")).replace(r"\z", r"\Z"))
        except re.error as e:
            out.append((glob, "error", str(e)))
    column = F.lit("")
    facts = predicate.Facts(path=column, layer=column, imports=F.array().cast("array<struct<specifier:string,resolved:string,type_only:boolean>>"), exports=F.array().cast("array<string>"), exists=lambda c: F.lit(True), transitive=lambda g: F.lit(True))
    for name, spec in p.scripted.items():
        for text in (spec.get("when"), spec["rule"]):
            try:
                if text:
                    predicate.compile_predicate(text, facts)
            except predicate.PredicateError as e:
                out.append((f"scripted.{name}", "error", str(e)))
    return out


def rewrite_budgets(text: str, budgets: dict[str, int]) -> str:
    """The project file with lower numbers in ``[budgets]``: lines of names that are given change, all
    else stays as it is."""
    section, out = "", []
    for line in text.splitlines(keepends=True):
        head = re.match(r"\s*\[([^\]]+)\]", line)
        section = head[1].strip() if head else section
        m = re.match(r"(\s*\"?([A-Za-z0-9_.]+)\"?\s*=\s*)(\d+)(.*)", line, re.S)
        if section == "budgets" and m and m[2] in budgets:
            line = f"{m[1]}{min(int(m[3]), budgets[m[2]])}{m[4]}"
        out.append(line)
    return "".join(out)


# ---------------------------------------------------------------- baselines and envelopes


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """file, check_id, rule_signature of a baseline; another version is an error."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    if held.get("version") != BASELINE_VERSION:
        raise ConfigError(f"{path}: baseline version {held.get('version')!r}, expected {BASELINE_VERSION}")
    rows = [(x["file"], x["check_id"], x["rule_signature"]) for x in held["findings"]]
    return spark.createDataFrame(rows, "file string, check_id string, rule_signature string")


def read_envelope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a stored graph whose version can be read."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    m = re.fullmatch(r"(\d{1,9})\.(\d{1,9})", str(held.get("schema_version", "")))
    if not m or not ENVELOPE_VERSIONS[0] <= (int(m[1]), int(m[2])) <= ENVELOPE_VERSIONS[1]:
        raise ConfigError(f"{path}: graph version {held.get('schema_version')!r} cannot be read")
    nodes = [(x["id"], x.get("type"), x.get("path"), x.get("name")) for x in held["nodes"]]
    edges = [(x["src"], x["dst"], x.get("type")) for x in held["edges"]]
    return spark.createDataFrame(nodes, "id long, type string, path string, name string"), spark.createDataFrame(edges, "src long, dst long, type string")


# ---------------------------------------------------------------- notes


@dataclass
class Note:
    """A curated note: what it says and which changed files it is for."""

    path: str
    title: str
    body: str
    priority: str = "normal"
    paths: list[str] = field(default_factory=list)
    layers: list[str] = field(default_factory=list)
    predicate: str | None = None


def front_matter(text: str) -> tuple[dict[str, Any], str] | None:
    """The fields between the first two ``---`` lines and the text after them.  Fields are scalars,
    lists, in brackets or a line each, and one level of fields below a field."""
    m = re.match(r"---[ \t]*\r?\n(.*?)^---[ \t]*\r?$\n?", text, re.S | re.M)
    if not m:
        return None
    out: dict[str, Any] = {}
    above: dict[str, Any] = out
    held: list[Any] | None = None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s*-\s+(.*)", line)
        if item and held is not None:
            held.append(_scalar(item[1]))
            continue
        pair = re.match(r"(\s*)([A-Za-z_][\w-]*)\s*:\s*(.*)", line)
        if not pair:
            raise ConfigError(f"not a field: {line.strip()!r}")
        target = out if not pair[1] else above
        value = pair[3].strip()
        if value:
            target[pair[2]] = [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", value[1:-1])] if value.startswith("[") and value.endswith("]") else _scalar(value)
            held = None
        elif not pair[1]:
            above, held = {}, []
            out[pair[2]] = _Pending(above, held)
        else:
            held = []
            target[pair[2]] = held
    return {k: v.settled() if isinstance(v, _Pending) else v for k, v in out.items()}, text[m.end() :]


@dataclass
class _Pending:
    fields: dict[str, Any]
    items: list[Any]

    def settled(self) -> Any:
        return self.items if self.items else self.fields


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def read_note(path: str, text: str, layers: list[str] | None = None) -> tuple[Note | None, list[str]]:
    """The note and what is wrong with it; a selector that cannot be used is dropped with a warning,
    a note without fields or title is none."""
    try:
        found = front_matter(text)
    except ConfigError as e:
        return None, [f"{path}: invalid front matter: {e}"]
    if found is None:
        return None, [f"{path}: no front matter"]
    fields, body = found
    if not fields.get("title"):
        return None, [f"{path}: no title"]
    match = fields.get("match") or {}
    as_list = lambda x: [] if not x else [x] if isinstance(x, str) else list(x)
    faults = [f"{path}: undeclared layer {x!r}" for x in as_list(match.get("layers")) if layers is not None and x not in layers]
    known = [x for x in as_list(match.get("layers")) if layers is None or x in layers]
    return Note(path, fields["title"], body.strip(), fields.get("priority", "normal"), as_list(match.get("paths")), known, match.get("predicate")), faults


def read_notes(folder: str, layers: list[str] | None = None) -> tuple[list[Note], list[str]]:
    """The notes of a folder, in order of their names."""
    notes, faults = [], []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(".md"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                note, wrong = read_note(name, f.read(), layers)
            notes += [note] if note else []
            faults += wrong
    return notes, faults


# ---------------------------------------------------------------- manifests


def _leaves(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    below = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [x for v in below for x in _leaves(v)]


def manifest_paths(manifest: str | None, entries: list[str]) -> tuple[list[str], list[str]]:
    """(public paths without their extension, entries that point at nothing) of the
    ``package.json:key`` entries: every text below the key, as it is and, where a folder is ``dist``,
    ``build`` or ``lib``, in ``src`` beside it."""
    try:
        held = json.loads(manifest) if manifest else None
    except json.JSONDecodeError:
        held = None
    paths: set[str] = set()
    missing = []
    for entry in entries:
        if not entry.startswith("package.json:"):
            continue
        found = _leaves(held.get(entry.partition(":")[2])) if isinstance(held, dict) else []
        if not found:
            missing.append(entry)
        for leaf in found:
            path = posixpath.normpath(leaf)
            for p in {path, re.sub(r"(\A|/)(dist|build|lib)/", r"\1src/", path, count=1)}:
                paths.add(re.sub(r"(\.d)?\.[^./]+\Z", "", p))
    return sorted(paths), missing
