"""Folders, version control, configuration, reports, stores and streams, end to end."""

from __future__ import annotations

import json
import subprocess
from collections import defaultdict

import pytest
from plumbline import api, rules
from plumbline.facts import Facts
from plumbline.rules import context
from plumbline.sinks import reports, stores
from plumbline.sources import changes, config, discover, notes
from plumbline.streaming import watch
from pyspark.sql import functions as F

FILES = {
    "src/a.ts": "import { b } from './b.js';\nexport const a = b;\nif (a == 1) { console.log(a); }\n",
    "src/b.ts": "import { a } from './a';\nexport const b = 'x';\nexport const lone = \"it's\";\n",
    "src/c.test.ts": "import { b } from './b';\n",
    "src/types.d.ts": "export const t: string;\n",
    "src/out/gen.ts": "export const gen = 1;\n",
    "src/out/.gitignore": "!kept.ts\n",
    "src/out/kept.ts": "export const kept = 2;\n",
    ".hidden/x.ts": "export const x = 1;\n",
    ".gitignore": "*.log\n**/out/*\n",
    "lib.rs": "pub fn f() { x.unwrap() }\n",
    "page.html": "<html><body></body></html>\n",
    "bad.ts": "f(\n",
    "README.md": "The colour.\n",
    "plumbline.toml": '[checks."Warning.NoConsoleLog"]\nseverity = "high"\n[checks]\n"Rust.NoUnwrapInLib" = false\n[[overrides]]\nfiles = ["src/b.ts"]\n[overrides.checks."Design.OrphanExport"]\nenabled = false\n[budgets]\n"Warning" = 9 # most\nDesign = 2\n',
    "plumbline.invariants.toml": '[layers]\ncore = "src/*"\n[layers.allow]\ncore = []\n[public_api]\nexports = ["package.json:main"]\n[[boundaries]]\nglob = "lib.rs"\nreason = "old"\n[invariants.one]\nforbid_imports = ["./b"]\n[scripted.two]\nwhen = "file matches \'src/*\'"\nrequire = "file exports \'*\'"\nmessage = "say something"\n',
    "package.json": '{"main": "dist/a.js"}',
}


@pytest.fixture
def project(tmp_path):  # noqa: ANN001, ANN201
    for name, text in FILES.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "p")


def test_discover(spark, project) -> None:
    names = lambda **k: [r.path for r in discover.discover(spark, project, **k).collect()]
    assert names() == ["bad.ts", "lib.rs", "page.html", "src/a.ts", "src/b.ts", "src/c.test.ts", "src/out/kept.ts"]
    assert "src/out/gen.ts" in names(respect_ignore=False) and ".hidden/x.ts" in names(hidden=True, respect_ignore=False) and "src/types.d.ts" in names(declarations=True)
    assert names(extensions=("rs",)) == ["lib.rs"]
    found = discover.discover(spark, project, extensions=("rs",)).first()
    assert found.text == FILES["lib.rs"] and len(found.content_sha) == 64


def test_overlay_and_fingerprint(spark) -> None:
    files = discover.in_memory(spark, [("a", "1"), ("b", "2")])
    got = discover.overlay(files, discover.in_memory(spark, [("b", "new"), ("c", None)]))
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "new"), ("c", "")]
    prints = lambda df: spark.range(1).select(discover.fingerprint(df)).first()[0]
    assert prints(files) == prints(files.orderBy(F.desc("path")).repartition(3)) and prints(files) != prints(got) and prints(files.where("false"))


def test_check_of_a_folder(spark, project) -> None:
    ctx = api.open_project(spark, project)
    found = api.check(ctx)
    got = {(r.check_id, r.file, r.span.line, r.severity) for r in found.collect()}
    for want in [("Warning.NoConsoleLog", "src/a.ts", 3, "high"), ("Warning.TripleEquals", "src/a.ts", 3, "high"), ("Warning.ParseError", "bad.ts", 1, "high"), ("Html.MissingLangAttribute", "page.html", 1, "medium"), ("Design.ImportCycle", "src/a.ts", 1, "medium"), ("Design.BoundaryFrozen", "lib.rs", 1, "low"), ("Design.InvariantViolation", "src/c.test.ts", 1, "medium"), ("Design.ScriptedInvariant", "src/c.test.ts", 1, "medium"), ("Design.OrphanExport", "src/out/kept.ts", 1, "medium")]:
        assert want in got
    checks = {g[:2] for g in got}
    assert ("Rust.NoUnwrapInLib", "lib.rs") not in checks and ("Design.OrphanExport", "src/b.ts") not in checks and ("Design.OrphanExport", "src/a.ts") not in checks
    assert ("Rust.MissingPubDoc", "lib.rs") in checks and ("Design.InvariantViolation", "src/a.ts") not in checks
    order = [(-r.priority, r.check_id, r.file, r.span.line) for r in found.collect()]
    assert order == sorted(order)
    # reports
    text = [r.line for r in reports.text_lines(found).collect()]
    assert "src/a.ts:3:15 high Warning.NoConsoleLog remove `console.log` call (use a logger or strip in CI)" in text
    doc = json.loads(reports.json_report(found))
    assert doc["summary"]["total"] == len(doc["findings"]) == len(text) and {"id", "category", "file", "line"} <= set(doc["findings"][0])
    cycle = next(f for f in doc["findings"] if f["id"] == "Design.ImportCycle")
    assert cycle["related"][0]["file"] == "src/b.ts" and "baselined" not in cycle
    held = json.loads(reports.sarif(found))
    assert held["version"] == "2.1.0" and {x["id"] for x in held["runs"][0]["tool"]["driver"]["rules"]} == {r["ruleId"] for r in held["runs"][0]["results"]}
    assert api.explain("Design.ImportCycle")["properties"]["priority"] == 8 and api.explain("No.Such")["properties"]["category"] == "unknown"
    assert api.invariants(ctx.policy)["layers"] == {"core": ["src/*"]} and ctx.pointers == ["dist/a", "src/a"]
    assert {r.check_id for r in api.timed(ctx, ["Warning.NoEval", "Warning.NoDebugger"]).collect()} == {"Warning.NoEval", "Warning.NoDebugger"}


def test_edits_bring_and_clear_findings(spark) -> None:
    before = rules.Context(Facts(discover.in_memory(spark, [("a.ts", "debugger;\neval('x');\n"), ("b.ts", "debugger;\n")])))
    after = rules.Context(Facts(discover.in_memory(spark, [("a.ts", "\n\n  debugger;\nconsole.log(1);\n"), ("b.ts", "")])))
    only = ["Warning.NoDebugger", "Warning.NoEval", "Warning.NoConsoleLog"]
    got = sorted((r.file, r.check_id, r.change) for r in api.advise_diff(before, after, only).collect())
    assert got == [("a.ts", "Warning.NoConsoleLog", "fire"), ("a.ts", "Warning.NoEval", "clear"), ("b.ts", "Warning.NoDebugger", "clear")]


def test_baselines_and_stores(spark, tmp_path) -> None:
    ctx = rules.Context(Facts(discover.in_memory(spark, [("a.ts", "debugger;\ndebugger;\n"), ("b.ts", "eval('x')\n")])))
    found = api.check(ctx, ["Warning.NoDebugger", "Warning.NoEval"])
    keys = stores.baseline_rows(found, ctx.facts.files)
    assert stores.write_baseline(keys, str(tmp_path / "baseline.json")) == 3
    back = config.read_baseline(spark, str(tmp_path / "baseline.json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, keys.collect()))
    (tmp_path / "old.json").write_text('{"version": 1, "findings": []}')
    with pytest.raises(config.ConfigError):
        config.read_baseline(spark, str(tmp_path / "old.json"))
    assert stores.stored_run(spark, str(tmp_path), "k") is None
    stores.store_run(found, str(tmp_path), "k")
    assert sorted(map(repr, stores.stored_run(spark, str(tmp_path), "k").collect())) == sorted(map(repr, found.collect()))
    for day in ("2024-01-01", "2024-01-02"):
        stores.append_trend(found, str(tmp_path / "trend"), day)
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "trend")).select("date", "category", "count").collect())) == [("2024-01-01", "warning", 3), ("2024-01-02", "warning", 3)]
    reports.write_lines(reports.compact_lines(found), str(tmp_path / "c"), reports.COMPACT_HEADER)
    assert (tmp_path / "c" / "header.txt").read_text() == reports.COMPACT_HEADER + "\n" and spark.read.text(str(tmp_path / "c")).count() == 4
    graph = {"schema_version": "1.2", "nodes": [{"id": 1, "type": "file", "path": "a"}], "edges": [{"src": 1, "dst": 1}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges = config.read_envelope(spark, str(tmp_path / "g.json"))
    assert nodes.first().path == "a" and edges.count() == 1
    (tmp_path / "g.json").write_text(json.dumps(graph | {"schema_version": "2.0"}))
    with pytest.raises(config.ConfigError):
        config.read_envelope(spark, str(tmp_path / "g.json"))


def test_edits() -> None:
    assert stores.edit("aébc", [(1, 3, "E"), (0, 1, ""), (9, 9, "x"), (3, 2, "x"), (2, 2, "?"), (5, 5, "!")]) == "Ebc!"


def test_budgets_are_only_lowered() -> None:
    text = FILES["plumbline.toml"]
    assert config.rewrite_budgets(text, {"Warning": 3, "Design": 7}) == text.replace('"Warning" = 9', '"Warning" = 3')


def test_doctor(project) -> None:
    got = config.doctor(project, ["Warning.NoConsoleLog", "Design.OrphanExport"])
    assert ("Rust.NoUnwrapInLib", "warning", "no such check") in got and all(state != "error" for _, state, _ in got)
    for bad in ('[layers]\na = "x"\n[layers.allow]\nb = []\n', "[scripted.x]\nmessage = 'm'\n", "a ="):
        (open(f"{project}/plumbline.invariants.toml", "w")).write(bad)  # noqa: SIM115
        assert config.doctor(project, [])[-1][1] == "error"


def test_git(spark, project) -> None:
    git = lambda *a: subprocess.run(["git", "-C", project, "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-qm", "one")
    with open(f"{project}/src/a.ts", "a") as f:
        f.write("new\n")
    with open(f"{project}/src/new.ts", "w") as f:
        f.write("x\n")
    with open(f"{project}/src/b.ts", "w") as f:
        f.write("".join(FILES["src/b.ts"].splitlines(keepends=True)[:2]))
    assert sorted(map(tuple, changes.changed(spark, project).collect()), key=repr) == [("src/a.ts", 4, 4), ("src/b.ts", None, None), ("src/new.ts", None, None)]
    git("add", "src/a.ts")
    assert [tuple(r) for r in changes.changed(spark, project, "staged").collect()] == [("src/a.ts", 4, 4)]
    git("checkout", "-qb", "side")
    git("commit", "-qm", "two")
    assert [tuple(r) for r in changes.changed(spark, project, "merge-base", "main").collect()] == [("src/a.ts", 4, 4)] and len(changes.merge_base(project, "main")) == 40
    old = {r.path: r.text for r in changes.at_ref(spark, project, "main", ["src/a.ts"]).collect()}
    assert old == {"src/a.ts": FILES["src/a.ts"]}
    files = discover.discover(spark, project)
    assert sorted(r.path for r in changes.changed_files(files, changes.changed(spark, project)).collect()) == ["src/b.ts", "src/new.ts"]
    with pytest.raises(ValueError, match="unknown mode"):
        changes.diff_text(project, "sideways")


def test_what_a_change_should_know(spark) -> None:
    shape = "export interface {} {{ a: string; b: number; c: boolean }}\n"
    texts = {"m/a.ts": "// @decision: keep it\nexport function f() {\n  debugger;\n}\ndebugger;\n", "m/b.ts": "import { f } from './a';\nf();\n", "m/c.test.ts": "import { f } from './b';\n", "m/d.ts": "// @why: old\nexport const d = 1;\n", "m/e.ts": "import { d } from './d';\n", "s/x.ts": shape.format("X"), "s/y.ts": shape.format("Y"), "s/z.ts": shape.format("Z")}
    ctx = rules.Context(Facts(discover.in_memory(spark, list(texts.items()))), rules.Policy(layers={"m": ["m/*"]}))
    ctx.changes = spark.createDataFrame([("m/a.ts", 1, 3), ("m/e.ts", None, None), ("s/z.ts", None, None)], "file string, first_line int, last_line int")
    rules.run(ctx, ["Warning.NoDebugger"])
    note = config.Note("n.md", "Careful", "x" * 9000, "high", layers=["m"])
    got = {(r.check_id, r.title): r for r in context.items(ctx, [note]).collect()}
    assert got["Context.Findings", "1 finding in changed lines"].pinned and got["Context.Findings", "Legacy debt: m/a.ts"].related == ["m/a.ts"]
    assert got["Context.BlastRadius", "m/b.ts depends on m/a.ts"].score == 95 and got["Context.BlastRadius", "m/c.test.ts depends on m/a.ts"].score == 60
    assert got["Context.Annotations", "@decision in m/a.ts"].score == context.VERIFIED and got["Context.Annotations", "@why in m/d.ts"].explain == "imported by m/e.ts"
    assert got["Context.Precedent", "Sibling convention in s"].related == ["s/x.ts", "s/y.ts"]
    known = got["Context.Knowledge", "Careful"]
    assert known.pinned and known.related == ["m/a.ts", "m/e.ts"] and known.body.endswith("... (truncated)") and known.tokens > 2000
    small = api.digest(ctx, known.tokens + 200, [note])
    assert {r.title for r in small.where("turn = 0").collect()} == {"1 finding in changed lines", "Legacy debt: m/a.ts", "Careful"}
    assert reports.digest_markdown(small).where(F.contains("line", F.lit("## Careful  `Context.Knowledge`"))).count() == 1
    ctx.policy.context_suppress = [("Context.BlastRadius", []), ("Context.Annotations", ["m/d.ts"])]
    left = {(r.check_id, r.title) for r in context.items(ctx).collect()}
    assert not any(c == "Context.BlastRadius" for c, _ in left) and ("Context.Annotations", "@why in m/d.ts") not in left and ("Context.Annotations", "@decision in m/a.ts") in left


def test_annotations_of_a_line(spark) -> None:
    lines = spark.createDataFrame([("f", 1, "// @why one"), ("f", 2, " * @contract: two */"), ("f", 3, "x // @why no"), ("f", 9, "# @warning"), ("f", 4, None)], "path string, line int, text string")
    scopes = spark.createDataFrame([("f", "s", 2, 5), ("f", "t", 7, 7)], "file string, scope string, first int, last int")
    got = sorted((r.start_line, r.mark, r.text, r.scope) for r in notes.annotations(lines, scopes).collect())
    assert got == [(1, "@why", "one", "s"), (2, "@contract", "two", "s"), (9, "@warning", "", None)]


def test_effects_and_pure_files(spark) -> None:
    texts = [("a.ts", "/** @pure */\nimport './b';\n"), ("b.ts", "import x from 'node:fs/promises';\n"), ("c.ts", "/* @purely */\nimport 'fs';\n"), ("d.ts", "// @pure\nimport './e';\n"), ("e.ts", "import 'fsx';\n"), ("g.ts", "// @pure because\nimport 'pg/lib';\n")]
    ctx = rules.Context(Facts(discover.in_memory(spark, texts)))
    got = sorted((r.file, r.message.split("`")[3]) for r in rules.run_rule("Design.EffectLeakage", ctx).collect())
    assert got == [("a.ts", "fs"), ("g.ts", "pg")]


def test_repeated_blocks(spark) -> None:
    body = "  const a{0} = f({0});\n  const b = g(a{0}, 'text that is long enough');\n  if (b) {{ h(b); }}\n  call(b, {0});\n  other(b);\n  return b;\n"
    texts = [("a.ts", "function x() {\n" + body.format(1) + "}\n"), ("b.ts", "function y() {\n" + body.format(1) + "}\n"), ("c.ts", "function z() {\n" + body.format(1).replace("'text that is long enough'", "'another text of some length'") + "}\n"), ("d.ts", "q();\n" * 3)]
    ctx = rules.Context(Facts(discover.in_memory(spark, texts)))
    near = rules.run_rule("Refactor.NearDuplicateBlock", ctx).collect()
    assert [(r.file, r.span.line, len(r.related)) for r in near] == [("a.ts", 2, 2)] and rules.run_rule("Refactor.DuplicateBlock", ctx).count() == 0
    two = rules.Context(Facts(discover.in_memory(spark, [texts[0], texts[1], texts[3]])))
    assert [(r.file, [x.file for x in r.related]) for r in rules.run_rule("Refactor.DuplicateBlock", two).collect()] == [("a.ts", ["b.ts"])]


def test_names_of_two_sides(spark) -> None:
    texts = [("web/a.ts", "export function go() {}\n"), ("api/a.ts", "export function go() {}\n"), ("web/b.ts", "export const stop = 1;\n"), ("web/c.ts", "export const stop = 2;\n")]
    policy = rules.Policy(options={"Design.DuplicateExportName": {"boundaries": ["web/** | api/**"]}})
    got = rules.run_rule("Design.DuplicateExportName", rules.Context(Facts(discover.in_memory(spark, texts)), policy)).collect()
    assert [(r.file, r.message) for r in got] == [("web/b.ts", "`stop` is exported from 2 files")]


def test_rules_of_ones_own(spark) -> None:
    @rules.rule("Own.Todo", 3, "low", "A note to do.", include=("src/**",), exclude=("src/x.ts",), languages=("typescript",))
    def todo(ctx):  # noqa: ANN001, ANN202
        ctx.slots["Own.lines"] = ctx.facts.lines.where(F.contains("text", F.lit("TODO")))
        return ctx.slots["Own.lines"].select(F.col("path").alias("file"), F.struct("start_byte", F.col("start_byte").alias("end_byte"), "line", F.lit(1).alias("column")).alias("span"), F.lit("to do").alias("message"))

    try:
        ctx = rules.Context(Facts(discover.in_memory(spark, [("src/a.ts", "x\n// TODO\n"), ("src/x.ts", "// TODO"), ("lib/a.ts", "// TODO"), ("src/n.ts", None)])))
        assert [(r.file, r.span.line, r.span.start_byte) for r in api.check(ctx, ["Own.Todo"]).collect()] == [("src/a.ts", 2, 2)]
        assert ctx.slots["Own.lines"].count() == 3
        with pytest.raises(ValueError, match="unknown severity"):
            rules.rule("Own.Bad", 1, "awful", "x")(todo)
    finally:
        rules.REGISTRY.pop("Own.Todo")


# ---------------------------------------------------------------- streams


def test_incremental_runs_equal_batch_after_each_batch(spark, tmp_path) -> None:
    """Creations, changes, removals, a file that comes back, an event twice, an empty batch, a restart."""
    schema = "path string, kind string, ts timestamp, text string"
    at = lambda k: f"2024-01-01 00:00:{k:02d}"
    batches = [
        [("a", "created", at(1), "x y"), ("b", "created", at(1), "y"), ("c", "accessed", at(1), "z")],
        [("a", "modified", at(2), "y"), ("a", "modified", at(3), "x"), ("b", "removed", at(2), None)],
        [("q", "accessed", at(4), "n")],
        [("b", "created", at(5), "x w"), ("d", "renamed", at(5), "w w"), ("b", "created", at(5), "x w")],
        [("d", "modified", at(6), "v"), ("d", "removed", at(6), "v"), (None, "created", at(6), "v")],
        [("e", "created", at(7), None)],
    ]
    words = lambda files: files.select(F.col("path").alias("file"), F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    wide = lambda state: state.groupBy("word").agg(F.count_distinct("file").alias("n")).where("n >= 2")
    known: dict[str, str] = {}
    seen: list[list] = []
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    kept = {"results": spark.createDataFrame([], "word string, n long"), "state": spark.createDataFrame([], "file string, word string")}

    def after(state, n) -> None:  # noqa: ANN001
        seen.append(sorted(map(tuple, state.collect())))
        # groups that the batch touched are evaluated again, all others stay
        gone, fresh = kept["state"].exceptAll(state), state.exceptAll(kept["state"])
        results = watch.dirty_groups(kept["results"], state, fresh, gone, "word", wide)
        rows = sorted(map(tuple, results.collect()))
        assert rows == sorted(map(tuple, wide(state).collect())), n
        kept.update(results=spark.createDataFrame(rows, "word string, n long"), state=spark.createDataFrame(seen[-1], "file string, word string"))

    spark.createDataFrame([], schema).write.mode("append").parquet(source)
    for k, rows in enumerate(batches):
        spark.createDataFrame([(p, kind, t, x) for p, kind, t, x in rows], "path string, kind string, ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        state = watch.run(watch.event_files(spark, source, schema), folder, "file string, word string", words, after)
        last: dict = {}
        for p, kind, t, x in rows:
            if p is not None and kind != "accessed":
                last[p] = max(last.get(p, ("", False, "", "")), (t, kind == "removed", x or "", kind))
        for p, (_, removed, x, _) in last.items():
            known.pop(p, None)
            if not removed:
                known[p] = x
        assert sorted(map(tuple, state.before().collect())) == sorted((f, w) for f, x in known.items() for w in x.split(" ")), k
    assert len(state.versions()) == 2 and len(seen) >= len(batches)
    slots = watch.without_files({"one": state.before()}, spark.createDataFrame([("a",)], "file string"))
    assert "a" not in {r.file for r in slots["one"].collect()}


def test_sessions(spark) -> None:
    at = lambda ms: f"2024-01-01 00:00:00.{ms:03d}"
    events = spark.createDataFrame([("a", at(0)), ("a", at(90)), ("a", at(180)), ("a", at(281)), ("b", at(5))], "k string, s string").select("k", F.to_timestamp("s").alias("ts"))
    got = defaultdict(list)
    for r in watch.sessions(events, "k", "ts", 0.1).collect():
        got[r.k].append(r.n)
    assert sorted(got["a"]) == [1, 3] and got["b"] == [1]
