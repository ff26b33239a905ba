"""Queries over the source tree of ``corpora``, by name, and the same in SQL.

Facts are read from the texts of files; the SQL knows each line for what it was made as, and reads
no text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import corpora, facts, rules
from plumbline.cut import spread
from plumbline.functions import paths
from plumbline.operators import graph, intervals
from plumbline.rules import context, duplicates, imports, packages, places  # noqa: F401  (registers the rules)
from plumbline.sinks import reports, stores
from plumbline.sources import changes, suppressions
from plumbline.sources import packages as package_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N = corpora.NUMBERED_SQL


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LAYERS = {k: [f"src/{k}/*"] for k in ("core", "data", "ui", "app", "lib")}
POLICY = rules.Policy(
    layers=LAYERS,
    allow={"app": ["core", "data"], "ui": ["core"], "lib": ["data"]},
    frozen=[("src/core/m1*", "settled"), ("src/*/m?.ts", None)],
    invariants={"no-core": {"forbid_imports": ["src/core"], "from_layers": ["data", "ui"]}, "lib-first": {"require_imports": ["src/lib", "../lib"]}},
    public_api=["src/lib/*.ts", "./src/core/m10.ts"],
    overrides=[rules.base.Override(["src/ui/*"], "Warning.NoDebugger", disabled=True), rules.base.Override(["src/core/**"], None, severity="critical"), rules.base.Override(["src/core/m2*"], "Warning.NoEval", severity="info")],
)


def tree(spark: SparkSession, sf_dir: str, policy: rules.Policy | None = None) -> rules.Context:
    return rules.Context(corpora.facts(spark, sf_dir), policy or rules.Policy())


# ---------------------------------------------------------------- sources


@query(f"""WITH {N}, l AS (SELECT n.path AS from_file, k.spec AS specifier, k.dst_path AS resolved, k.kind = 4 AS type_only, CASE WHEN k.kind = 3 THEN 0 WHEN k.kind = 8 THEN 2 ELSE 1 END AS n_names, n.line, CASE WHEN k.kind = 7 THEN length('const L' || k.t || ' = ') + 1 ELSE 1 END AS col,
  n.start_byte + CASE WHEN k.kind = 7 THEN length('const L' || k.t || ' = ') ELSE 0 END AS start_byte FROM numbered n JOIN link k ON k.path = n.path AND k.w = n.ord AND n.sec = 1 AND n.what = 'import')
SELECT from_file, specifier, resolved, type_only, n_names::INT AS n_names, line, col::INT AS col, start_byte::INT AS start_byte FROM l
UNION ALL SELECT path, './m' || k, replace(path, '.test.ts', '.ts'), false, 1, 1, 1, 0 FROM numbered WHERE what = 'test'""")
def tree_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import statements, re-exports and dynamic imports, with the file each resolves to."""
    rows = tree(spark, sf_dir).facts.imports
    return rows.select("from_file", "specifier", "resolved", "type_only", F.size("names").alias("n_names"), "span.line", F.col("span.column").alias("col"), "span.start_byte")


_NAMES = f"""{N}, name AS (
  SELECT path AS from_file, dst_path AS resolved, 'v' || d || '_a' AS source_name, 'v' || d || '_a' AS local_name, 'named' AS kind, false AS type_only, flag <> 'N' AS used FROM link WHERE kind = 0
  UNION ALL SELECT path, dst_path, 'default', 'D' || t, 'default', false, flag <> 'N' FROM link WHERE kind = 1
  UNION ALL SELECT path, dst_path, '*', 'N' || t, 'namespace', false, flag <> 'N' FROM link WHERE kind = 2
  UNION ALL SELECT path, dst_path, 'T' || d, 'T' || d, 'named', false, false FROM link WHERE kind = 4
  UNION ALL SELECT path, dst_path, 'v' || d || '_b', 'r' || t, 'named', false, false FROM link WHERE kind = 5
  UNION ALL SELECT path, dst_path, '*', '*', 'namespace', false, false FROM link WHERE kind IN (6, 7)
  UNION ALL SELECT path, dst_path, 'T' || d, 'T' || d, 'named', true, false FROM link WHERE kind = 8
  UNION ALL SELECT path, dst_path, 'v' || d || '_b', 'q' || t, 'named', false, flag <> 'N' FROM link WHERE kind = 8
  UNION ALL SELECT path, replace(path, '.test.ts', '.ts'), 'v' || k || '_a', 'v' || k || '_a', 'named', false, false FROM lines WHERE what = 'test')"""


@query(f"WITH {_NAMES} SELECT from_file, resolved, source_name, local_name, kind, type_only, used::INT AS uses FROM name")
def tree_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported names and how often each is used.  A name that a file imports and declares itself is
    used where it is declared; the tree has none."""
    return tree(spark, sf_dir).facts.names.select("from_file", "resolved", "source_name", "local_name", "kind", "type_only", F.col("local_use_count").alias("uses"))


_EXPORTS = f"""{N}, e AS (
  SELECT path AS file, line, start_byte, 'v' || k || '_a' AS name, 'named' AS kind, false AS type_only, 'variable' AS declares, NULL AS resolved_source, 14 AS col FROM numbered WHERE what = 'export_a'
  UNION ALL SELECT path, line, start_byte, 'v' || k || '_b', 'named', false, 'variable', NULL, 14 FROM numbered WHERE what = 'export_b'
  UNION ALL SELECT path, line, start_byte, 'default', 'default', false, 'default', NULL, 1 FROM numbered WHERE what = 'export_default'
  UNION ALL SELECT path, line, start_byte, 'T' || k, 'named', true, 'interface', NULL, 18 FROM numbered WHERE what = 'export_type'
  UNION ALL SELECT n.path, n.line, n.start_byte, f.nm, 'named', false, 'function', NULL, 17 FROM numbered n JOIN f ON f.k = n.k WHERE what = 'export_name'
  UNION ALL SELECT n.path, n.line, n.start_byte, 'r' || l.t, 'reexport', false, '', l.dst_path, 10 FROM numbered n JOIN link l ON l.path = n.path AND l.w = n.ord AND n.sec = 1 WHERE l.kind = 5
  UNION ALL SELECT n.path, n.line, n.start_byte, '*', 'reexport', false, '', l.dst_path, 1 FROM numbered n JOIN link l ON l.path = n.path AND l.w = n.ord AND n.sec = 1 WHERE l.kind = 6)"""


@query(f"WITH {_EXPORTS} SELECT file, line, name, kind, type_only, declares, resolved_source, col::INT AS col, (start_byte + col - 1)::INT AS start_byte FROM e")
def tree_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree(spark, sf_dir).facts.exports
    return rows.select("file", "span.line", "name", "kind", "type_only", "declares", "resolved_source", F.col("span.column").alias("col"), "span.start_byte")


@query(f"""WITH {N} SELECT path, line, text, start_byte, false AS is_blank, starts_with(trim(text), '//') AS is_comment FROM numbered
UNION ALL SELECT path, (max(line) + 1)::INT, '', (max(start_byte + length(text)) + 1)::INT, true, false FROM numbered GROUP BY path""")
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).facts.lines


_DIRECTIVES = f"""{N}, d AS (
  SELECT n.path AS file, 'line' AS scope, n.line + 1 AS line_from, n.line + 1 AS line_to, CASE what WHEN 'ignore_console' THEN 'Warning.NoConsoleLog' WHEN 'stale' THEN 'Warning.NoEval' END AS check_id, n.line FROM numbered n
    WHERE what IN ('ignore_console', 'stale', 'broad') AND EXISTS (SELECT 1 FROM numbered m WHERE m.path = n.path AND m.line = n.line + 1)
  UNION ALL SELECT path, 'range', line, line + 1, 'Warning.NoDebugger', line FROM numbered WHERE what = 'block')"""


@query(f"WITH {_DIRECTIVES} SELECT file, scope, line_from::INT AS line_from, line_to::INT AS line_to, check_id, line FROM d")
def tree_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppressions.scan(tree(spark, sf_dir).facts.files).select("file", "scope", "line_from", "line_to", "check_id", "line")


@query(f"""WITH {N} SELECT path, count(*) AS n_lines FROM numbered
WHERE CASE WHEN regexp_matches(path, '^src/(core|data|lib)/m1') OR path = 'src/ui/m12.ts' THEN true ELSE NOT contains(path, '.test.') AND NOT regexp_matches(path, '^src/(ui|app)/m1[0-9]*[.]ts$') END GROUP BY path""")
def tree_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that ignore lines leave: tests are out, and files of two folders but for one."""
    from plumbline.sources import discover

    patterns = [("", "*.test.ts"), ("src", "m1*.ts"), ("src/core", "!m1*"), ("src/data", "!m1*"), ("src/lib", "!m1*"), ("src/ui", "!m12.ts")]
    found = discover.select(tree(spark, sf_dir).facts.files, patterns)
    return found.select("path", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"))


@query("""WITH h AS (SELECT o_orderkey AS d, l_linenumber AS n, 'f' || l_partkey % 50 || '.ts' AS file, (l_suppkey % 90 + 1)::INT AS a, (l_partkey % 4)::INT AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 400)
SELECT DISTINCT d, file, a AS first_line, a + c - 1 AS last_line FROM h WHERE c > 0
UNION ALL SELECT DISTINCT d, file, NULL, NULL FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.d = x.d AND y.file = x.file AND y.c > 0)""")
def parse_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs, one per order, a hunk per line of it, read back as ranges."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 400")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    c = F.col("l_partkey") % 4
    hunk = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/f"), F.col("l_partkey") % 50, F.lit(".ts\n@@ -1,2 +"), F.col("l_suppkey") % 90 + 1, F.when(c == 1, F.lit("")).otherwise(F.concat(F.lit(","), c)), F.lit(" @@ x\n-old\n+new"))
    texts = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_orderkey").alias("diff")).agg(F.array_join(F.array_sort(F.collect_list(hunk)), "\n").alias("text"))
    lines = changes.diff_lines(texts)
    # files of different diffs are apart
    named = lines.withColumn("line", F.regexp_replace("line", r"\A\+\+\+ b/", F.concat(F.lit("+++ b/"), F.col("diff").cast("string"), F.lit("/"))))
    found = changes.parse_diff(named)
    return found.select(F.split_part("file", F.lit("/"), F.lit(1)).cast("long").alias("d"), F.split_part("file", F.lit("/"), F.lit(2)).alias("file"), "first_line", "last_line")


@query("SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'buffer ' || doc_id ELSE coalesce(text, '') END AS text FROM documents UNION ALL SELECT 'new' || doc_id, 'buffer ' || doc_id FROM documents WHERE doc_id % 100 = 0")
def buffer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open buffers over stored files."""
    from plumbline.sources import discover

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.lit("d"), F.col("doc_id"))
    buffer = F.concat(F.lit("buffer "), F.col("doc_id"))
    open_ = docs.where("doc_id % 3 = 0").select(name.alias("path"), buffer.alias("text")).union(docs.where("doc_id % 100 = 0").select(F.concat(F.lit("new"), F.col("doc_id")), buffer))
    return discover.overlay(docs.select(name.alias("path"), F.coalesce("text", F.lit("")).alias("text")), open_)


# ---------------------------------------------------------------- graph


@query(f"""WITH {_NAMES} SELECT from_file AS owner, resolved AS target, CASE WHEN type_only THEN 'imports_as_type' ELSE 'imports_as_value' END AS type, kind AS import_kind, source_name FROM name WHERE NOT (source_name LIKE 'T%' AND NOT type_only)
UNION ALL SELECT from_file, resolved, 'imports_as_type', kind, source_name FROM name WHERE source_name LIKE 'T%' AND NOT type_only
UNION ALL SELECT path, dst_path, 'imports_as_value', 'side_effect', NULL FROM link WHERE kind = 3""")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the property graph, their ends by number, and the file at each end by lookup."""
    f = tree(spark, sf_dir).facts
    nodes = graph.vertices(f.modules.select("file", "language"), f.exports.select("file", "name", "kind")).where("type = 'file'").select("id", F.col("path").alias("target"))
    return graph.import_edges(f.imports).join(nodes, F.col("dst") == F.col("id")).select("owner", "target", "type", "import_kind", "source_name")


_TAKEN = f"""{_NAMES}, taken AS (SELECT resolved AS file, bool_or(kind = 'namespace') AS namespace, bool_or(kind = 'default') AS default_, array_to_string(list_sort(list_distinct(list(source_name) FILTER (WHERE kind = 'named'))), ',') AS names FROM name GROUP BY 1)"""


@query(f"WITH {_TAKEN} SELECT file, namespace, default_, coalesce(names, '') AS names FROM taken UNION ALL SELECT DISTINCT dst_path, false, false, '' FROM link WHERE kind = 3 AND dst_path NOT IN (SELECT file FROM taken)")
def graph_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of each file."""
    ctx = tree(spark, sf_dir)
    ids = ctx.facts.listing.select(graph.node_id("file", "file").alias("id"), "file")
    return imports.consumption(ctx).join(ids, "id").select("file", "namespace", F.col("default").alias("default_"), F.array_join("names", ",").alias("names"))


@query(f"""WITH {N} SELECT path AS owner, dst_path AS target FROM link WHERE src % 10 <> 0 AND kind = 3 UNION ALL SELECT path, path FROM link WHERE src % 10 = 0 GROUP BY path""")
def graph_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after some files changed: what they contributed goes, a new edge comes."""
    f = tree(spark, sf_dir).facts
    edges = graph.import_edges(f.imports.where("size(names) = 0"))
    owners = f.imports.where(F.col("from_file").rlike(r"m\d*0\.ts\z")).select(F.col("from_file").alias("file")).distinct()
    fresh = graph.import_edges(owners.select(F.col("file").alias("from_file"), F.col("file").alias("resolved"), F.lit(False).alias("type_only"), F.expr("CAST(array() AS array<struct<kind:string,source_name:string,local_name:string,type_only:boolean>>)").alias("names")))
    nodes = f.listing.select(graph.node_id("file", "file").alias("id"), F.col("file").alias("target"))
    return graph.replace_owner(edges, owners, fresh).join(nodes, F.col("dst") == F.col("id")).select("owner", "target")


@query(f"WITH {N} SELECT path, layer FROM file WHERE k % 7 = 0")
def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of some files, over the graph's edges."""
    f = tree(spark, sf_dir).facts
    placed = f.listing.where(~F.contains("file", F.lit(".test."))).select("file", paths.layer_of(F.col("file"), LAYERS).alias("layer"))
    edges = graph.layer_edges(placed)
    nodes = graph.vertices(f.modules.select("file", "language"), f.exports.select("file", "name", "kind"), placed.select("layer").distinct())
    some = f.listing.where(F.regexp_extract("file", r"m(\d+)\.ts\z", 1).try_cast("long") % 7 == 0).select(F.col("file").alias("path"))
    files = graph.lookup(nodes, some).select("id", "path")
    return files.join(edges, F.col("id") == F.col("src")).join(nodes.where("type = 'layer'").select(F.col("id").alias("dst"), F.col("name").alias("layer")), "dst").select("path", "layer")


# ---------------------------------------------------------------- rules


def _rule_query(name: str, check_id: str, sql: str, columns: tuple[str, ...] = ("file", "line", "col", "message"), policy: rules.Policy | None = None) -> None:
    """Registers a query that gives the findings of one rule over the tree."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.run_rule(check_id, tree(spark, sf_dir, policy)).withColumns({"line": F.col("span.line"), "col": F.col("span.column"), "n_related": F.size("related")})
        return found.select(*columns)

    run.__name__, run.__doc__ = name, f"Findings of {check_id} over the tree."
    query(sql)(run)


def _line(what: str, message: str, col: int = 1, where: str = "true") -> str:
    return f"WITH {N} SELECT path AS file, line, {col}::INT AS col, {message} AS message FROM numbered WHERE what IN ({what}) AND {where}"


_rule_query("rule_no_console_log", "Warning.NoConsoleLog", _line("'console'", "'remove `console.log` call (use a logger or strip in CI)'", 3))
_rule_query("rule_no_debugger", "Warning.NoDebugger", _line("'debugger', 'in_block'", "'remove `debugger` statement'"))
_rule_query("rule_no_eval", "Warning.NoEval", _line("'eval'", "'avoid `eval(...)` — executes arbitrary strings as code'"))
_rule_query("rule_triple_equals", "Warning.TripleEquals", _line("'loose'", "'use `===` instead of `==`'", 7))
_rule_query("rule_max_parameters", "Design.MaxParameters", _line("'many'", "'function `many` has 6 parameters, exceeds limit of 5'"))
_rule_query("rule_max_line_length", "Readability.MaxLineLength", _line("'long'", "'line is ' || length(text) || ' columns, exceeds limit of 120'", 121))
_rule_query(
    "rule_broad_suppression",
    "Consistency.BroadSuppression",
    _line("'broad'", "'Broad `// plumbline-ignore` (no check id) — narrow it to a specific id. Accepted forms: `// plumbline-ignore: <CheckId>: <reason>` or `// plumbline-ignore <CheckId> — <reason>`.'", 4),
)
_rule_query(
    "rule_spelling_dialect",
    "Consistency.SpellingDialect",
    f"""WITH {N}, v AS (SELECT count(*) FILTER (WHERE what = 'british') AS b, count(*) FILTER (WHERE what = 'american') AS a FROM numbered)
SELECT path AS file, line, 8::INT AS col, '`color` is the American spelling; the project uses British elsewhere — write `colour`' AS message FROM numbered, v WHERE what = 'american' AND b > a AND a + b >= 8""",
)
_rule_query(
    "rule_quote_style",
    "Consistency.QuoteStyle",
    f"""WITH {N}, q AS (SELECT n.path, n.line, n.text, coalesce(l.kind <> 2, n.what = 'test') AS single, strpos(n.text, CASE WHEN coalesce(l.kind <> 2, n.what = 'test') THEN '''' ELSE '"' END) AS col FROM numbered n LEFT JOIN link l ON l.path = n.path AND l.w = n.ord AND n.sec = 1 AND n.what = 'import'
  WHERE n.what IN ('import', 'test', 'export_b', 'eval', 'text')),
v AS (SELECT path, count(*) FILTER (WHERE single) AS s, count(*) FILTER (WHERE NOT single) AS d FROM q GROUP BY 1)
SELECT q.path AS file, line, col::INT AS col, 'use ' || CASE WHEN s > d THEN 'single' ELSE 'double' END || ' quotes consistently (dominant style in this file)' AS message FROM q JOIN v ON v.path = q.path WHERE s <> d AND single <> (s > d)""",
)
_rule_query(
    "rule_orphan_export",
    "Design.OrphanExport",
    f"""WITH {_EXPORTS}, {_TAKEN.partition(', name AS (')[2].join(['name AS (', ''])}
SELECT e.file, e.line, e.col::INT AS col, CASE WHEN e.kind = 'default' THEN 'default export' ELSE '`' || e.name || '`' END || ' is exported but never imported in the project' AS message
FROM e LEFT JOIN taken t ON t.file = e.file WHERE e.kind <> 'reexport' AND NOT e.type_only AND NOT contains(e.file, '.test.') AND NOT starts_with(e.file, 'src/lib/') AND e.file <> 'src/core/m10.ts'
AND NOT coalesce(CASE WHEN e.kind = 'default' THEN t.default_ ELSE t.namespace OR list_contains(string_split(t.names, ','), e.name) END, false)""",
    policy=POLICY,
)
_rule_query(
    "rule_dead_export",
    "Refactor.DeadExport",
    f"""WITH {_EXPORTS}, {_NAMES.partition(', name AS (')[2].join(['name AS (', ''])},
c AS (SELECT resolved AS file, CASE WHEN kind = 'default' THEN 'default' ELSE source_name END AS name, count(*) AS total FROM name WHERE kind <> 'namespace' GROUP BY 1, 2 HAVING NOT bool_or(used))
SELECT e.file, e.line, e.col::INT AS col, CASE WHEN e.kind = 'default' THEN 'default export' ELSE '`' || e.name || '`' END || ' is imported by ' || total || ' file(s) but never referenced after import' AS message
FROM e JOIN c ON c.file = e.file AND c.name = e.name WHERE e.kind <> 'reexport' AND NOT e.type_only AND e.file NOT IN (SELECT resolved FROM name WHERE kind = 'namespace') AND e.file NOT IN (SELECT resolved_source FROM e WHERE resolved_source IS NOT NULL)""",
)
_rule_query(
    "rule_unused_reexport",
    "Warning.UnusedImport",
    f"""WITH {_EXPORTS}, {_NAMES.partition(', name AS (')[2].join(['name AS (', ''])}
SELECT e.file, e.line, e.col::INT AS col, 're-export `' || e.name || '` is never imported by another file' AS message FROM e WHERE e.kind = 'reexport' AND e.name <> '*' AND NOT starts_with(e.file, 'src/lib/') AND e.file <> 'src/core/m10.ts'
AND e.file NOT IN (SELECT resolved FROM name WHERE kind = 'namespace') AND NOT EXISTS (SELECT 1 FROM name n WHERE n.resolved = e.file AND n.source_name = e.name)""",
    policy=POLICY,
)
_PLACED = f"""{N}, placed AS (SELECT n.path AS file, n.line, l.*, CASE WHEN l.kind = 7 THEN length('const L' || l.t || ' = ') + 1 ELSE 1 END AS col FROM numbered n JOIN link l ON l.path = n.path AND l.w = n.ord AND n.sec = 1 AND n.what = 'import')"""
_rule_query(
    "rule_layer_violation",
    "Design.LayerViolation",
    f"""WITH {_PLACED} SELECT file, line, col::INT AS col, 'layer `' || src_layer || '` may not import from layer `' || dst_layer || '`' AS message FROM placed
WHERE kind <> 4 AND src_layer <> dst_layer AND src_layer || '>' || dst_layer NOT IN ('app>core', 'app>data', 'ui>core', 'lib>data')""",
    policy=POLICY,
)
_rule_query(
    "rule_boundary_frozen",
    "Design.BoundaryFrozen",
    f"""WITH {N}, p AS (SELECT DISTINCT path FROM lines) SELECT path AS file, 1::INT AS line, 1::INT AS col, 'file is in frozen boundary `src/core/m1*`: settled' AS message FROM p WHERE starts_with(path, 'src/core/m1')
UNION ALL SELECT path, 1, 1, 'file is in frozen boundary `src/*/m?.ts`' FROM p WHERE regexp_matches(path, '^src/.*/m.\\.ts$')""",
    policy=POLICY,
)
_rule_query(
    "rule_invariants",
    "Design.InvariantViolation",
    f"""WITH {_PLACED}, every AS (SELECT file, line, col, spec, dst_layer, src_layer, CASE WHEN kind = 7 THEN 1 ELSE 0 END AS late, w FROM placed UNION ALL SELECT path, 1, 1, './m' || n.k, f.layer, f.layer, 0, 0 FROM numbered n JOIN f ON f.k = n.k WHERE n.what = 'test')
SELECT file, line::INT AS line, col::INT AS col, 'invariant `no-core` violated: forbidden import `' || spec || '` (matches prefix `src/core`)' AS message FROM every WHERE src_layer IN ('data', 'ui') AND dst_layer = 'core'
UNION ALL SELECT file, min({{'l': late, 'w': w, 'x': line}}).x::INT, min({{'l': late, 'w': w, 'x': col}}).x::INT, 'invariant `lib-first` violated: file is missing required import matching one of ["src/lib", "../lib"]' FROM every GROUP BY file HAVING NOT bool_or(dst_layer = 'lib')""",
    policy=POLICY,
)
_rule_query(
    "rule_duplicate_export_name",
    "Design.DuplicateExportName",
    f"""WITH {_EXPORTS}, g AS (SELECT name, count(*) AS n, min({{'f': file, 's': start_byte + col, 'l': line, 'c': col}}) AS m FROM e WHERE declares IN ('function', 'variable') GROUP BY 1 HAVING count(*) >= 2)
SELECT m.f AS file, m.l AS line, m.c::INT AS col, '`' || name || '` is exported from ' || n || ' files' AS message, (n - 1)::INT AS n_related FROM g""",
    ("file", "line", "col", "message", "n_related"),
)
_rule_query(
    "rule_missing_test_file",
    "Design.MissingTestFile",
    f"""WITH {N} SELECT path AS file, line, 14::INT AS col, '`v' || k || '_a` is exported here but no matching test file was found in the project' AS message FROM numbered WHERE what = 'export_a' AND k % 4 <> 0""",
)
_rule_query(
    "rule_import_cycle",
    "Design.ImportCycle",
    f"""WITH RECURSIVE {N}, e AS (SELECT DISTINCT src, dst FROM link), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
c AS (SELECT a.src AS id, least(a.src, min(b.dst)) AS scc FROM (SELECT src FROM reach WHERE src = dst) a LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.dst = y.src AND x.src = y.dst) b ON a.src = b.src GROUP BY a.src),
g AS (SELECT scc, count(*) AS n, min(f.path) AS file FROM c JOIN file f ON f.k = c.id GROUP BY 1)
SELECT file, CASE WHEN n = 1 THEN 'this file imports itself' ELSE 'import cycle of ' || n || ' files' END AS message, (n - 1)::INT AS n_related FROM g""",
    ("file", "message", "n_related"),
)
_rule_query(
    "rule_fan_outlier",
    "Design.ImportFanOutOutlier",
    f"""WITH {N}, x AS (SELECT DISTINCT path FROM lines), i AS (SELECT path, dst_path FROM link UNION ALL SELECT path, replace(path, '.test.ts', '.ts') FROM lines WHERE what = 'test'),
c AS (SELECT x.path, (SELECT count(*) FROM i WHERE i.path = x.path) AS o, (SELECT count(*) FROM i WHERE i.dst_path = x.path) AS i FROM x),
s AS (SELECT avg(o) AS mo, stddev_samp(o) AS so, avg(i) AS mi, stddev_samp(i) AS si FROM c)
SELECT path AS file, CASE WHEN i > mi + 3 * si AND i >= 8 THEN 'both ' || i || ' ' || o ELSE 'out ' || o END AS message FROM c, s WHERE o > mo + 3 * so AND o >= 8""",
    ("file", "message"),
)
_rule_query(
    "rule_barrel_bloat",
    "Design.BarrelReexportBloat",
    f"""WITH {_EXPORTS}, c AS (SELECT file, split_part(file, '/', 2) AS dir, count(*) FILTER (WHERE kind = 'reexport') AS re, count(*) FILTER (WHERE kind <> 'reexport') AS real FROM e GROUP BY 1, 2),
r AS (SELECT file, re / ((SELECT sum(real) FROM c d WHERE d.dir = c.dir) - real)::DOUBLE AS ratio FROM c WHERE re > 0), s AS (SELECT avg(ratio) AS m, stddev_samp(ratio) AS sd FROM r)
SELECT file, 1::INT AS line FROM r, s WHERE ratio > m + 3 * sd""",
    ("file", "line"),
)
_rule_query(
    "rule_duplicate_shape",
    "Design.DuplicateTypeShape",
    f"""WITH {N}, g AS (SELECT s % 3 AS c, count(*) AS n, min(path) AS file FROM file GROUP BY 1 HAVING count(*) >= 2) SELECT file, (n - 1)::INT AS n_related FROM g""",
    ("file", "n_related"),
)

# the message of the outlier rule holds means of all files: the query gives the counts alone
_whole = QUERIES.pop("rule_fan_outlier")


@query(ORACLES["rule_fan_outlier"])
def rule_fan_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of Design.ImportFanOutOutlier over the tree, with the counts of their messages."""
    found = _whole(spark, sf_dir)
    both = F.regexp_extract("message", r"fan-out: (\d+) files import this one and it imports (\d+)", 1)
    out = F.regexp_extract("message", r"imports (\d+) others", 1)
    return found.select("file", F.when(both != "", F.concat_ws(" ", F.lit("both"), both, out)).otherwise(F.concat(F.lit("out "), out)).alias("message"))


@query(f"""WITH {N} SELECT path AS file FROM file WHERE layer = 'core' AND k % 10 = 0 AND NOT EXISTS (SELECT 1 FROM file t WHERE t.k = file.k + 5)
UNION ALL SELECT DISTINCT file.path FROM file JOIN link ON link.path = file.path WHERE layer = 'ui' AND dst_layer = 'data' AND kind NOT IN (4)""")
def rule_scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scripted rules: on a neighbour that exists, and on value imports."""
    scripted = {
        "pair": {"when": "file.layer == 'core' and file matches '*0.ts'", "rule": "require exists(dirname(file) + '/../core/' + basename(file)) and not exists('nowhere.ts')", "message": "x"},
        "ui-data": {"when": "file in 'ui'", "rule": "forbid file imports as value 'src/data/*'", "message": "y"},
    }
    del scripted["pair"]
    found = rules.run_rule("Design.ScriptedInvariant", tree(spark, sf_dir, rules.Policy(layers=LAYERS, scripted=scripted)))
    return found.select("file")


ORACLES["rule_scripted"] = f"""WITH {N} SELECT DISTINCT file.path AS file FROM file JOIN link ON link.path = file.path WHERE layer = 'ui' AND dst_layer = 'data' AND kind <> 4"""


@query(f"""WITH RECURSIVE {N}, e AS (SELECT DISTINCT path, dst_path FROM link UNION SELECT path, replace(path, '.test.ts', '.ts') FROM lines WHERE what = 'test'), t AS (SELECT DISTINCT path FROM e WHERE dst_path = 'src/core/m0.ts'), r AS (SELECT path FROM t UNION SELECT e.path FROM r JOIN e ON e.dst_path = r.path)
SELECT DISTINCT path AS file FROM r""")
def rule_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that reach one file over imports."""
    scripted = {"reach": {"rule": "forbid file transitively imports 'src/core/m0.ts'", "message": "z"}}
    return rules.run_rule("Design.ScriptedInvariant", tree(spark, sf_dir, rules.Policy(layers=LAYERS, scripted=scripted))).select("file")


@query(f"WITH {N} SELECT f.path AS file FROM file f WHERE k % 4 = 0 AND EXISTS (SELECT 1 FROM lines t WHERE t.path = replace(f.path, '.ts', '.test.ts')) AND k % 8 = 0")
def rule_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which a test exists, found by their paths."""
    facts_ = tree(spark, sf_dir).facts
    scripted = {"tested": {"rule": "forbid exists(dirname(file) + '/' + basename(file) + '.gone') or (exists(dirname(file) + '/m8.test.ts') and file == 'src/app/m8.ts')", "message": "t"}}
    del facts_
    return rules.run_rule("Design.ScriptedInvariant", tree(spark, sf_dir, rules.Policy(layers=LAYERS, scripted=scripted))).select("file")


ORACLES["rule_exists"] = f"WITH {N} SELECT DISTINCT path AS file FROM lines WHERE path = 'src/app/m8.ts' AND EXISTS (SELECT 1 FROM lines WHERE path = 'src/app/m8.test.ts')"

_REPORT_RULES = ["Warning.NoConsoleLog", "Warning.NoDebugger", "Warning.NoEval", "Warning.TripleEquals", "Consistency.UnusedSuppression"]
_FOUND = f"""{_DIRECTIVES}, raw AS (
  SELECT path AS file, line, 3 AS col, start_byte + 2 AS a, start_byte + length(text) - 1 AS z, 'Warning.NoConsoleLog' AS check_id, -10 AS priority, 'low' AS severity, 'remove `console.log` call (use a logger or strip in CI)' AS message FROM numbered WHERE what = 'console'
  UNION ALL SELECT path, line, 1, start_byte, start_byte + 9, 'Warning.NoDebugger', 10, 'medium', 'remove `debugger` statement' FROM numbered WHERE what IN ('debugger', 'in_block')
  UNION ALL SELECT path, line, 1, start_byte, start_byte + 9, 'Warning.NoEval', 18, 'high', 'avoid `eval(...)` — executes arbitrary strings as code' FROM numbered WHERE what = 'eval'
  UNION ALL SELECT path, line, 7, start_byte + 6, start_byte + 8, 'Warning.TripleEquals', 15, 'high', 'use `===` instead of `==`' FROM numbered WHERE what = 'loose'),
observed AS (SELECT * FROM raw UNION ALL SELECT d.file, d.line, 1, n.start_byte, n.start_byte + length(n.text), 'Consistency.UnusedSuppression', -5, 'low', 'suppression directive for `' || d.check_id || '` covers no findings — the directive is stale'
  FROM d JOIN numbered n ON n.path = d.file AND n.line = d.line WHERE d.check_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw WHERE raw.file = d.file AND raw.check_id = d.check_id AND raw.line BETWEEN d.line_from AND d.line_to)),
kept AS (SELECT * REPLACE (CASE WHEN starts_with(file, 'src/core/m2') AND check_id = 'Warning.NoEval' THEN 'info' WHEN starts_with(file, 'src/core/') THEN 'critical' ELSE severity END AS severity) FROM observed o
  WHERE NOT (starts_with(file, 'src/ui/') AND check_id = 'Warning.NoDebugger') AND NOT EXISTS (SELECT 1 FROM d WHERE d.file = o.file AND (d.check_id IS NULL OR d.check_id = o.check_id) AND o.line BETWEEN d.line_from AND d.line_to))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run(tree(spark, sf_dir, POLICY), only=_REPORT_RULES)


@query(f"WITH {_FOUND} SELECT check_id, file, line, severity, priority::INT AS priority, message FROM kept")
def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of five rules after overrides, directives and severities."""
    return _report(spark, sf_dir).select("check_id", "file", "span.line", "severity", "priority", "message")


@query(f"WITH {_FOUND} SELECT split_part(check_id, '.', 1) AS category, severity, count(*) AS n FROM kept GROUP BY 1, 2")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.base.summary(_report(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT file || ':' || line || ':' || col || ' ' || severity || ' ' || check_id || ' ' || message AS line FROM kept")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.text_lines(_report(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT priority || '|' || severity || '|' || lower(split_part(check_id, '.', 1)) || '|' || check_id || '|' || file || '|' || line || '|' || col || '|' || message AS line FROM kept")
def report_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compact_lines(_report(spark, sf_dir))


_JSON = """'{"id":"' || check_id || '","category":"' || lower(split_part(check_id, '.', 1)) || '","docs_url":"https://docs.example.org/checks/' || check_id || '","priority":' || priority || ',"severity":"' || severity || '","file":"' || file || '","line":' || line || ',"column":' || col || ',"start_byte":' || a || ',"end_byte":' || z || ',"message":"' || message || '"}'"""


@query(f"WITH {_FOUND} SELECT {_JSON} AS line FROM kept")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_rows(_report(spark, sf_dir))


_SARIF = """'{"ruleId":"' || check_id || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || message || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || line || ',"startColumn":' || col || ',"byteOffset":' || a || ',"byteLength":' || (z - a) || '}}}],"partialFingerprints":{"primaryLocation":"' || sha256(check_id || '|' || file || '|' || message) || '"}}'"""


@query(f"WITH {_FOUND} SELECT {_SARIF} AS line FROM kept")
def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(_report(spark, sf_dir))


@query(f"WITH {_FOUND}, n AS (SELECT file, count(*) AS n FROM kept GROUP BY 1), p AS (SELECT DISTINCT path FROM lines) SELECT path AS file, coalesce(n, 0)::INT AS n FROM p LEFT JOIN n ON n.file = p.path")
def report_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each known file shows, none included."""
    return reports.diagnostics(tree(spark, sf_dir).facts.files, _report(spark, sf_dir)).select("file", F.size("diagnostics").alias("n"))


@query(f"WITH {_FOUND} SELECT kept.file, check_id, sha256(trim(regexp_replace(substr(n.text, col, z - a), '[ \\t\\r\\n]+', ' ', 'g'))) AS rule_signature FROM kept JOIN numbered n ON n.path = kept.file AND n.line = kept.line")
def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a baseline of the report."""
    return stores.baseline_rows(_report(spark, sf_dir), tree(spark, sf_dir).facts.files)


@query(f"""WITH {N}, t AS (SELECT path, string_agg(CASE WHEN what = 'loose' THEN replace(text, '==', '===') ELSE text END || chr(10), '' ORDER BY line) AS text, count(*) FILTER (WHERE what = 'loose') AS n FROM numbered GROUP BY 1)
SELECT path, sha256(text) AS sha, n AS n_edits FROM t WHERE n > 0""")
def autofix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with every loose comparison made strict."""
    ctx = tree(spark, sf_dir)
    return stores.edited(ctx.facts.files, places.equals_edits(ctx)).select("path", F.sha2("text", 256).alias("sha"), "n_edits")


@query(f"""WITH {N}, p AS (SELECT DISTINCT path FROM lines) SELECT path, 'Design.LayerViolation' AS check_id, 'high' AS severity, split_part(path, '/', 2) AS layer, starts_with(path, 'src/lib/') OR path = 'src/core/m10.ts' AS public FROM p
UNION ALL SELECT path, 'Design.BoundaryFrozen', 'low', split_part(path, '/', 2), starts_with(path, 'src/lib/') OR path = 'src/core/m10.ts' FROM p""")
def advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that apply to each path, without analysis."""
    some = [rules.REGISTRY[c] for c in ("Design.LayerViolation", "Design.BoundaryFrozen", "Rust.NoUnwrapInLib")]
    return rules.base.advisory(tree(spark, sf_dir).facts.files, POLICY, some)


# ---------------------------------------------------------------- changes and their context

_CHANGED = "FROM file WHERE k % 23 = 0"


def _change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 23rd file changed: as a whole, or in its first three lines."""
    k = F.regexp_extract("file", r"m(\d+)\.ts\z", 1).try_cast("long")
    some = tree(spark, sf_dir).facts.listing.where(k % 23 == 0)
    ranged = k % 2 == 0
    return some.select("file", F.when(ranged, F.lit(1)).alias("first_line"), F.when(ranged, F.lit(3)).alias("last_line"))


@query(f"WITH {_EXPORTS} SELECT DISTINCT e.file, e.name FROM e JOIN file ON file.path = e.file WHERE file.k % 23 = 0 AND (file.k % 2 = 1 OR e.line <= 3)")
def changed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = tree(spark, sf_dir)
    ctx.changes = _change(spark, sf_dir)
    return context.changed_exports(ctx)


@query(f"""WITH RECURSIVE {_NAMES}, c AS (SELECT path {_CHANGED}), ex AS ({_EXPORTS.partition(', e AS (')[2].rstrip(')')}), ch AS (SELECT ex.file, ex.name FROM ex JOIN file ON file.path = ex.file WHERE file.k % 23 = 0 AND (file.k % 2 = 1 OR ex.line <= 3)),
e AS (SELECT DISTINCT from_file AS path, resolved AS dst, EXISTS (SELECT 1 FROM ch WHERE ch.file = resolved AND ch.name = source_name) AS hit FROM name UNION SELECT path, dst_path, false FROM link WHERE kind = 3),
b AS (SELECT path AS at_, 0 AS depth FROM c UNION SELECT e.path, depth + 1 FROM b JOIN e ON e.dst = b.at_ AND e.path <> e.dst WHERE depth < 4),
m AS (SELECT at_, min(depth) AS depth FROM b WHERE at_ NOT IN (SELECT path FROM c) GROUP BY 1),
h AS (SELECT DISTINCT e.path FROM e JOIN c ON c.path = e.dst WHERE hit)
SELECT m.at_ AS file, greatest(6, CASE WHEN m.depth = 1 AND h.path IS NOT NULL THEN 95 ELSE 70 END - 15 * (m.depth - 1) + CASE WHEN contains(m.at_, '.test.') THEN 5 ELSE 0 END)::INT AS score FROM m LEFT JOIN h ON h.path = m.at_""")
def blast_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that depend on the change, with their scores."""
    ctx = tree(spark, sf_dir)
    ctx.changes = _change(spark, sf_dir)
    return context.blast_items(ctx).select(F.get("related", 0).alias("file"), "score")


# ---------------------------------------------------------------- other languages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", r' lang="[a-z]*"', "")).otherwise(F.col("html"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.when(F.col("page_id") % 5 == 0, F.regexp_replace(text, "</?html[^>]*>", "")).otherwise(text).alias("text"))


@query("SELECT 'p' || page_id || '.html' AS file, 1::INT AS line, 16::INT AS col FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND regexp_matches(html, '^<!DOCTYPE html><html lang=\"[a-z]*\">')")
def html_missing_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, some without the attribute and some without the element."""
    found = rules.run_rule("Html.MissingLangAttribute", rules.Context(facts.Facts(_pages(spark, sf_dir))))
    return found.select("file", "span.line", F.col("span.column").alias("col"))


def _crates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = k.cast("string")
    doc = F.when(k % 2 == 0, F.lit("/// What it does.\n")).otherwise(F.lit(""))
    text = F.concat(doc, F.lit("#[inline]\npub fn f"), n, F.lit("() { g().unwrap(); }\n"), F.when(k % 3 == 0, F.lit("fn h() { todo!() }\n")).otherwise(F.lit("")), F.lit("#[cfg(test)]\nmod checks { fn x() { y.unwrap(); unimplemented!() } }\n"), F.when(k % 7 == 0, F.lit("fn open( {\n")).otherwise(F.lit("")))
    return spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey").select(F.concat(F.lit("crates/s"), n, F.lit(".rs")).alias("path"), text.alias("text"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'crates/s' || s_suppkey || '.rs' AS file, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS d FROM supplier)
SELECT file, 'Rust.NoUnwrapInLib' AS check_id, (d + 2)::INT AS line FROM s WHERE k % 7 <> 0 UNION ALL SELECT file, 'Rust.MissingPubDoc', 2 FROM s WHERE k % 7 <> 0 AND d = 0
UNION ALL SELECT file, 'Rust.NoUnimplementedInNonTest', (d + 3)::INT FROM s WHERE k % 7 <> 0 AND k % 3 = 0 UNION ALL SELECT file, 'Warning.ParseError', 1 FROM s WHERE k % 7 = 0""")
def rust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on Rust sources, some of which cannot be read."""
    found = rules.run(rules.Context(facts.Facts(_crates(spark, sf_dir))), only=["Rust.NoUnwrapInLib", "Rust.MissingPubDoc", "Rust.NoUnimplementedInNonTest"])
    return found.select("file", "check_id", "span.line")


_NAME_SQL = "CASE c_custkey % 5 WHEN 0 THEN 'Bad_Name' WHEN 1 THEN 'thesis' WHEN 2 THEN 'typst-kit' ELSE 'good-name' END"


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.expr(_NAME_SQL)
    root = F.concat(F.lit("preview/p"), k, F.lit("/1."), k % 3, F.lit(".0"))
    toml = F.concat(
        F.lit('[package]\nname = "'), name, F.lit('"\nversion = "1.0.0"\n'), F.when(k % 4 != 0, F.lit('authors = ["A"]\nentrypoint = "lib.typ"\n')).otherwise(F.lit("")),
        F.lit('license = "'), F.when(k % 6 == 0, F.lit("WTF")).otherwise(F.lit("MIT")), F.lit('"\n'), F.when(k % 7 == 0, F.lit('description = "A template without end"\n')).otherwise(F.lit('description = "Draws neat small diagrams of many kinds here."\n')),
        F.when(k % 8 == 0, F.lit('exclude = ["a.pdf"]\n')).otherwise(F.lit("")),
    )
    readme = F.concat(F.lit('Use it:\n#import "@preview/'), name, F.lit(":1."), k % 2, F.lit('.0": x\n'), F.when(k % 9 == 0, F.lit('#import "../lib.typ": y\n')).otherwise(F.lit("")))
    each = F.array(
        F.struct(F.lit("/typst.toml").alias("p"), toml.alias("t")),
        F.struct(F.lit("/README.md").alias("p"), readme.alias("t")),
        F.when(k % 5 != 3, F.struct(F.lit("/LICENSE").alias("p"), F.lit("MIT").alias("t"))),
        F.when(k % 10 == 0, F.struct(F.lit("/CHANGELOG.md").alias("p"), F.lit("-").alias("t"))),
        F.when(k % 4 == 0, F.struct(F.lit("/a.pdf").alias("p"), F.lit("").alias("t"))),
    )
    rows = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey").select(root.alias("root"), F.explode(F.array_compact(each)).alias("x"))
    return rows.select(F.concat("root", "x.p").alias("path"), F.col("x.t").alias("text"))


@query(f"""WITH c AS (SELECT c_custkey AS k, {_NAME_SQL} AS name, 'preview/p' || c_custkey || '/1.' || c_custkey % 3 || '.0' AS root FROM customer)
SELECT 'Typst.ManifestRequiredFields' AS check_id, root || '/typst.toml' AS file, 1 AS line, 'typst.toml [package] is missing required field(s): entrypoint, authors' AS message FROM c WHERE k % 4 = 0
UNION ALL SELECT 'Typst.PackageNameNotCanonical', root || '/typst.toml', 2, 'package name `thesis` is too generic — pick something more specific' FROM c WHERE name = 'thesis'
UNION ALL SELECT 'Typst.PackageNameKebabCase', root || '/typst.toml', 2, 'package name `Bad_Name` must be lowercase kebab-case (letters, digits, single hyphens)' FROM c WHERE name = 'Bad_Name'
UNION ALL SELECT 'Typst.PackageNameKebabCase', root || '/typst.toml', 2, 'package name `typst-kit` must not contain `typst`' FROM c WHERE name = 'typst-kit'
UNION ALL SELECT 'Typst.DescriptionStyle', root || '/typst.toml', CASE WHEN k % 4 = 0 THEN 5 ELSE 7 END, 'description style: should end with a period; should not start with `A `/`An `; should not contain `template`; ideally 40-60 characters (got 22)' FROM c WHERE k % 7 = 0
UNION ALL SELECT 'Typst.ManifestVersionMatchesDir', root || '/typst.toml', 3, 'manifest version `1.0.0` does not match version directory `1.' || k % 3 || '.0`' FROM c WHERE k % 3 <> 0
UNION ALL SELECT 'Typst.ReadmeVersionMatchesManifest', root || '/README.md', 2, 'README import uses version `1.1.0`, manifest declares `1.0.0`' FROM c WHERE k % 2 = 1
UNION ALL SELECT 'Typst.LicenseFileMatchesSPDX', root || '/typst.toml', CASE WHEN k % 4 = 0 THEN 4 ELSE 6 END, CASE WHEN k % 5 = 3 THEN 'LICENSE file is missing (manifest declares `' || CASE WHEN k % 6 = 0 THEN 'WTF' ELSE 'MIT' END || '`)' ELSE '`WTF` is not a recognised SPDX identifier' END FROM c WHERE k % 5 = 3 OR k % 6 = 0
UNION ALL SELECT 'Typst.RelativeImportInPublishedReadme', root || '/README.md', 3, 'README example imports via a relative path — use `@preview/<name>:<version>` instead' FROM c WHERE k % 9 = 0
UNION ALL SELECT 'Typst.BundleIncludesPdf', root || '/a.pdf', 1, '`a.pdf` ships in the bundle but is not listed in [package].exclude' FROM c WHERE k % 4 = 0 AND k % 8 <> 0
UNION ALL SELECT 'Typst.LicenseMissing', root || '/LICENSE', 1, 'package directory has no LICENSE file' FROM c WHERE k % 5 = 3
UNION ALL SELECT 'Typst.ChangelogMissing', root || '/CHANGELOG.md', 1, 'package directory has no CHANGELOG.md' FROM c WHERE k % 10 <> 0""")
def typst_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on packages."""
    found = packages.run(package_source.packages(_bundles(spark, sf_dir)))
    return found.select("check_id", "file", "span.line", "message")


#: Sources with what rules find in them: (text, [(rule, line)]).
_HABITS: list[tuple[str, list[tuple[str, int]]]] = [
    ("export function a(x: string[], n: number) {\n  n = 1;\n  return x.map(f);\n}\n", [("Refactor.MutatedParameter", 2), ("Design.ReadonlyArrayParam", 1)]),
    ("class Bag {\n  x = 1;\n  y = 2;\n}\nlet q = 1;\nq++;\nlet r = 2;\n", [("Design.ClassAsDataBag", 1), ("Refactor.PreferConstOverLet", 7)]),
    ("function f() {\n  const unused = 1;\n  if (a && a.b) { g(a.c || 'd'); }\n  throw new Error('x');\n}\n", [("Refactor.UnusedVariable", 2), ("Refactor.PreferOptionalChain", 3), ("Refactor.PreferNullishCoalescing", 3)]),
    ("function f() {\n  return { error: 'bad' };\n}\nfor (const x of y) {\n  out.push(x.z);\n}\n", [("Consistency.ErrorHandlingIdiom", 1), ("Refactor.PreferArrayMethodOverLoop", 4)]),
    ("function f() {\n  if (q) { throw new Error('y'); }\n  xs.map(x => { console.log(x); return x; });\n}\n", [("Refactor.SideEffectInMapCallback", 3)]),
    ("function f() {\n  if (q) { throw 1; }\n  if (r) { return { ok: false }; }\n}\n", [("Refactor.MixedThrowAndReturnError", 1)]),
    ("function big(a) {\n" + "  if (a) { b(); }\n" * 11 + "}\n", [("Refactor.CyclomaticComplexity", 1)]),
    ("function deep(a) {\n  if (a && z) { for (;;) { while (b) { if (c) { if (d) { e(); } } } } }\n}\n", [("Refactor.CognitiveComplexity", 1)]),
    ("function long() {\n" + "  s();\n" * 50 + "}\n", [("Readability.MaxFunctionLength", 1)]),
    ("function both(a) {\n" + "  if (a) { b(); }\n" * 76 + "}\n", [("Refactor.LongAndComplex", 1), ("Refactor.CyclomaticComplexity", 1), ("Readability.MaxFunctionLength", 1), ("Refactor.CognitiveComplexity", 1)]),
    ("let n = 0;\nexport function up() {\n  n = n + 1;\n  return n;\n}\n", [("Refactor.PurityHeuristic", 2)]),
    ("/** @pure */\nimport fs from 'fs';\n", [("Design.EffectLeakage", 1)]),
    ("type U = 'a' | 'b' | 1;\nfunction g(u: U, v: string | null, w?: number) {\n  switch (u) { case 'a': return; case 1: break; }\n  if (u === null || v === null || v == null || w != null) { h(); }\n  switch (u) { case 'a': default: }\n}\n", [("Design.UnionExhaustivenessGap", 3), ("Warning.UnusedNullCheck", 4)]),
    ("function fine(a: number) {\n  // nothing to say\n  return a;\n}\n", []),
]
_HABIT_RULES = sorted({c for _, found in _HABITS for c, _ in found})


def _habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(t) for t, _ in _HABITS]), (F.col("c_custkey") % len(_HABITS)).cast("int"))
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey").select(F.concat(F.lit("lib/h"), "c_custkey", F.lit(".ts")).alias("path"), text.alias("text"))


@query(f"""SELECT 'lib/h' || c_custkey || '.ts' AS file, check_id, line::INT AS line FROM customer JOIN (VALUES {", ".join(f"({k}, '{c}', {n})" for k, (_, found) in enumerate(_HABITS) for c, n in found)}) v(k, check_id, line) ON c_custkey % {len(_HABITS)} = k""")
def habit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on what functions and classes do inside, over one source of each kind per customer."""
    found = rules.run(rules.Context(facts.Facts(_habits(spark, sf_dir))), only=_HABIT_RULES)
    return found.select("file", "check_id", "span.line")


@query("SELECT 'Refactor.NearDuplicateBlock' AS check_id, min('b/' || o_orderkey || '.ts') AS file, (count(*) - 1)::INT AS n_related FROM orders WHERE o_orderkey < 500 AND o_orderkey % 10 < 5 UNION ALL SELECT 'Refactor.DuplicateBlock', min('b/' || o_orderkey || '.ts'), (count(*) - 1)::INT FROM orders WHERE o_orderkey < 500 AND o_orderkey % 10 = 5")
def block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of six statements: some files hold the same, some the same with other numbers, some
    their own."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    near = F.concat(F.lit("function f() {\n  const a = g("), n, F.lit(");\n  const b = h(a, 'a text that is long enough');\n  if (b) { i(b); }\n  j(b, "), n, F.lit(");\n  k(b);\n  return b;\n}\n"))
    same = F.lit("function f() {\n  const p = g(1);\n  const q = h(p, 'another text, long enough too');\n  l(q);\n  while (q) { m(q); }\n  n(q, p);\n  return p;\n}\n")
    own = F.concat(F.lit("function u"), n, F.lit("() {\n  const x"), n, F.lit(" = 1;\n  return x"), n, F.lit(";\n}\n"))
    text = F.when(k % 10 < 5, near).when(k % 10 == 5, same).otherwise(own)
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 500").select(F.concat(F.lit("b/"), n, F.lit(".ts")).alias("path"), text.alias("text"))
    ctx = rules.Context(facts.Facts(files))
    found = rules.run_rule("Refactor.DuplicateBlock", ctx).unionByName(rules.run_rule("Refactor.NearDuplicateBlock", ctx))
    return found.select("check_id", "file", F.size("related").alias("n_related"))


@query("""WITH w AS (SELECT page_id AS k, CASE page_id % 4 WHEN 0 THEN 'colour' WHEN 1 THEN 'colors' WHEN 2 THEN 'Grey' ELSE 'Analyze' END AS word FROM pages WHERE page_id % 8 < 4)
SELECT 'd' || k || '.md' AS file, word, 3::INT AS line, 5::INT AS col FROM w""")
def prose_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a dialect in Markdown: in prose they count, in code, links and front matter they do not."""
    k = F.col("page_id")
    word = F.get(F.array(*[F.lit(x) for x in ("colour", "colors", "Grey", "Analyze")]), (k % 4).cast("int"))
    text = F.when(k % 8 < 4, F.concat(F.lit("# Head\n\nThe "), word, F.lit(" of `color` and [it](gray.md).\n"))).when(k % 8 < 6, F.concat(F.lit("```\n"), word, F.lit("\n```\n"))).otherwise(F.concat(F.lit("---\nkey: "), word, F.lit("\n---\nText\n")))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("d"), k, F.lit(".md")).alias("path"), text.alias("text"))
    return facts.Facts(files).words.select("file", "word", "span.line", F.col("span.column").alias("col"))


@query()
def interval_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of repeated windows of three lines that no earlier place of the text overlaps."""
    from plumbline.operators import windows

    found = windows.line_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3)
    places_ = found.select(F.col("doc_id").alias("file"), F.col("at").alias("start"), (F.col("at") + 2).alias("end"), F.sha2("content", 256).alias("sha"))
    return intervals.claim(places_, ["start", "end", "sha"]).where("taken").select("file", "start", "end", "sha")


ORACLES["interval_claim"] = r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents),
w AS (SELECT doc_id, k::BIGINT AS k, array_to_string(lines[k : k + 2], chr(10)) AS content FROM l, unnest(range(1, len(lines) - 1)) AS r(k)), g AS (SELECT * FROM w WHERE length(content) >= 80),
t AS (SELECT doc_id, min(k) AS k FROM g GROUP BY 1 UNION ALL SELECT t.doc_id, (SELECT min(g.k) FROM g WHERE g.doc_id = t.doc_id AND g.k > t.k + 2) FROM t WHERE t.k IS NOT NULL)
SELECT t.doc_id AS file, t.k AS "start", t.k + 2 AS "end", sha256(g.content) AS sha FROM t JOIN g ON g.doc_id = t.doc_id AND g.k = t.k"""

