"""What must not go to one task, to the driver, or grow with a square."""

from __future__ import annotations

from plumbline import corpora, facts, tree
from pyspark.sql import functions as F

from .test_catalog import SF


def test_short_files_are_read_by_many_tasks(spark) -> None:
    """Few bytes of keys make texts that take long to read."""
    for files in (tree._habits(spark, SF), tree._bundles(spark, SF), corpora.files(spark, SF)):
        assert files.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_a_text_that_occurs_again_keeps_its_own_path(spark) -> None:
    text = "import { a } from './b';\nexport interface T { x: string; y: number }\nexport const c = a;\n"
    paths = ["p/one.ts", "p/two.ts", "q/one.ts", "p/one.js", "p/three.tsx"]
    got = facts.extract(spark.createDataFrame([(p, text) for p in paths], "path string, text string").coalesce(1)).collect()
    assert {r.file: r.asDict(True) for r in got} == {p: facts.read_one(p, text) for p in paths}


def test_imports_are_read_without_the_rest(spark) -> None:
    rows = [("a.ts", "import { x } from './b';\nx();\n"), ("b.ts", "export const x = 1;\n"), ("c.ts", "(")]
    held = facts.Facts(spark.createDataFrame(rows, "path string, text string"))
    assert [(r.file, r.error is None) for r in held.errors.collect()] == [("c.ts", False)]
    assert [(r.from_file, r.resolved) for r in held.imports.collect()] == [("a.ts", "b.ts")]
    assert held.listing.count() == 3
    assert "stored" not in held.__dict__ and "functions" not in held.modules.columns


def test_scopes_end_where_the_sql_rounds_to(spark, tmp_path) -> None:
    """A half goes to the even number: 2.5 lines are 2, 3.5 are 4."""
    import duckdb
    from plumbline import catalog

    duckdb.execute(f"""COPY (SELECT * FROM (VALUES (1, 1, 'view', 0.25, 0), (2, 1, 'click', 1.0, 3), (3, 2, 'view', 0.35, 0), (4, 2, 'click', 1.0, 4)) v(event_id, user_id, event_type, value, m)
    SELECT event_id, user_id, event_type, value::DOUBLE AS value, TIMESTAMP '2024-01-01' + to_minutes(m) AS ts) TO '{tmp_path}/events.parquet'""".replace("SELECT * FROM (VALUES", "FROM (VALUES", 1))
    got = sorted(tuple(r[c] for c in ("event_id", "scope", "how")) for r in catalog.QUERIES["enclosing_scope"](spark, str(tmp_path)).collect())
    want = duckdb.execute(catalog.ORACLES["enclosing_scope"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert got == sorted(want) == [(2, None, None), (4, 3, "inside")]


def _copies(n: int = 5) -> list[tuple[int, int]]:
    """``n`` apart copies of a graph with a cycle, ways into and out of it, and a self loop; one is larger."""
    one = [(1, 2), (2, 3), (3, 1), (0, 1), (3, 4), (4, 5), (6, 6)]
    return [(100 * k + a, 100 * k + b) for k in range(n) for a, b in one] + [(5, 7), (7, 8), (8, 7)]


def test_apart_graphs_are_searched_by_tasks(spark, monkeypatch) -> None:
    """Beyond the limit, rounds of joins are left to components that are themselves beyond it."""
    from plumbline.operators import graph

    df = spark.createDataFrame([*_copies(), (None, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (101,), (4,), (999,), (None,)], "id long")
    want_reach, want_scc = sorted(map(tuple, graph.closure(df, seeds=seeds).collect())), sorted(map(tuple, graph.strong_components(df).collect()))
    joined, sizes = graph._joined, []
    monkeypatch.setattr(graph, "_joined", lambda edges, starts, depth: sizes.append(edges.count()) or joined(edges, starts, depth))
    monkeypatch.setattr(graph, "LOCAL_EDGES", 6)
    assert sorted(map(tuple, graph.closure(df, seeds=seeds).collect())) == want_reach
    assert sizes == [9]
    coloured, left = graph._coloured, []
    monkeypatch.setattr(graph, "_coloured", lambda edges: left.append(edges.count()) or coloured(edges))
    assert sorted(map(tuple, graph.strong_components(df, local_edges=6).collect())) == want_scc
    assert left and max(left) < 9 and {(8, 7), (101, 101), (106, 106)} <= set(want_scc)


def test_reached_nodes_keep_one_target(spark) -> None:
    """Not a row for each target a node reaches."""
    from plumbline.operators import graph

    df = spark.createDataFrame([(k, k + 1) for k in range(8)], "src long, dst long")
    ids = spark.range(9)
    made = graph.written
    written: list[int] = []

    def counted(rows, name):  # noqa: ANN001, ANN202
        out = made(rows, name)
        written.append(out.count())
        return out

    graph.written = counted
    try:
        assert sorted(map(tuple, graph.reaching(df, ids, ids).collect())) == [(k, k) for k in range(9)]
        assert sorted(map(tuple, graph.reaching(df, ids, spark.range(6, 9)).collect())) == [(k, max(k, 6)) if k > 6 else (k, 6) for k in range(9)]
    finally:
        graph.written = made
    assert max(written) <= 9


def test_nearest_rank_counts_a_narrow_band(spark) -> None:
    import math
    import random

    from plumbline.operators import stats

    pick = random.Random(3)
    for values in ([1.5], [2.0] * 9 + [7.0], [pick.randint(0, 40) * 0.5 for _ in range(700)], [pick.random() for _ in range(3000)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        percents = (1, 50, 95, 100)
        row = spark.range(1).select(*[stats.nearest_rank(df, "v", p).alias(f"p{p}") for p in percents])
        assert "percentile_disc" not in row._jdf.queryExecution().toString().lower()
        assert list(row.first()) == [sorted(values)[math.ceil(len(values) * p / 100) - 1] for p in percents]
    empty = spark.createDataFrame([(None,)], "v double")
    assert spark.range(1).select(stats.nearest_rank(empty, "v", 95)).first()[0] is None


def test_token_windows_without_a_row_each(spark) -> None:
    """Copies, repeats within a text, shifted copies and one word over and over."""
    import random

    from plumbline.operators import windows

    pick = random.Random(7)
    base = [pick.choice(["a", "b", "ça", "d", "e"]) * pick.randint(1, 3) for _ in range(300)]
    texts = [" ".join(base), "x y\t" + "\n".join(base[20:200]), " ".join(base[:40]), "w " * 90, " ".join(base[100:] + base[:120]), None, "", " ".join(base)]
    docs = spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for width in (12, 50):
        want = windows.repeated_windows(windows.token_windows(docs, width)).collect()
        got = windows.repeated_token_windows(docs, width).collect()
        assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_templates_are_tried_by_many_tasks(spark) -> None:
    from plumbline import rules

    found = rules.run_rule("Design.MissingTestFile", tree.tree(spark, SF))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    files = spark.createDataFrame([(f"a{k}.ts", "x") for k in range(60)], "path string, text string").coalesce(1)
    assert facts.extract(files).select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism
