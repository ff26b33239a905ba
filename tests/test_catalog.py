"""Every query against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest
from plumbline import catalog
from plumbline.functions import paths
from plumbline.plans.predicate import Facts, PredicateError, compile_predicate
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def tidy(rows: list[tuple]) -> list[str]:
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name) -> None:
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert tidy([tuple(r[c] for c in names) for r in got]) == tidy(cur.fetchall())


def test_digest_skips_what_does_not_fit(spark) -> None:
    from plumbline.operators.findings import budgeted

    sizes = [50, 30, 100, 5, 20, 21, 19, 7]
    rows = spark.createDataFrame(list(enumerate(sizes)), "place long, tokens long")
    left, want = 131, []
    for k, n in enumerate(sizes):
        if max(20, n) <= left:
            want.append(k)
            left -= max(20, n)
    assert [r.place for r in budgeted(rows, 131, "tokens", "place").collect()] == want


@pytest.mark.parametrize(
    ("glob", "path", "crosses", "bounded"),
    [("src/*.ts", "src/a/b.ts", True, False), ("**/x.ts", "x.ts", True, True), ("a?c", "abc", True, True), ("[!a]b", "cb", True, True), ("{a,b}/c", "b/c", True, True), ("a.b", "axb", False, False)],
)
def test_globs(spark, glob, path, crosses, bounded) -> None:
    row = spark.range(1).select(paths.matches(F.lit(path), glob), paths.matches(F.lit(path), glob, True)).first()
    assert tuple(row) == (crosses, bounded)


def test_predicates(spark) -> None:
    facts = Facts(path=F.lit("src/a/b.ts"), layer=F.lit(None).cast("string"), exports=F.array(F.lit("run")))
    for text, want in {"file matches 'src/*'": True, "file.layer == ''": True, "file.layer != 'x'": True, "not file in 'x' and file exports 'r*'": True, "file == dirname(file) + '/' + basename(file)": True, "file == 'x' or (file == 'y')": False}.items():
        assert spark.range(1).select(compile_predicate(text, facts)[1]).first()[0] is want, text
    for text in ("file ~ 'x'", "file matches", "(file == 'x'", "core.x == 'y'", "file imports 'x'", "file == 'x' extra"):
        with pytest.raises(PredicateError):
            compile_predicate(text, facts)
