"""Every query over the source tree against its SQL, which reads no text."""

from __future__ import annotations

import duckdb
import pytest
from plumbline import tree

from .test_catalog import SF, TABLES, tidy


@pytest.mark.parametrize("name", sorted(tree.QUERIES))
def test_query(spark, name) -> None:
    df = tree.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(tree.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert tidy([tuple(r[c] for c in names) for r in df.collect()]) == tidy(cur.fetchall())
