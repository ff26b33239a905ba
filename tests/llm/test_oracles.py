"""Every query that has SQL against it, run by DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest
from plumbline.llm import oracles, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, name) -> None:
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    want = tidy(cur.fetchall())
    assert want and tidy([tuple(r[c] for c in names) for r in df.collect()]) == want


def test_pairs_share_a_prompt(spark) -> None:
    got = queries.op1_preferences(spark, SF).collect()
    assert sum(r.prompt_turns > 0 and r.status == "paired" for r in got) > len(got) / 2
