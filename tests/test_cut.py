"""Cut points: where they go, and that they go away."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from plumbline import api, cut, rules


def test_a_cluster_needs_a_shared_folder() -> None:
    nothing = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut.shared_dir(session)


def test_cut_points_are_deleted(spark) -> None:
    since = cut.mark(spark)
    rows = cut.written(spark.range(5), "one")
    twice = cut.finished(rows.selectExpr("id * 2 AS id"), "two", since)
    assert sorted(r.id for r in twice.collect()) == [0, 2, 4, 6, 8] and cut.mark(spark) == since + 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
        rows.collect()
    assert cut.release(spark, since) == 1 and cut.mark(spark) == since


def test_advice_as_json(spark) -> None:
    files = spark.createDataFrame([("src/a.ts",), ("lib.rs",), ("notes.txt",)], "path string")
    policy = rules.Policy(layers={"s": ["src/*"]}, public_api=["src/a.ts"], disabled=["Rust.NoUnwrapInLib"])
    got = {r.path: r.line for r in api.advise(files, policy).collect()}
    assert '"layer":"s","public_api":true' in got["src/a.ts"] and '"rule":"Design.ImportCycle"' in got["src/a.ts"] and "Rust." not in got["src/a.ts"]
    assert "Rust.MissingPubDoc" in got["lib.rs"] and "Rust.NoUnwrapInLib" not in got["lib.rs"] and "notes.txt" in got
