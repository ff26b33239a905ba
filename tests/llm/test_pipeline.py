"""The pipeline's stages, one by one and as a whole, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline

from .conftest import SCHEMA


def clean_text(n: int, seed: int) -> str:
    """``n`` words that pass the rules: a stop word in each five, hardly any repeats."""
    rng = random.Random(seed)
    return " ".join("the" if k % 5 == 0 else "".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for k in range(n))


def test_long_clean_documents_stay(spark) -> None:
    rows = [(1, clean_text(100_000, 1), "en", "a", 0), (2, clean_text(100_001, 2), "en", "a", 0), (3, "short", "en", "a", 0), (4, "no stop words here " * 40_000, "en", "a", 0)]
    got = corpus_pipeline.quality(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [1, 2]


def test_rows_that_share_a_doc_id_are_judged_each(spark) -> None:
    a, b, c, d = (clean_text(90, k) for k in (11, 12, 13, 14))
    rows = [(3, b), (7, a), (7, b), (8, c), (8, c), (None, c), (None, d), (None, d), (9, None), (9, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, b), (7, a), (8, c), (None, d), (9, None), (9, None)])
