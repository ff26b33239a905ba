"""Near-duplicates (10) against all pairs of full shingle sets."""

from __future__ import annotations

import random
import re

import pytest
from plumbline.llm.components import components
from plumbline.llm.near_dup import near_duplicates

from .conftest import SCHEMA, odd_rows
from .test_language_model import words


def brute(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    named = [k for k, r in enumerate(rows) if r[0] is not None]
    for i, a in enumerate(named):
        for b in named[:i]:
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (both and 100 * both >= percent * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
    low: dict[int, int] = {}
    for k in named:
        low[root(k)] = min(low.get(root(k), rows[k][0]), rows[k][0])
    return [(r[0], len(sets[k]), low[root(k)] if r[0] is not None else None, r[0] is None or low[root(k)] == r[0]) for k, r in enumerate(rows)]


def order(r: tuple) -> tuple:
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_odd_rows(request, table) -> None:
    got = near_duplicates(request.getfixturevalue(table), width=4).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(odd_rows(), 4, 80), key=order)


@pytest.mark.parametrize("width", [4, 5])
def test_loose_groups(spark, width) -> None:
    """Chains of edits around a few texts: links near the limit, many of them, and unlike pairs."""
    rng = random.Random(5)
    rows = []
    for g in range(4):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60)) for _ in range(120)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
            rows.append((g * 1000 + k, " ".join(w), "en", "s", 0))
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows, width, 80), key=order)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_an_id_with_several_texts_keeps_the_links_of_all(spark, parts) -> None:
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(4)]
    near = lambda k: texts[k] + " end"
    rows = [(1, near(0)), (2, texts[0]), (2, texts[0]), (5, texts[1]), (5, near(0)), (6, near(1)), (7, texts[2]), (8, texts[3]), (8, ""), (9, near(3)), (10, None), (10, texts[2]), (None, texts[0])]
    rows = [(d, t, "en", "s", 0) for d, t in rows]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts), width=4).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows, 4, 80), key=order)


def test_tables_on_the_way_are_deleted(spark, odd) -> None:
    from plumbline import cut

    since = cut.mark(spark)
    got = near_duplicates(odd, width=4)
    assert cut.mark(spark) == since + 1 and got.count() == len(odd_rows())
    assert cut.release(spark, since) == 1


def test_pivots_that_buckets_repeat_are_one_row(spark) -> None:
    """A group of 30 classes in three components that meets in 60 buckets, all with the same pivots,
    beside buckets of its own for each pair of neighbours."""
    from plumbline.llm.near_dup import _pivots_met

    label = lambda d: d // 10 * 10
    buckets = {k: list(range(30)) for k in range(60)} | {100 + d: [d, d + 1] for d in range(29)}
    rows = spark.createDataFrame([(k, d, label(d)) for k, b in buckets.items() for d in b], "key long, doc_id long, label long")
    got = [(r["doc_id"], r["x"]["doc_id"], r["x"]["label"]) for r in _pivots_met(rows).collect()]
    last = next(r["d"] for r in spark.range(30).selectExpr("max_by(id, xxhash64(id)) d").collect())
    want = {(d, p, label(p)) for d in range(30) for p in (0, last) if label(p) != label(d)}
    want |= {pair for d in (9, 19) for pair in ((d, d + 1, d + 1), (d + 1, d, label(d)))}
    assert sorted(got) == sorted(want)


def test_parity_bits_bound_the_difference() -> None:
    import numpy as np
    from plumbline.llm import near_dup

    rng = np.random.default_rng(4)
    for n in (1, 40, 900, 6000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: int(0.8 * n)], rng.integers(0, 2**63, max(1, n // 5)).astype(np.uint64)])
        differ = sum(int(x).bit_count() for x in (near_dup.parity_bits(a) ^ near_dup.parity_bits(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_nothing(empty) -> None:
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark) -> None:
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {k: 0 for k in range(101)} | {400: 400, 500: 400}


def test_words_are_ascii_lower_case() -> None:
    assert words("Ä B\x0bC\x1cd") == re.split(" ", "Ä b c\x1cd")
