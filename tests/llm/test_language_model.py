"""The hidden Markov model (9) against plain sums over paths and tokens."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from plumbline.llm import hmm

from .conftest import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def small_model(seed: int = 1, states: int = 3, symbols: int = 5) -> hmm.Model:
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def path_chance(x: np.ndarray, path: tuple, m: hmm.Model) -> float:
    p = m.start[path[0]] * m.emit[x[0], path[0]]
    for t in range(1, len(x)):
        p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
    return p


PARTS = [np.array(x, np.int32) for x in ([0, 1, 2, 3, 4], [3], [1, 1, 0], [4, 2], [0, 4, 4, 1, 3, 2])]


def test_forward_sums_all_paths() -> None:
    m = small_model()
    want = [math.log10(sum(path_chance(x, p, m) for p in itertools.product(range(3), repeat=len(x)))) for x in PARTS]
    assert np.allclose(hmm.log_likelihoods(PARTS, m), want)


@pytest.mark.parametrize("segment", [1, 2, 3, 4, 100])
def test_baum_welch_counts_are_expectations(segment) -> None:
    """Whatever the segments: nothing is lost where they meet."""
    m = small_model()
    emit, move, start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    total = hmm.expected(PARTS, m, emit, move, start, segment)
    e2, m2, s2, t2 = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for x in PARTS:
        each = {p: path_chance(x, p, m) for p in itertools.product(range(3), repeat=len(x))}
        z = sum(each.values())
        t2 += math.log10(z)
        for p, c in each.items():
            s2[p[0]] += c / z
            for t, k in enumerate(p):
                e2[x[t], k] += c / z
                if t:
                    m2[p[t - 1], k] += c / z
    assert np.allclose(emit, e2) and np.allclose(move, m2) and np.allclose(start, s2) and math.isclose(total, t2)


def test_segments_of_a_long_text_do_not_matter(monkeypatch) -> None:
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 3_000)  # several blocks
    x = [np.random.default_rng(3).integers(0, 5, n).astype(np.int32) for n in (9_000, 1, 700, 2_049, 2_050)]
    seen = []
    for segment in (1_024, 10**6):
        emit, move, start = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
        seen.append((hmm.expected(x, small_model(), emit, move, start, segment), emit, move, start))
        assert math.isclose(start.sum(), len(x)) and math.isclose(move.sum(), sum(map(len, x)) - len(x)) and math.isclose(emit.sum(), sum(map(len, x)))
    assert all(np.allclose(a, b) for a, b in zip(*seen, strict=True))


def test_most_frequent_words(spark) -> None:
    words = spark.createDataFrame([(f"w{k:03d}".encode(), 1 + (k * 7919) % 50) for k in range(300)], "word binary, c long").repartition(7)
    want = sorted(((bytes(r.word), r.c) for r in words.collect()), key=lambda r: (-r[1], r[0]))
    for k in (1, 17, 299, 1000):
        assert [(bytes(r.word), r.c) for r in hmm.most_frequent(words, k).collect()] == want[:k]


def test_a_long_sequence_does_not_underflow() -> None:
    x = np.tile(np.arange(5, dtype=np.int32), 20_000)
    assert -200_000 < hmm.log_likelihoods([x], small_model())[0] < -1000


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_base_counts(request, table) -> None:
    got = hmm.score(request.getfixturevalue(table)).collect()
    held_out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c: Counter = Counter()
    for r in odd_rows():
        if not held_out(r[0]):
            c.update([*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in odd_rows():
        toks = [*words(r[1]), None]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)
        want.append((r[0], held_out(r[0]), len(toks), sum(c[t] > 0 for t in toks), n, base))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-4) and math.isfinite(a[6]) and a[6] <= 1e-6


def test_no_documents(empty) -> None:
    assert hmm.score(empty).count() == 0


def test_held_out_texts_are_likelier_than_by_counts(spark) -> None:
    got = hmm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out AND n_tokens > 100").collect()
    assert sum(r.score - r.base_score for r in got) > 0
