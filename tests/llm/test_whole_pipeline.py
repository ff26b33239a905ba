"""The pipeline as a whole against a plain-Python version of its five stages."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from plumbline.llm.quality_rules import STOP_WORDS
from pyspark.sql import functions as F

from .conftest import SCHEMA
from .test_near_duplicates import brute
from .test_pipeline import clean_text
from .test_rules_and_mixing import WORD, base_spans
from .test_shards_and_packing import crc, ids_of  # noqa: F401

PERSONAL = " mail me@site.org or 10.1.2.3 or +49 30 1234567 or card 4111 1111 1111 1111 or password=hunter2"
SECRET = re.compile(r"(?<![A-Za-z0-9_])password=[^\x20\x09-\x0D]+")


def small_rows() -> list[tuple]:
    a, b, c, d = (clean_text(90, k) for k in (21, 22, 23, 24))
    rows = [(1, None, "a"), (2, "", "a"), (3, b, "a"), (7, a, "b"), (7, b, "b"), (8, c, "b"), (8, c, "b"), (None, c, "b"), (None, d, None), (None, d, None)]
    rows += [(20, clean_text(101_000, 25), "a"), (21, "junk ### " * 60, "a"), (22, clean_text(80, 26) + PERSONAL, "c"), (23, c + " extra", "c")]
    rows += [(30 + k, clean_text(60 + 9 * k, 40 + k), "abc"[k % 3]) for k in range(12)]
    return [(k, t, "en", s, 0) for k, t, s in rows]


def good(text: str | None) -> bool:
    w = WORD.findall(text or "")
    if len(w) < 50:
        return False
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars = len(w), sum(map(len, w))
    upper = sum(unicodedata.category(x) == "Lu" for x in text)
    return (
        2 * len(repeated) <= n and 2 <= chars / n <= 12 and len(re.findall(r"[#*$%&|<>]", text)) <= 0.1 * n and len(re.findall("[!?;:]", text)) <= 0.5 * n
        and upper <= 0.5 * chars and sum(x.lower() in STOP_WORDS for x in w) >= 0.02 * n and len(lines) - len(set(lines)) <= 0.4 * len(lines)
    )


def redacted(text: str) -> str:
    for kind, a, b in sorted(base_spans(text) + [("secret", m.start(), m.end()) for m in SECRET.finditer(text)], key=lambda s: -s[1]):
        text = text[:a] + f"<{kind.upper()}>" + text[b:]
    return text


def times_taken(rows: list[tuple]) -> list[int]:
    size = [len(WORD.findall(r[1])) for r in rows]
    total: dict = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target: dict = {}
    while left := [s for s in total if s not in target]:
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * level > 3 * total[s]]
        target |= {s: 3.0 * total[s] for s in full} if full else {s: round(weight[s] * level, 6) for s in left}
    out = [0] * len(rows)
    for s in total:
        epochs = min(3, math.floor(target[s] / total[s]))
        rest, upto = target[s] - epochs * total[s], 0

        def key(k: int) -> tuple:
            name, text = rows[k][0], rows[k][1]
            drawn_by = "text " + hashlib.md5(text.encode()).hexdigest() if name is None else name
            u = (int(hashlib.md5(f"mix-1:{drawn_by}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / (0.1 + 0.9 * sum(x.isalpha() or x in " \t\n\x0b\x0c\r" for x in text) / len(text)), name or 0, size[k]

        for k in sorted((k for k in range(len(rows)) if rows[k][3] == s), key=key):
            upto += size[k]
            out[k] = epochs + (upto <= rest)
    return out


def test_whole_pipeline(spark, tmp_path, ids_of) -> None:  # noqa: F811
    rows = small_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted((r for r in rows if good(r[1])), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    groups = brute([(k, *r[1:]) for k, r in enumerate(kept)], 5, 80)
    clean = [(r[0], redacted(r[1]), *r[2:]) for r, g in zip(kept, groups, strict=True) if g[3]]
    assert {r[0] for r in clean} == {3, 7, 8, None, 20, 22, *range(30, 42)} and any("<SECRET>" in r[1] for r in clean)
    want: Counter = Counter()
    for r, n in zip(clean, times_taken(clean), strict=True):
        ids = ids_of(r[1])
        for at in range(0, len(ids), 1024):
            want[(r[0], at, min(1024, len(ids) - at), crc(ids[at : at + 1024]), len(ids))] += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == +want
    windows: dict = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    left: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(1024 - n)
    assert len(windows) == len(left)
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_a_failed_run_goes_on_where_it_ended(spark, tmp_path, monkeypatch) -> None:
    rows = [(k, clean_text(60 + k, k), "en", "ab"[k % 2], 0) for k in range(6)]
    spark.createDataFrame(rows, SCHEMA).withColumn("x.y", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    calls: list[str] = []

    def counted(name, stage):  # noqa: ANN001, ANN202
        def run(*args):  # noqa: ANN002, ANN202
            calls.append(name)
            if name == "mixed" and calls.count("mixed") == 1:
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*x) for x in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/stages")
    got = corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/stages").select("doc_id", "start", "ids_crc32").collect()
    assert calls == ["quality", "near_duplicates", "private", "mixed", "mixed", "packed"]
    monkeypatch.undo()
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_no_documents(spark, tmp_path) -> None:
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
