"""Rules (6), personal data (8), mixing (3), media (5), preferences (1) and sites (4) on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest
from plumbline.llm import chat, matroska, mixing, pii, quality_rules, site_quality
from pyspark.sql import functions as F

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def base_spans(text: str | None) -> list[tuple]:
    # without these marks the patterns match nothing, but take the square of the text's length to find out
    marks = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    return [(k, m.start(), m.end()) for k, (p, ok) in PATTERNS.items() if marks[k] in (text or "") for m in re.finditer(p, text or "") if ok(m[0])]


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_personal_data(request, table) -> None:
    got = pii.find(request.getfixturevalue(table)).collect()
    found = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.pii_spans if s.kind in PATTERNS)) for r in got)
    assert found == Counter((r[0], tuple(base_spans(r[1]))) for r in odd_rows())


def test_checksums(spark) -> None:
    rows = spark.createDataFrame([("GB82WEST12345698765432", "4111111111111111"), ("GB83WEST12345698765432", "4111111111111112")], "iban string, card string")
    assert [tuple(r) for r in rows.select(pii.mod97_ok(F.col("iban")), pii.luhn_ok(F.col("card"))).collect()] == [(True, True), (False, False)]


def test_redaction(spark, odd) -> None:
    rows = spark.createDataFrame([(1, "to a@b.c or 1.2.3.4."), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r.text for r in pii.redact(rows).orderBy("doc_id").collect()] == ["to <EMAIL> or <IP>.", None, "clean"]
    assert pii.redact(odd).count() == len(odd_rows())


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_quality_counts(request, table) -> None:
    want = Counter()
    for r in odd_rows():
        text, w = r[1] or "", WORD.findall(r[1] or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)] += 1
    got = quality_rules.judge(request.getfixturevalue(table)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_mixing(request, table) -> None:
    got = mixing.mix(request.getfixturevalue(table)).collect()
    source = {}
    for r in odd_rows():
        source[r[3]] = source.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    assert len(got) == len(odd_rows()) and all(r.taken <= 3 * r.size for r in got)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in odd_rows())
    assert all(r.target <= 3 * r.source_size for r in got)
    again = mixing.mix(request.getfixturevalue(table).repartition(3), broadcast_sources=1).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    # a source's words come within one document of its target
    for s, n in source.items():
        ids = {r[0] for r in odd_rows() if r[3] == s and r[0] not in (None, 5)}
        own = [r for r in got if r.doc_id in ids]
        if len(own) == sum(r[3] == s for r in odd_rows()):
            assert own[0].source_size == n and own[0].target - max(r.size for r in own) <= sum(r.taken for r in own) <= own[0].target + 1e-6


def test_mixed_rows(spark, odd) -> None:
    """Each document as often as ``mix`` takes it; blanks never; a document is taken whole."""
    taken = Counter()
    for r in mixing.mix(odd).collect():
        if r.size:
            taken[r.doc_id, r.size] += r.taken // r.size
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in mixing.mixed(odd.withColumn("a.b", F.lit(1))).collect())
    assert got == Counter({k: n for k, n in taken.items() if n}) and all(n for _, n in got)
    rows = [(None, f"text number {k}", "en", "s", 0) for k in range(40)]
    keys = mixing.mix(spark.createDataFrame(rows, odd.schema), share=0.5).collect()
    assert 0 < sum(r.taken > 0 for r in keys) < 40  # rows without an id draw one by one


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_media_round_trip(request, table) -> None:
    want = Counter()
    for r in odd_rows():
        own = (r[1] or "").encode()
        payload = own + b" " * (-len(own) % 192 or (0 if own else 192))
        want[(r[0], len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    got = matroska.store(request.getfixturevalue(table)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want


def test_packets_and_damage(spark) -> None:
    file = matroska.mux(bytes(range(192)) * 200)
    rows = spark.createDataFrame([(1, file), (2, file[:-7]), (3, None), (4, b"\0")], "k long, f binary")
    got = matroska.packets(rows, "k", "f").collect()
    one = [r for r in got if r.k == 1]
    assert b"".join(file[r.offset : r.offset + r.size] for r in one) == bytes(range(192)) * 200
    assert {r.lacing for r in one} == {"xiph", "fixed", "ebml"} and [r.timestamp_ns for r in one] == sorted(r.timestamp_ns for r in one)
    assert sorted(r.k for r in got if r.error) == [2, 3, 4]


TURNS = "conv_id long, turn long, role string, text string"


def test_preferences(spark) -> None:
    turns = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (0, 3, "assistant", "dd"), (0, 4, "user", "e"), (1, 0, None, "a"), (1, 1, "assistant", None), (4, 0, "user", None), (None, None, None, None), (None, 1, "assistant", "z")]
    got = {(r.pair_id, r.chosen): r for r in chat.preferences(chat.branch_pairs(spark.createDataFrame(turns, TURNS))).collect()}
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    zero = got[0, turn("assistant", "dd")]
    assert zero.prompt == turn("user", "a") + turn("assistant", "b") + turn("user", "c") and zero.prompt_turns == 3
    assert zero.rejected == turn("assistant", "b") and zero.status == "paired" and [tuple(x) for x in zero.chosen_mask] == [(14, 0), (10, 1)]
    # the answer is empty, and so is what stands in its place
    assert got[1, ""].status == "equal" and got[1, ""].prompt == turn("user", "a") + turn("assistant", "")
    assert got[4, turn("user", "")].status == "unpaired" and got[4, turn("user", "")].rejected is None
    assert {k for k in got if k[0] is None} == {(None, turn("user", "")), (None, turn("assistant", "z"))} and len(got) == 5


def test_preferences_of_given_pairs(spark) -> None:
    """Prefixes, ties, repeats, long texts, empty and missing sides."""
    t = lambda *texts: [("user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(texts)]
    rows = [(1, t("a", "b"), t("a", "b", "c")), (2, t("a"), t("a")), (2, t("a"), t("a")), (3, t("a", "x" * 100_000), t("a", "y")), (4, [], t("a")), (5, None, t("a")), (6, None, None)]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}").withColumns({"prompt": F.lit(1), "status": F.lit("mine")})
    got = sorted((r.pair_id, r.status, r.prompt_turns, len(r.chosen) if r.chosen is not None else None) for r in chat.preferences(df).collect())
    size = lambda *texts: sum(len(f"<|{r}|>\n{x}<|end|>\n") for r, x in t(*texts))
    assert got == [(1, "prefix", 1, size("a", "b") - size("a")), (2, "equal", 1, 0), (2, "equal", 1, 0), (3, "paired", 1, size("a", "x" * 100_000) - size("a")), (4, "prefix", 0, 0), (5, "unpaired", 0, None), (6, "unpaired", 0, None)]
    assert chat.preferences(chat.branch_pairs(spark.createDataFrame([], TURNS))).count() == 0


def test_packets_of_any_muxer(spark) -> None:
    """Clusters of unknown size, block groups, uneven laces, and numbers beyond their columns."""
    import struct as st

    e, n = matroska._element, matroska._number
    block = lambda lacing, body, time=0, track=b"\x81": track + st.pack(">hB", time, lacing << 1) + body
    xiph = block(1, bytes([2, 255, 1, 3]) + b"a" * 256 + b"b" * 3 + b"c" * 5)
    ebml = block(3, bytes([2, 0x84, 0xC0]) + b"a" * 4 + b"b" * 5 + b"c" * 2)  # 4, then 4 + 1
    unknown = (matroska.CLUSTER).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + n(0xE7, 7) + e(0xA3, xiph)
    known = e(matroska.CLUSTER, n(0xE7, 20) + e(0xA0, e(0xA1, ebml)) + e(0xA0, e(0xA1, block(0, b"z", 3)) + e(0xFB, b"\x01")))
    whole = lambda info, body: matroska._HEADER + e(matroska.SEGMENT, e(matroska.INFO, info) + body)
    rows = [(1, whole(n(0x2AD7B1, 1000), unknown + known)), (2, whole(n(0x2AD7B1, 0), known)), (3, whole(n(0x2AD7B1, 1 << 62), known)), (4, whole(b"", e(matroska.CLUSTER, e(0xA3, block(0, b"q", 0, b"\x08" + b"\xff" * 4)))))]
    got = matroska.packets(spark.createDataFrame(rows, "k long, f binary"), "k", "f").collect()
    one = [(r.size, r.timestamp_ns, r.lacing, r.keyframe, r.cluster) for r in got if r.k == 1]
    assert one == [(256, 7000, "xiph", False, 0), (3, 7000, "xiph", False, 0), (5, 7000, "xiph", False, 0), (4, 20000, "ebml", True, 1), (5, 20000, "ebml", True, 1), (2, 20000, "ebml", True, 1), (1, 23000, "none", False, 1)]
    assert [r.k for r in got if r.error] == [2, 3, 4]


def test_site_posteriors(spark) -> None:
    """Rates and posteriors again in plain Python, from the evidence."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = site_quality.classify(docs, labels, broadcast_paths=1).collect()
    site = {r.doc_id: (r.source, r.lang) for r in docs.select("doc_id", "source", "lang").collect()}
    known = [r for r in labels.collect() if r.quality is not None and r.toxic is not None and r.doc_id in site]
    expit, logit = lambda x: 1 / (1 + math.exp(-x)), lambda p: math.log(p / (1 - p))

    def strength(groups: list[tuple[float, int]]) -> float:
        n = sum(k for _, k in groups)
        mean = sum(s for s, _ in groups) / n
        between = sum(k * (s / k - mean) ** 2 for s, k in groups) / n - mean * (1 - mean) * len(groups) / n
        return 1e6 if between <= 0 or len(groups) < 2 else min(1e6, max(2.0, mean * (1 - mean) / between - 1))

    for t in ("quality", "toxic"):
        prior = (sum(getattr(r, t) > 0 for r in known) + 1) / (len(known) + 2)
        paths: dict = {}
        hosts: dict = {}
        for r in got:
            soft = expit(r[f"{t}_evidence"] + logit(prior))
            for where, key in ((paths, site[r.doc_id]), (hosts, site[r.doc_id][0])):
                s, n = where.get(key, (0.0, 0))
                where[key] = (s + soft, n + 1)
        by_host, by_path = strength(list(hosts.values())), strength(list(paths.values()))
        top = (sum(s for s, _ in hosts.values()) + prior) / (len(got) + 1)
        for r in got:
            (ps, pn), (hs, hn) = paths[site[r.doc_id]], hosts[site[r.doc_id][0]]
            rate = (ps + by_path * (hs + by_host * top) / (hn + by_host)) / (pn + by_path)
            assert math.isclose(r[f"{t}_path_rate"], rate, abs_tol=2e-3) and math.isclose(r[f"p_{t}"], expit(logit(r[f"{t}_path_rate"]) + r[f"{t}_evidence"]), abs_tol=2e-3)
    good = {r.doc_id: r for r in known}
    right = [r.kept == (good[r.doc_id].quality > 0 and good[r.doc_id].toxic == 0) for r in got if r.doc_id in good]
    assert sum(right) / len(right) > 0.8


def test_sites(spark, odd, clashing, empty) -> None:
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(60)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, clashing):
        got = site_quality.classify(docs, labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert site_quality.classify(odd, labels.limit(0)).where("NOT kept").count() == 0
    assert site_quality.classify(empty, labels).count() == 0


def test_nothing(empty) -> None:
    for f in (quality_rules.judge, pii.find, mixing.mix, matroska.store, pii.redact, mixing.mixed):
        assert f(empty).count() == 0


def test_a_column_named_kept_or_with_a_dot(odd) -> None:
    docs = odd.withColumns({"kept": F.lit(3), "x.y": F.lit(1)})
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and {r.kept for r in good.collect()} <= {3}
