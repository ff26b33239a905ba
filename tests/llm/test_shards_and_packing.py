"""Token shards (2) and packing (7) against the tokenizer itself, by exact round trip."""

from __future__ import annotations

import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import bpe, packing, sstable
from plumbline.llm.common import written
from tokenizers import Tokenizer

from .conftest import odd_rows, random_texts


@pytest.fixture(scope="module")
def ids_of():
    tok = Tokenizer.from_file(bpe.default_path())

    def ids(text: str | None) -> list[int]:
        return [*tok.encode(text or "", add_special_tokens=False).ids, 0]

    return ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memo_gives_the_tokenizers_ids(ids_of) -> None:
    encoder = bpe.WordEncoder(bpe.default_path(), memo_pieces=40)  # so small that it is trimmed all the time
    texts = [*random_texts(300, 3), "a\nb", "don't.", "x,", ".", ",", "a.\nb, c", "<|endoftext|> a", "  a", "1,000 2.5", "Ab.cd, ef"]
    for _ in range(2):
        got = encoder.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t)[:-1] for t in texts]


def test_new_words_are_looked_at_once(ids_of, monkeypatch) -> None:
    """Each word that the memo lacks is matched once, line ends are no tokens of the model's, and the
    ids are parted at the words all the same."""
    plain, calls = bpe._PLAIN, Counter()

    class Counted:
        def __getattr__(self, name: str):
            return lambda p, *a: calls.update([p]) or getattr(plain, name)(p, *a)

    monkeypatch.setattr(bpe, "_PLAIN", Counted())
    texts = ["Fußball naïve ÿ Ж жar, a a. b, . ,, aб. été\nthe river.\nstone x1 a.b " + "z" * 3000, "données, été. the,\n\na", "один\x00два three"]
    encoder = bpe.WordEncoder(bpe.default_path())
    got = [np.frombuffer(x, bpe.ID_TYPE).tolist() for x in encoder.encode(texts)]
    assert got == [ids_of(x)[:-1] for x in texts]
    assert set(calls.values()) == {1}
    a, b = "a", bpe._ALPHABET[32] + "b"
    assert [x for x, _ in encoder._model.pre_tokenizer.pre_tokenize_str(a + bpe._ALPHABET[10] + b)] == [a, b]


def test_special_tokens_and_other_kinds_of_file() -> None:
    import public_tokenizers

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\x00y", "<|endof text|>", "", "plain words here"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for ordinary in (False, True):
            tok = Tokenizer.from_file(public_tokenizers.path(name))
            tok.encode_special_tokens = ordinary
            got = bpe.WordEncoder(public_tokenizers.path(name), ordinary_specials=ordinary).encode(texts)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.is_byte_level(Tokenizer.from_file(bpe.default_path())) and not bpe.is_byte_level(tok)


def test_distributed_lookup(spark, odd, ids_of) -> None:
    shards = written(sstable.write(odd, sstable.shard_path(odd), bpe.default_path(), shard_bytes=1), "shards")
    assert shards.count() > 2
    asked = [1, 5, 7, 7, None, 100, 131, -3, 9999, -10**15, 2**62]
    got = Counter(map(tuple, sstable.lookup(shards, spark.createDataFrame([(x,) for x in asked], "doc_id long")).collect()))
    want = Counter((r[0], len(ids_of(r[1])), crc(ids_of(r[1]))) for r in odd_rows() if r[0] in asked)
    assert got == want
    assert sstable.lookup(shards, odd.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab.,'!1 \n\té\U0001f600A"), max_size=40), max_size=6))
def test_memo_on_any_text(texts: list[str]) -> None:
    tok = Tokenizer.from_file(bpe.default_path())
    got = bpe.encoder(bpe.default_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


class Held:
    def __init__(self, data: bytes) -> None:
        self._io, self._n = io.BytesIO(data), len(data)
        self.seek, self.read = self._io.seek, self._io.read

    def size(self) -> int:
        return self._n


def test_shard_lookup() -> None:
    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    values = {k * 3: bytes([k % 256, 0]) * (k % 700) for k in range(3000)}
    for k, v in values.items():
        w.add(sstable.key_of(k), v)
    w.add(sstable.key_of(9000, 0), b"ab")
    w.add(sstable.key_of(9000, 1), b"cd")
    with pytest.raises(ValueError):
        w.add(sstable.key_of(5), b"")
    w.finish()
    r = sstable.Reader(Held(out.getvalue()))
    assert len(r.places) > 5
    for k in range(-3, 9100):
        want = [values[k]] if k in values else [b"ab", b"cd"] if k == 9000 else []
        assert r.get(k) == want
    wrong = sum(r.may_hold(k) for k in range(100_000, 110_000))
    assert wrong < 250  # ten bits a key: about one in a hundred
    assert [k for k, _ in r] == sorted(k for k, _ in r)
    data = bytearray(out.getvalue())
    data[40] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(Held(bytes(data))))


@pytest.mark.parametrize("shard_bytes", [1, 4_000, 1 << 28])
def test_shards_round_trip(spark, odd, ids_of, shard_bytes) -> None:
    shards = written(sstable.write(odd, sstable.shard_path(odd), bpe.default_path(), shard_bytes=shard_bytes), "t")
    got = [tuple(r) for r in sstable.read(shards).collect()]
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for r in rows:
        ids = ids_of(r[1])
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_shards_of_nothing(spark, empty) -> None:
    shards = written(sstable.write(empty, sstable.shard_path(empty), bpe.default_path()), "t")
    assert shards.count() == 0 and sstable.read(shards).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_is_best_fit_decreasing(counts: dict[int, int]) -> None:
    """Against best-fit decreasing done piece by piece: the same number of windows and fill."""
    held = packing.plan(counts, 64)
    left: list[int] = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [k for k, x in enumerate(left) if x >= n]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= n
            else:
                left.append(64 - n)
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    rank = np.concatenate([np.arange(c) for c in counts.values()] or [np.empty(0)]).astype(np.int64)
    sequence, offset = held.place(length, rank)
    fill: dict[int, list] = defaultdict(list)
    for s, o, n in zip(sequence, offset, length, strict=True):
        fill[s].append((o, n))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(fill) == held.sequences == len(left)
    assert sorted(64 - sum(n for _, n in p) for p in fill.values()) == sorted(left)


def test_capacity_tree() -> None:
    tree = packing.CapacityTree(10)
    assert tree.tightest(0) is None
    for k in (3, 7, 10):
        tree.mark(k, True)
    assert [tree.tightest(k) for k in range(11)] == [3, 3, 3, 3, 7, 7, 7, 7, 10, 10, 10]
    tree.mark(10, False)
    assert tree.tightest(8) is None


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_packs_every_id_once(request, ids_of, table) -> None:
    got = packing.pack(request.getfixturevalue(table), bpe.default_path()).collect()
    windows: dict[int, list] = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert sorted(windows) == list(range(len(windows)))
    total = sum(r.length for r in got)
    assert len(windows) <= -(-total // 1024) + 1
    want = Counter()
    for r in odd_rows():
        ids = ids_of(r[1])
        for a in range(0, len(ids), 1024):
            want[(r[0], a, min(1024, len(ids) - a), crc(ids[a : a + 1024]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_packing_nothing(empty) -> None:
    assert packing.pack(empty, bpe.default_path()).count() == 0


def test_packed_ids_are_carried(odd, ids_of) -> None:
    for r in packing.pack(odd, bpe.default_path(), keep_ids=True).collect():
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32
