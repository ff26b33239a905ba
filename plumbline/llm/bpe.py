"""Byte-level BPE with a bounded memo of pieces.

A byte-level pre-tokenizer ends a pre-token at every blank: of a run of blanks before a
non-blank all but the last make one pre-token, and the last is its own, or leads the word if
it is a space.  So a text parts into words (with the space that leads them), and runs of
blanks, which are encoded one by one without changing a single id.  Pieces repeat far more
often than texts: a block of texts is parted and its distinct pieces are numbered in native
code, the memo gives the ids of each, the tokenizers library encodes those not seen yet, and
ids are gathered by arrays.  That holds for byte-level BPE with the pre-tokenizer's own
pattern and no normalizer; the file's kind is read when it is loaded, and texts of any other
tokenizer, or that hold the string of an added token, go to the library whole.

Defined results: ids are those of the library with add_special_tokens=False; the string of a
special token in a text is therefore that token (with ``ordinary_specials`` it is ordinary
text); a null or empty text has no ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice, repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 700_000
MEMO_CHARS = 24_000_000
BLOCK_CHARS = 4_000_000
LEARNT_AT_ONCE = 65_536
DEFAULT_FILE = "byte_bpe_50k.json"
ID_TYPE = np.dtype("<u4")

#: The characters with Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_PIECE = re.compile(f"[{SPACES}]+(?![^{SPACES}])| ?[^{SPACES}]+|[{SPACES}]")
#: Words (a space may lead them) of letters that all versions of Unicode know as letters.
_PLAIN = re.compile("\u0020?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f]+")
_MARKS = (".", ",")
_MARK = "\x00"  # parts pieces; texts that hold it go by the pattern


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the
    characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def pieces_of(text: str) -> list[str]:
    return _PIECE.findall(text)


def is_byte_level(tokenizer: Any) -> bool:
    """Whether a text's ids are those of its words and runs of blanks, one after the other."""
    held = json.loads(tokenizer.to_str())
    model, cut, after = held["model"], held["pre_tokenizer"] or {}, held["post_processor"] or {"type": "ByteLevel"}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return model["type"] == "BPE" and plain and cuts and held["normalizer"] is None and after["type"] == "ByteLevel" and len(tokenizer.encode("\n", add_special_tokens=False).ids) == 1


class WordEncoder:
    """Encodes texts to ids; remembers at most ``memo_pieces`` pieces."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, ordinary_specials: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = ordinary_specials
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._limit = memo_pieces
        self.vocabulary = self._tokenizer.get_vocab_size()
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = [t.content for t in added if not (ordinary_specials and t.special)]
        self._by_words = is_byte_level(self._tokenizer)
        if not self._by_words:
            return
        self._newline = self._ids("\n")
        self._marks = {m: int(self._ids(m)[0]) for m in _MARKS if len(self._ids(m)) == 1}
        self._model = Tokenizer(self._tokenizer.model)
        self._model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_ALPHABET[ord("\n")])
        tokens = self._tokenizer.get_vocab(with_added_tokens=False)
        self._bytes_of = np.zeros(max(tokens.values()) + 1, np.int64)  # by id
        self._bytes_of[list(tokens.values())] = list(map(len, tokens))
        self._known: dict[str, int] = {}  # piece -> its number
        self._chars = 0
        self._ids_held = np.empty(1 << 16, ID_TYPE)  # ids of all pieces, one after the other
        self._ends = np.zeros(1 << 16, np.int64)  # by number + 1: where its ids end
        self._odd = np.zeros(1 << 16, bool)  # by number: not a piece if cut at spaces and newlines only

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=ID_TYPE)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[str] = []
        held = 0
        if not self._by_words:
            return [self._ids(x or "").tobytes() for x in texts]
        for text in texts:
            block.append(text or "")
            held += len(block[-1])
            if held > BLOCK_CHARS:
                out += self._block(block)
                block, held = [], 0
                _give_back()()
        out += self._block(block)
        _give_back()()
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        """Cuts at spaces and newlines; texts where that gave an odd piece are cut by the pattern."""
        if not texts:
            return []
        out: list[bytes] = [b""] * len(texts)
        whole = {k for k, x in enumerate(texts) if any(a in x for a in self._added)}
        for k in whole:
            out[k] = self._ids(texts[k]).tobytes()
        simple = [k for k, x in enumerate(texts) if x and _MARK not in x and k not in whole]
        slow = [k for k, x in enumerate(texts) if x and _MARK in x and k not in whole]
        if simple:
            joined = _MARK.join([texts[k] for k in simple]).replace(" ", _MARK + " ").replace("\n", _MARK + "\n" + _MARK)
            counts = np.array([texts[k].count(" ") + 2 * texts[k].count("\n") + 1 for k in simple])
            cut = pc.split_pattern(pa.array([joined], pa.large_string()), _MARK).values
            for k, ids in zip(simple, self._gathered(cut, counts), strict=True):
                if ids is None:
                    slow.append(k)
                else:
                    out[k] = ids
        if slow:
            cut_by = [pieces_of(texts[k]) for k in slow]
            flat = pa.array([w for x in cut_by for w in x], pa.large_string())
            for k, ids in zip(slow, self._gathered(flat, np.array([len(x) for x in cut_by]), whole=True), strict=True):
                out[k] = ids
        if len(self._known) > self._limit or self._chars > MEMO_CHARS:
            self._trim()
        return out

    def _gathered(self, cut: pa.Array, counts: np.ndarray, whole: bool = False) -> list[bytes | None]:
        """Ids of texts whose pieces follow each other; None for one that holds an odd piece."""
        coded = cut.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist() if whole else _strings(coded.dictionary))
        at = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        start, size = self._ends[at], self._ends[at + 1] - self._ends[at]
        upto = np.cumsum(size)
        ids = self._ids_held[np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        edges = np.r_[0, np.cumsum(counts)]
        byte = 4 * np.r_[0, upto][edges]
        data = ids.tobytes()
        odd = np.zeros(len(counts), bool) if whole else np.diff(np.r_[0, np.cumsum(self._odd[at])][edges]) > 0
        return [None if odd[k] else data[byte[k] : byte[k + 1]] for k in range(len(counts))]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        found = np.fromiter(map(self._known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            self._learn(new)
            found[missing] = np.fromiter(map(self._known.__getitem__, new), np.int64, len(new))
        return found

    def _learn(self, new: list[str]) -> None:
        """Numbers the pieces.  Words of Latin letters are one pre-token, a full stop or comma
        after them another; those go to the library's model straight, all others whole."""
        plain, known = _PLAIN.match, self._known
        alone, marked, rest = [], [], []
        for p in new:
            found = plain(p)
            left = len(p) - found.end() if found else -1
            (alone if left == 0 else marked if left == 1 and p[-1] in self._marks else rest).append(p)
        stems = [p[:-1] for p in marked]
        simple = {*alone, *(p for p in stems if p not in known)}
        for some in ([p for p in simple if p.isascii()], [p for p in simple if not p.isascii()]):
            for own in _runs(some):
                self._add(own, *self._straight(own))
        if marked:
            at = np.fromiter(map(known.__getitem__, stems), np.int64, len(stems))
            sizes = self._ends[at + 1] - self._ends[at] + 1
            upto = np.cumsum(sizes)
            held = self._ids_held[np.repeat(self._ends[at] - upto + sizes, sizes) + np.arange(upto[-1])]
            held[upto - 1] = [self._marks[p[-1]] for p in marked]
            self._add(marked, held, sizes)
        bare = [p[1:] if p[:1] == " " else p for p in rest]
        odd = [p for p, w in zip(rest, bare, strict=True) if not w or w[0] in SPACES or w[-1] in SPACES]
        for words in _runs(list(set(rest) - set(odd))):
            self._add(words, *self._whole(words))
        for p in odd:
            ids = self._ids(p)
            self._add([p], ids, np.array([len(ids)]), odd=p != "\n")

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, odd: bool = False) -> None:
        first, n = len(self._known), len(pieces)
        self._known.update(zip(pieces, range(first, first + n), strict=True))
        self._chars += sum(map(len, pieces))
        self._ends, self._odd = _room(self._ends, first + n + 1), _room(self._odd, first + n)
        base = self._ends[first]
        self._ends[first + 1 : first + n + 1] = base + np.cumsum(sizes)
        self._odd[first : first + n] = odd
        self._ids_held = _room(self._ids_held, base + len(ids))
        self._ids_held[base : base + len(ids)] = ids

    def _straight(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces that are one pre-token each, in the byte alphabet of the model."""
        joined = "\n".join(words)
        if joined.isascii():
            shown = joined.replace(" ", _ALPHABET[32]).replace("\n", _ALPHABET[10])
        else:
            shown = joined.encode().decode("latin-1").translate(_ALPHABET)
        ids = np.array(self._model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, ID_TYPE)
        # the lines' ends are no tokens: a word ends where the tokens have as many bytes as the words up to it
        lines = np.flatnonzero(np.frombuffer(joined.encode(), np.uint8) == 10)
        ends = np.r_[lines, len(shown)] - np.arange(len(words))
        upto = np.cumsum(self._bytes_of[ids])
        at = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[at] == ends).all():
            return ids, np.diff(np.r_[-1, at])
        return self._each(words)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces without blanks but for one that leads, as one text of lines."""
        return self._between(words, self._ids("\n".join(words)))

    def _between(self, words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(ids == self._newline[0])
        if words and len(ends) == len(words) - 1:
            return np.delete(ids, ends), np.diff(np.r_[-1, ends, len(ids)]) - 1
        return self._each(words)  # a word holds that id

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self._ids(w) for w in words]
        return np.concatenate([np.empty(0, ID_TYPE), *each]), np.array([len(x) for x in each], np.int64)

    def _trim(self) -> None:
        # a dict keeps its order: the oldest pieces are the most frequent, those stay
        kept = list(islice(self._known, min(self._limit, len(self._known)) // 2))
        while kept and sum(map(len, kept)) > MEMO_CHARS // 2:
            kept = kept[: len(kept) // 2]
        self._known = dict(zip(kept, range(len(kept)), strict=True))
        self._chars = sum(map(len, kept))


def _strings(pieces: pa.Array) -> list[str]:
    """The pieces, none of which holds _MARK; one string that is cut costs less than one for each."""
    if not len(pieces):
        return []
    rows = pa.LargeListArray.from_arrays(pa.array([0, len(pieces)], pa.int64()), pieces)
    return pc.binary_join(rows, pa.scalar(_MARK, pieces.type))[0].as_py().split(_MARK)


def _runs(words: list[str]) -> Iterator[list[str]]:
    """A run at a time: the library keeps some hundred bytes of each id while it encodes."""
    return (words[at : at + LEARNT_AT_ONCE] for at in range(0, len(words), LEARNT_AT_ONCE))


@lru_cache(maxsize=1)
def _give_back() -> Callable[[], object]:
    """Gives freed memory back to the system, where the C library can: blocks come and go, and what
    they leave would add to every worker."""
    import ctypes

    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda: None
    return lambda: trim(0)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that tasks share its memo."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
