"""A hidden Markov language model over words.

States emit symbols: each of the SYMBOL_WORDS most frequent training words is its own
symbol, the end another; other words share CLASSES symbols by their last letters, and a word
within its class is drawn by its smoothed count.  So parameters are bounded whatever the
vocabulary, while counts cover all of it.  Baum-Welch counts are summed across partitions,
symbol by symbol, each round; the scaled forward recursion gives the exact likelihood of
every whole text.

Counts of the HEAD_WORDS most frequent words go to all tasks (a fixed number of entries);
those of all other words are joined.  Training runs over whole texts: a long one is worked on in
segments of SEGMENT tokens that share a token with the next, and the exact forward and backward
vectors at their ends come from the segments' transfer matrices, so every transition counts and
a start is a text's first token only.

Defined results: a null text counts as empty, whose only token is the end; a null doc_id
counts as training; repeated rows are counted and scored each; without training documents
both scores use the smoothing alone; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import finished, mark, written

HEAD_WORDS = 100_000
SYMBOL_WORDS = 8_192
CLASSES = 2_048
STATES = 6
ROUNDS = 5
SEGMENT = 1_024
CHUNK_TOKENS = 400_000
SCORE_TOKENS = 3_000_000
FLUSH_WORDS = 1_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A to Z in lower case; the end is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


@dataclass
class Vocabulary:
    """Totals, and the counts and symbols of the most frequent words."""

    total: int  # N: all training tokens, ends included
    distinct: int  # V: distinct training tokens, the end included
    ends: int
    head: dict[bytes, int]  # word -> its rank
    counts: np.ndarray  # by rank
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def symbols(self) -> int:
        return SYMBOL_WORDS + 1 + CLASSES

    def class_log(self) -> np.ndarray:
        """log10 of the denominators of words within their class."""
        return np.log10(self.class_total + 0.5 * (self.class_distinct + 1))

    def symbol_counts(self) -> np.ndarray:
        out = np.zeros(self.symbols)
        own = self.counts[:SYMBOL_WORDS]
        out[: len(own)] = own
        out[SYMBOL_WORDS] = self.ends
        out[SYMBOL_WORDS + 1 :] = self.class_total
        return out


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states: log-free probabilities


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def vocabulary(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """All training words with counts, as a written table, and its bounded summary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([found[w] for w in words], pa.int64()), pa.array(map(word_class, words), pa.int32())], ["word", "c", "class"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                block = batch.slice(at, 200)
                for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    if not is_held_out(doc_id):
                        found.update(tokens(text))
                        ends += 1
                if len(found) > FLUSH_WORDS:
                    yield flush()
                    found.clear()
        yield flush()
        # the end has no word: null
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64()), pa.array([-1], pa.int32())], ["word", "c", "class"])

    partial = _slim(docs).mapInArrow(count, "word binary, c long, class int")
    table = written(partial.groupBy("word", "class").agg(F.sum("c").alias("c")).where("c > 0"), "vocabulary")
    words = table.where("word IS NOT NULL")
    top = most_frequent(words, HEAD_WORDS).toPandas()  # at most HEAD_WORDS rows of a stored table
    ranked = [bytes(w) for w in top["word"]]
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    total = distinct = ends = 0
    for r in table.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows and the end
        total, distinct = total + r["c"], distinct + r["n"]
        if r["class"] < 0:
            ends = r["c"]
        else:
            class_total[r["class"]], class_distinct[r["class"]] = r["c"], r["n"]
    for w, c in zip(ranked[:SYMBOL_WORDS], top["c"], strict=False):
        class_total[word_class(w)] -= c
        class_distinct[word_class(w)] -= 1
    return words, Vocabulary(total, distinct, ends, {w: k for k, w in enumerate(ranked)}, top["c"].to_numpy(np.int64), class_total, class_distinct)


def most_frequent(words: DataFrame, k: int) -> DataFrame:
    """The ``k`` words of the largest counts (ties by word), as a written table.  Words below the
    level of counts that the first ``k`` reach are left out before any are ordered."""
    level = F.floor(F.log2("c") * 8).cast("int")
    seen = words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # at most 8 * 63 rows
    least, upto = 0, 0
    for r in seen:
        least, upto = r["level"], upto + r["n"]
        if upto >= k:
            break
    return written(words.where(level >= least).orderBy(F.desc("c"), "word").limit(k).select("word", "c"), "head-words")


_SEQUENCE = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols array<int>, tail array<struct<word:binary,n:int>>"


def sequences(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """One row per text: its symbols; the sums over words whose counts are known here; and the
    other words with their number.  ``base`` sums log10(c + 0.5); ``inner`` the same less the
    class's denominator over words that are not their own symbol."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        head, class_log = v.head, v.class_log()
        logs = np.log10(v.counts + 0.5)
        end_log, end_known = math.log10(v.ends + 0.5), int(v.ends > 0)
        rank_class = np.array([word_class(w) for w in head], np.int64)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                block = batch.slice(at, 1000)
                ids = block.column(0).to_pylist()
                split = [tokens(x) for x in block.column(1).to_pylist()]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                coded = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                # by distinct word of the block: rank, class (-1: a symbol of its own), and what it adds
                rank = np.fromiter((head.get(w, -1) for w in distinct), np.int64, len(distinct))
                of_class = np.where(rank >= SYMBOL_WORDS, rank_class[rank] if len(rank_class) else 0, -1)
                rare = np.flatnonzero(rank < 0)
                of_class[rare] = [word_class(distinct[k]) for k in rare.tolist()]
                symbol = np.where(of_class >= 0, SYMBOL_WORDS + 1 + of_class, rank).astype(np.int32)
                own = np.where(rank >= 0, logs[rank] if len(logs) else 0.0, 0.0)
                inner = np.where(rank >= SYMBOL_WORDS, own, 0.0) - np.where(of_class >= 0, class_log[of_class], 0.0)
                where = coded.indices.to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(split)), sizes)
                per_text = lambda x: np.bincount(text, x[where], minlength=len(split))  # noqa: B023, E731
                ends = np.cumsum(sizes + 1)
                symbols = np.full(int(ends[-1]), SYMBOL_WORDS, np.int32)
                symbols[np.arange(len(where)) + text] = symbol[where]
                # rare words with their number in each text
                picked = np.flatnonzero(rank[where] < 0)
                pair, n = np.unique(text[picked] * max(1, len(distinct)) + where[picked], return_counts=True)
                tail = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % max(1, len(distinct)))), pa.array(n.astype(np.int32))], ["word", "n"])
                tail_edges = np.r_[0, np.cumsum(np.bincount(pair // max(1, len(distinct)), minlength=len(split)))].astype(np.int32)
                arrays = [
                    pa.array(np.arange(rid, rid + len(split))),
                    block.column(0),
                    pa.array([is_held_out(x) for x in ids], pa.bool_()),
                    pa.array(sizes + 1),
                    pa.array(per_text((rank >= 0).astype(float)).astype(np.int64) + end_known),
                    pa.array(per_text(own) + end_log),
                    pa.array(per_text(inner)),
                    pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), symbols),
                    pa.ListArray.from_arrays(tail_edges, tail),
                ]
                rid += len(split)
                yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols", "tail"])

    return _slim(docs).mapInArrow(rows, _SEQUENCE)


def first_model(v: Vocabulary, states: int = STATES) -> Model:
    """Symbol frequencies, disturbed by fixed noise so that the states differ; states last."""
    rng = np.random.Generator(np.random.PCG64(7))
    counts = v.symbol_counts() + 0.5
    emit = counts[:, None] * np.exp(rng.normal(0, 0.7, (len(counts), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_step(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length, laid out step by step: their order, the symbols, and where
    each step starts; the sequences that are long enough fill a step from its start."""
    order = np.argsort([-len(p) for p in parts], kind="stable")
    sizes = np.array([len(parts[k]) for k in order])
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    edges = np.r_[0, np.cumsum(active)]
    flat = np.concatenate([parts[k] for k in order])
    step = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    laid = np.empty(len(flat), flat.dtype)
    laid[edges[step] + np.repeat(np.arange(len(sizes)), sizes)] = flat
    return order, laid, edges


def transfers(parts: list[np.ndarray], m: Model) -> np.ndarray:
    """By part the matrix (state of the last token, state of the first) of the chances to pass
    through all its tokens but the first, up to a factor."""
    order, laid, edges = _by_step(parts)
    k = len(m.start)
    emit, forth = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    held = np.repeat(np.eye(k)[:, :, None], len(parts), axis=2)
    for t in range(1, len(edges) - 1):
        lo, hi = edges[t], edges[t + 1]
        n = hi - lo
        now = (forth @ held[:, :, :n].reshape(k, -1)).reshape(k, k, n)
        now *= emit.take(laid[lo:hi], axis=1)[:, None]
        if t % 16 == 0:
            now /= now.max(axis=(0, 1))
        held[:, :, :n] = now
    out = np.empty((len(parts), k, k))
    out[order] = held.transpose(2, 0, 1) / held.max(axis=(0, 1))[:, None, None]
    return out


@dataclass
class Piece:
    """Tokens of a text; ``entry`` is the forward vector at the first of them (None: the text
    starts there), ``leave`` the backward vector at the last, up to a factor (None: it ends there)."""

    tokens: np.ndarray
    entry: np.ndarray | None = None
    leave: np.ndarray | None = None


def _blocks(sizes: list[int]) -> Iterator[slice]:
    """Runs of about CHUNK_TOKENS tokens."""
    first = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held > CHUNK_TOKENS or k == len(sizes) - 1:
            yield slice(first, k + 1)
            first, held = k + 1, 0


def pieces_of(parts: list[np.ndarray], m: Model, segment: int = SEGMENT) -> list[Piece]:
    """The texts, long ones cut so that a piece's last token is the next one's first."""
    out = [Piece(p) for p in parts if len(p) <= segment + 1]
    cut = [[p[a : a + segment + 1] for a in range(0, len(p) - 1, segment)] for p in parts if len(p) > segment + 1]
    flat = [x for own in cut for x in own]
    through = np.concatenate([transfers(flat[run], m) for run in _blocks([len(x) for x in flat])]) if flat else np.empty(0)
    at = 0
    for own in cut:
        matrices = through[at : at + len(own)]
        at += len(own)
        a = m.start * m.emit[own[0][0]]
        entries = [None]
        for t in matrices[:-1]:
            a = t @ a
            a /= a.sum()
            entries.append(a)
        b = np.ones(len(a))
        leaves = [None]
        for t in matrices[:0:-1]:
            b = b @ t
            b /= b.max()
            leaves.append(b)
        out += [Piece(x, e, z) for x, e, z in zip(own, entries, reversed(leaves), strict=True)]
    return out


def expected(parts: list[np.ndarray], m: Model, emit_counts: np.ndarray, move_counts: np.ndarray, start_counts: np.ndarray, segment: int = SEGMENT) -> float:
    """Adds the forward-backward counts of whole texts; gives their log10 likelihood."""
    pieces = pieces_of(parts, m, segment)
    return sum(_expected(pieces[run], m, emit_counts, move_counts, start_counts) for run in _blocks([len(p.tokens) for p in pieces]))


def _expected(pieces: list[Piece], m: Model, emit_counts: np.ndarray, move_counts: np.ndarray, start_counts: np.ndarray) -> float:
    """One block's counts.  States come first in all arrays, so that sums over them run along
    whole steps."""
    order, laid, edges = _by_step([p.tokens for p in pieces])
    pieces = [pieces[k] for k in order]
    going_on = np.array([p.entry is not None for p in pieces])
    states = len(m.start)
    e = np.ascontiguousarray(m.emit.T).take(laid, axis=1)
    alpha = np.empty((states, len(laid)))
    scale = np.empty(len(laid))
    forth, back = np.ascontiguousarray(m.move.T), m.move
    steps = len(edges) - 1
    a = m.start[:, None] * e[:, : edges[1]]
    for k in np.flatnonzero(going_on):
        a[:, k] = pieces[k].entry
    for t in range(steps):
        lo, hi = edges[t], edges[t + 1]
        if t:
            a = forth @ a[:, : hi - lo]
            a *= e[:, lo:hi]
        s = a.sum(axis=0)
        a /= s
        alpha[:, lo:hi], scale[lo:hi] = a, s
    scale[: edges[1]][going_on] = 1.0
    e /= scale
    moved = np.zeros((states, states))
    ones = np.ones(states)
    beta = np.array([ones if p.leave is None else p.leave for p in pieces]).T
    beta = beta / (alpha[:, edges[np.array([len(p.tokens) for p in pieces]) - 1] + np.arange(len(pieces))] * beta).sum(axis=0)
    for t in range(steps - 1, 0, -1):
        lo, hi = edges[t], edges[t + 1]
        n, before = hi - lo, edges[t - 1]
        w = e[:, lo:hi] * beta[:, :n]
        moved += alpha[:, before : before + n] @ w.T
        alpha[:, lo:hi] *= beta[:, :n]  # now the state's chance given the whole text
        beta[:, :n] = back @ w
    alpha[:, : edges[1]] *= beta
    alpha[:, : edges[1]][:, going_on] = 0.0  # that token is counted in the piece before
    move_counts += m.move * moved
    for k in range(states):
        emit_counts[:, k] += np.bincount(laid, alpha[k], minlength=len(emit_counts))
    start_counts += alpha[:, : edges[1]].sum(axis=1)
    return float(np.log10(scale).sum())


def log_likelihoods(parts: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    order, laid, edges = _by_step(parts)
    emit, forth = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    total = np.zeros(len(parts))
    a = m.start[:, None]
    for t in range(len(edges) - 1):
        lo, hi = edges[t], edges[t + 1]
        e = emit.take(laid[lo:hi], axis=1)
        a = forth @ a[:, : hi - lo] * e if t else a * e
        s = a.sum(axis=0)
        a /= s
        total[: hi - lo] += np.log10(s)
    out = np.empty(len(parts))
    out[order] = total
    return out


def train(seqs: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: each round every partition adds up its expected counts by symbol; the sums,
    of fixed size, make the next model."""
    model = first_model(v, states)
    spark = seqs.sparkSession
    training = seqs.where("NOT held_out").select("symbols")
    names = [f"s{k}" for k in range(states)]
    schema = "part int, symbol int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            m = shared.value
            k = len(m.start)
            emit, move, start = np.zeros(m.emit.shape), np.zeros((k, k)), np.zeros(k)
            held: list[np.ndarray] = []
            n = 0
            for batch in batches:
                for row in batch.column(0):
                    held.append(row.values.to_numpy())
                    n += len(held[-1])
                    if n > CHUNK_TOKENS:
                        expected(held, m, emit, move, start)
                        held, n = [], 0
            if held:
                expected(held, m, emit, move, start)
            seen = np.flatnonzero(emit.any(axis=1))
            rows = np.concatenate([emit[seen], move, start[None]])
            part = np.r_[np.zeros(len(seen)), np.ones(k), [2]].astype(np.int32)
            symbol = np.r_[seen, np.arange(k), [0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(symbol), *[pa.array(rows[:, j]) for j in range(k)]], ["part", "symbol", *names])

        sums = training.mapInArrow(count, schema).groupBy("part", "symbol").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        emit = np.full((v.symbols, states), 0.0)
        own = sums[sums["part"] == 0]
        emit[own["symbol"].to_numpy()] = own[names].to_numpy()
        # every symbol keeps half a count in every state, spread by its frequency
        prior = v.symbol_counts() + 0.5
        emit += 0.5 * v.symbols * (prior / prior.sum())[:, None] * 0.05 + 1e-3
        move, start = np.full((states, states), 0.5), np.full(states, 0.5)
        own = sums[sums["part"] == 1]
        move[own["symbol"].to_numpy()] += own[names].to_numpy()
        own = sums[sums["part"] == 2]
        start += own[names].to_numpy().sum(axis=0)
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row."""
    spark = docs.sparkSession
    since = mark(spark)
    words, v = vocabulary(docs)
    seqs = written(sequences(docs, v), "sequences")
    model = train(seqs, v) if v.total else first_model(v)
    shared = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rids: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(log_likelihoods(held, m))], ["rid", "hmm"])

        for batch in batches:
            for rid, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rids.append(rid)
                held.append(row.values.to_numpy())
                n += len(held[-1])
                if n > SCORE_TOKENS:
                    yield flush()
                    rids, held, n = [], [], 0
        if held:
            yield flush()

    rest = seqs.select("rid", F.explode("tail").alias("x")).select("rid", "x.word", "x.n")
    found = rest.join(words.select("word", "c"), "word", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    tails = found.groupBy("rid").agg(F.sum(F.col("n") * log_c).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    likely = seqs.select("rid", "symbols").mapInArrow(forward, "rid long, hmm double")
    all_ = seqs.drop("symbols", "tail").join(likely, "rid").join(tails, "rid", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    per_token = math.log10(v.total + 0.5 * (v.distinct + 1))
    scores = all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        F.round(F.col("base") + tail - F.col("n_tokens") * per_token, 6).alias("base_score"),
        F.round(F.col("hmm") + F.col("inner") + tail, 6).alias("score"),
    )
    return finished(scores, "scores", since)
