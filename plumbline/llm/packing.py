"""Packing token sequences into windows by best-fit decreasing.

Overlong documents are first cut into full windows.  Pieces of one length are
interchangeable, so best-fit decreasing needs only their number: the driver takes the
counts by length (at most ``window`` rows, whatever the input's size), places whole runs
of equal pieces into the tightest open windows, found by a segment tree over the remaining
capacity, and gets a plan of ranges.  Every piece then looks up its window by its rank
among the pieces of its length; ranks are counted within each input partition and offset
by the counts of the partitions before it.  No group of pieces ever meets in one task.

Defined results: a null text counts as empty; an empty document is its end id alone;
repeated rows are packed each; a null doc_id stays null; an empty table gives an empty one;
other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import written

WINDOW = 1024
END_ID = 0


class CapacityTree:
    """A segment tree over capacities 0..size: whether any window with it is open."""

    def __init__(self, size: int) -> None:
        self._leaves = 1 << size.bit_length()
        self._open = bytearray(2 * self._leaves)

    def mark(self, capacity: int, is_open: bool) -> None:
        k = self._leaves + capacity
        self._open[k] = is_open
        while k > 1:
            k >>= 1
            self._open[k] = self._open[2 * k] | self._open[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        k = self._leaves + least
        if self._open[k]:
            return least
        while k > 1:
            if not k & 1 and self._open[k + 1]:
                k += 1
                while k < self._leaves:
                    k = 2 * k if self._open[2 * k] else 2 * k + 1
                return k - self._leaves
            k >>= 1
        return None


@dataclass
class Plan:
    """Ranges of ranks by length: ranks [rank, rank + n) go to windows sequence, sequence + 1,
    ..., ``each`` to a window, the first at ``offset``."""

    window: int
    sequences: int
    rows: np.ndarray  # length, rank, sequence, each, offset; sorted by length and rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(length, kind="stable")
        sequence = np.empty(len(length), np.int64)
        offset = np.empty(len(length), np.int64)
        planned = self.rows
        if not len(order):
            return sequence, offset
        firsts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
        for a, b in zip(firsts, [*firsts[1:], len(order)], strict=True):
            at = order[a:b]
            n = length[at[0]]
            own = planned[np.searchsorted(planned[:, 0], n) : np.searchsorted(planned[:, 0], n, "right")]
            hit = own[np.searchsorted(own[:, 1], rank[at], "right") - 1]
            k = rank[at] - hit[:, 1]
            sequence[at] = hit[:, 2] + k // hit[:, 3]
            offset[at] = hit[:, 4] + k % hit[:, 3] * n
        return sequence, offset


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Best-fit decreasing over counts by length.  Each length adds at most four groups of
    windows, so the plan's size is bounded by the window's, not by the input's."""
    tree = CapacityTree(window)
    groups: dict[int, list[tuple[int, int]]] = {}  # capacity left -> (first sequence, number)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            groups.setdefault(capacity, []).append((first, number))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} does not fit a window of {window}")
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, sequences
                number = -(-left // (window // length))
                sequences += number
            else:
                first, number = groups[capacity].pop()
                if not groups[capacity]:
                    tree.mark(capacity, False)
            each = capacity // length
            whole = min(number, left // each)
            if whole:
                rows.append((length, rank, first, each, window - capacity))
                rank, left = rank + whole * each, left - whole * each
                put(capacity - each * length, first, whole)
            if whole < number and left:
                # fewer than ``each`` are left: one more window takes them all
                rows.append((length, rank, first + whole, left, window - capacity))
                put(capacity - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            put(capacity, first + whole, number - whole)
    out = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(window, sequences, out)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``window`` ids, with its rank among those of its length
    in the same partition; ``ids`` too if asked for."""
    schema = _PIECE + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        end = np.array([end_id], bpe.ID_TYPE).tobytes()
        encode = bpe.encoder(tokenizer).encode
        step = 4 * window
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                block = batch.slice(at, 5000)
                names = block.schema.names
                rows: list[tuple] = []
                for doc_id, ids in zip(block.column(names.index("doc_id")).to_pylist(), encode(block.column(names.index("text")).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for a in range(0, len(ids), step):
                        own = ids[a : a + step]
                        n = len(own) // 4
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc_id, a // 4, n, bpe.crc(own), total, part, rank, own))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(x, pa.int32() if k == 5 else pa.int64()) for k, x in enumerate(columns[:7])]
                fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
                if keep_ids:
                    edges = np.r_[0, np.cumsum([len(x) // 4 for x in columns[7]])].astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(edges, np.frombuffer(b"".join(columns[7]), np.int32)))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids:
    one row per piece.  Sequences are meant to be padded to ``window``."""
    cut = written(pieces(docs, tokenizer, window, end_id, keep_ids), "pieces")
    by_part = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    held = plan(counts, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sequence, offset = held.place(t["length"].to_numpy(), t["rank"].to_numpy())
            t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from t.select(out).combine_chunks().to_batches()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return ranked.mapInArrow(place, kinds)
