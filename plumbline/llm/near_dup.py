"""Near-duplicates by MinHash with tensored banding.

Two small collections of sketches are kept per document, each sketch made of ROWS minhashes.
A table key combines one sketch of either collection, so 2 * SKETCHES sketches give
SKETCHES ** 2 tables: with p the chance that one sketch agrees, a pair is a candidate with
chance (1 - (1 - p) ** SKETCHES) ** 2, 0.9998 at a similarity of 0.8 and more above.

1.  Documents with equal shingle sets form a class; its smallest id stands for it.
2.  A key can only be shared if both its sketches are, so sketches that one class alone has
    are dropped before any key is formed.
3.  A class is compared with two pivots of its buckets, not with all that share one, and exact
    links join classes into components.  Where a bucket then holds several components, its
    classes are compared with two pivots of it that lie in other components.  Only where a bucket then still holds several
    components are its other pairs looked at: those of different components that share one of
    their rarest shingles and whose sketch bits do not rule a link out (six standard
    deviations).
4.  Every link is confirmed on the full shingle sets, read from the texts again.

Keys that many documents share are counted with a combine before the shuffle and joined to
written tables, which adaptive execution splits; no group is ever collected.

Defined results: null, empty and blank texts have an empty set, link with nothing and are
kept; rows with a null doc_id have a null component and are kept; rows that repeat a doc_id
are one document, which has the links of all its texts; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import finished, mark, written
from plumbline.llm.components import components

ROWS = 4
SKETCHES = 18
BIT_WORDS = 3
PARITY = 1024
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text; fewer words than
    ``width`` make one shingle of them all."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = min(width, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(mixed)


class Sketcher:
    """Minhash sketches of one shingle set and one bit of each minhash."""

    def __init__(self, sketches: int = SKETCHES, rows: int = ROWS) -> None:
        rng = np.random.Generator(np.random.PCG64(20_240_229))
        self.n, self.rows = 2 * sketches, rows
        total = self.n * rows
        self._xor = rng.integers(0, 1 << 64, total, np.uint64)
        self._odd = rng.integers(0, 1 << 64, total, np.uint64) | np.uint64(1)
        self._fold = rng.integers(0, 1 << 64, rows, np.uint64) | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, list[int]]:
        low = np.full(len(self._xor), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(shingles), 512):
            block = shingles[a : a + 512, None] ^ self._xor
            block *= self._odd
            np.minimum(low, block.min(axis=0), out=low)
        mixed = _mix(low)
        sketches = _mix((mixed.reshape(self.n, self.rows) * self._fold).sum(axis=1, dtype=np.uint64))
        bits = np.packbits((mixed & np.uint64(1)).astype(np.uint8))
        padded = np.zeros(8 * BIT_WORDS, np.uint8)
        padded[: len(bits)] = bits
        return sketches, padded.view(np.int64).tolist()


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (of the whole set), bits, sketches."""
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bits array<long>, sketches array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sketch = Sketcher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                block = batch.slice(at, 1000)
                sizes, prints, bits, values = [], [], [], []
                for text in block.column(1).to_pylist():
                    s = shingle_set(text, width)
                    sizes.append(len(s))
                    if len(s):
                        found, b = sketch(s)
                        prints.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())
                        bits.append(b)
                        values.append(found.view(np.int64))
                    else:
                        prints.append((None, None))
                        bits.append([])
                        values.append(np.empty(0, np.int64))
                edges = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
                arrays = [
                    block.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array(bits, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(edges, np.concatenate(values)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "fp1", "fp2", "bits", "sketches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether the bits of two sketches leave a similarity of ``percent`` possible."""
    n = 2 * SKETCHES * ROWS
    p = (1 - percent / 100) / 2
    most = int(n * p + 6 * (n * p * (1 - p)) ** 0.5) + 1
    differ = sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, BIT_WORDS)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))
    return differ <= most


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.empty(0, np.uint64)
        for batch in batches:
            kept_a, kept_b = [], []
            for k in range(batch.num_rows):
                a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if a != pivot:
                    pivot, own = a, shingle_set(batch.column(2)[k].as_py(), width)
                other = shingle_set(batch.column(3)[k].as_py(), width)
                low, high = sorted((len(own), len(other)))
                if 100 * low < percent * high:
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and 100 * both >= percent * (low + high - both):
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long")


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """PARITY bits of a set: whether an odd number of its shingles fall to each.  Two sets differ in as
    many shingles as their bits differ in places, at least."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, label, outside, the parity bits and the full shingle set, from the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                block = batch.slice(at, 500)
                sets = [shingle_set(x, width) for x in block.column(3).to_pylist()]
                edges = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                places = np.arange(len(sets) + 1, dtype=np.int32) * (PARITY // 64)
                parity = pa.ListArray.from_arrays(places, np.concatenate([parity_bits(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([*block.columns[:3], parity, pa.ListArray.from_arrays(edges, np.concatenate(sets).view(np.int64))], ["doc_id", "label", "outside", "parity", "shingles"])

    return docs.select("doc_id", "label", "outside", "text").mapInArrow(rows, "doc_id long, label long, outside boolean, parity array<long>, shingles array<long>")


def _prefix_pairs(inside: DataFrame, texts: DataFrame, bits: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of different components that may still link, at least one of
    them outside its bucket's largest component.

    Two sets can only be that similar if they share a shingle among the n - ceil(n * percent
    / 100) + 1 rarest of either.  Shingles that one document alone has fill places of that
    prefix without ever matching, so most documents of a loose group drop out here; so do
    pairs whose first shared shingle comes too late in either order, and those whose parity bits
    differ in more places than a link leaves shingles apart."""
    sets = written(_sets(inside.join(texts, "doc_id"), width), "open-sets")
    n = F.size("shingles")
    each = sets.select("doc_id", F.explode("shingles").alias("s"))
    often = written(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "open-frequencies")
    ranked = each.join(often, "s").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("r"))  # at most the document's own set
    left = (n - F.ceil(n * percent / 100.0 - 1e-9).cast("int") + 1) - (n - F.size("r"))
    prefixes = sets.join(ranked, "doc_id").withColumn("left", left).where("left > 0")
    # places count the shingles that the document has alone: those are the rarest
    prefixes = prefixes.select("doc_id", "label", "outside", "parity", n.alias("n"), (n - F.size("r")).alias("alone"), F.posexplode(F.slice("r.s", 1, F.col("left"))).alias("k", "s"))
    prefixes = prefixes.select("doc_id", "label", "outside", "parity", "n", (F.col("alone") + F.col("k") + 1).alias("at"), "s")
    prefixes = written(prefixes.join(bits, "doc_id"), "prefixes")
    x, y = prefixes.where("outside").alias("x"), prefixes.alias("y")
    fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & _may_link(F.col("x.bits"), F.col("y.bits"), percent)
    # the first shingle that both have leaves too little after it for the overlap needed
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * (percent / (100.0 + percent)) - 1e-9)
    fits = fits & (1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= overlap)
    # the sets differ in one shingle at least for each parity bit that differs
    differ = sum((F.bit_count(F.get(F.col("x.parity"), k).bitwiseXOR(F.get(F.col("y.parity"), k))) for k in range(1, PARITY // 64)), F.bit_count(F.get(F.col("x.parity"), 0).bitwiseXOR(F.get(F.col("y.parity"), 0))))
    fits = fits & (F.col("x.n") + F.col("y.n") - differ >= 2 * overlap)
    once = ~F.col("y.outside") | (F.col("x.doc_id") < F.col("y.doc_id"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & once & fits)
    return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _pivots_met(rows: DataFrame) -> DataFrame:
    """doc_id, x (doc_id, label): each class with every pivot of another component that its buckets
    have.  The buckets of a group repeat the same few pivots, so a class gathers them (two for each
    of its SKETCHES ** 2 buckets at most) before a row is made of each."""
    one = F.struct("doc_id", "label")
    pivots = rows.groupBy("key").agg(F.min(one).alias("low"), F.max_by(one, F.xxhash64("doc_id")).alias("high"))
    other = lambda p: F.when(F.col(f"{p}.label") != F.col("label"), F.col(p))
    held = rows.join(pivots, "key").groupBy("doc_id").agg(F.collect_set(other("low")).alias("low"), F.collect_set(other("high")).alias("high"))
    only = F.filter("high", lambda x: ~F.array_contains("low", x))
    return held.select("doc_id", F.explode(F.concat("low", only)).alias("x"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    since = mark(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(sketched(known, width), "sketches")
    own = F.struct("n_shingles", "fp1", "fp2")
    several = sketches.groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    if several.limit(1).count():
        out = _by_row(known, width, percent)
    else:
        out = _by_id(known, sketches, width, percent)
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = sketched(docs.where("doc_id IS NULL"), width).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return finished(out.unionByName(nameless), "near-duplicates", since)


def _by_row(known: DataFrame, width: int, percent: int) -> DataFrame:
    """Where an id has several texts: rows are linked under keys of their own, then the rows of one
    id, whose components become one, named by its smallest id."""
    keyed = written(known.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")
    rows = keyed.select(F.col("key").alias("doc_id"), "text")
    found = _by_id(rows, written(sketched(rows, width), "sketches"), width, percent)
    found = written(found.withColumnRenamed("doc_id", "key").join(keyed.select("key", "doc_id"), "key"), "named")
    one = found.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    edges = written(found.join(one, "doc_id").select("a", F.col("component_id").alias("b")).where("a <> b").distinct(), "same-id")
    labels = components(edges).withColumnRenamed("id", "component_id")
    placed = written(found.join(labels, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "component_id").alias("label")), "placed")
    names = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return placed.join(names, "label").select("doc_id", "n_shingles", "component_id")


def _by_id(known: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, where all rows of an id have the same set."""
    prints = ["fp1", "fp2"]
    full = sketches.where("n_shingles > 0")
    shared_sets = written(full.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("__last")).where("rep < __last").select(*prints, "rep"), "classes")
    classed = written(sketches.select("doc_id", "n_shingles", *prints).join(shared_sets, prints, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "classed")
    reps = full.join(shared_sets, prints, "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))).select("doc_id", "bits", "sketches")
    reps = written(reps, "reps")

    # sketches that at least two classes share
    single = reps.select("doc_id", F.posexplode("sketches").alias("t", "v"))
    shared = written(single.groupBy("t", "v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("t", "v"), "shared-sketches")
    held = single.join(shared, ["t", "v"]).groupBy("doc_id").agg(F.collect_set(F.struct("t", "v")).alias("s"))  # at most 2 * SKETCHES each
    of = lambda test: F.filter("s", test)
    keys = (
        held.select("doc_id", F.explode(of(lambda x: x["t"] < SKETCHES)).alias("x"), of(lambda x: x["t"] >= SKETCHES).alias("s"))
        .select("doc_id", "x", F.explode("s").alias("y"))
        .select(F.xxhash64("x.t", "x.v", "y.t", "y.v").alias("key"), "doc_id")
    )
    keys = written(keys, "keys")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("p1"), F.max("doc_id").alias("__last"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("p2"))
    buckets = written(buckets.where("p1 < __last").drop("__last"), "buckets")
    members = written(keys.join(buckets, "key").select("key", "doc_id", "p1", "p2"), "members")
    bits = reps.select("doc_id", "bits")
    wanted = written(members.select("doc_id").distinct(), "candidates")
    # rows that repeat an id have one set here: any of their texts stands for it
    texts = written(known.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidate-texts")

    def stars(rows: DataFrame) -> DataFrame:
        """Pairs of doc_id with each of ``pivots``, an array, once each."""
        met = rows.select(F.explode("pivots").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def possible(pairs: DataFrame) -> DataFrame:
        x = pairs.join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b").join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
        return x.where(_may_link(F.col("bits_a"), F.col("bits_b"), percent)).select("a", "b")

    def is_open(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    # first the two pivots that come first over all buckets of a class; then, where a bucket still
    # holds several components, classes against pivots of other components in it
    nearest = members.groupBy("doc_id").agg(F.min("p1").alias("p1"), F.min_by("p2", F.xxhash64("p2")).alias("p2"))
    pairs = written(possible(stars(nearest.select("doc_id", F.array("p1", "p2").alias("pivots")))), "pairs")
    links = written(confirmed(pairs, texts, width, percent), "links")
    labels = components(links)
    rows = written(labelled(members.select("key", "doc_id")), "placed-so-far")
    rows = rows.join(is_open(rows), "key", "left_semi")
    # a class is compared with one pivot, the smallest, of each component that its buckets hold
    met = _pivots_met(rows).groupBy("doc_id", F.col("x.label").alias("label")).agg(F.array(F.min("x.doc_id")).alias("pivots"))
    second = written(possible(stars(met).join(pairs, ["a", "b"], "left_anti")), "pairs")
    if second.limit(1).count():
        pairs = pairs.unionByName(second)
        links = links.unionByName(written(confirmed(second, texts, width, percent), "links"))
        labels = components(links)

    # buckets that still hold several components: pairs across them, not looked at yet
    placed = written(labelled(members.select("key", "doc_id")), "placed")
    open_keys = is_open(placed)
    by_label = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    major = written(by_label.join(open_keys, "key", "left_semi").groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major")), "open-buckets")
    inside = placed.join(major, "key").groupBy("doc_id", "label").agg(F.max(F.col("label") != F.col("major")).alias("outside"))
    cross = _prefix_pairs(written(inside, "open-members"), texts, bits, width, percent)
    more = written(confirmed(written(cross.join(pairs, ["a", "b"], "left_anti"), "cross-pairs"), texts, width, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    return classed.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
