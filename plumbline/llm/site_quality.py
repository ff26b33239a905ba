"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

Evidence is a log likelihood ratio, from the words and shape of the text: telling words are
weighed one by one, and a logistic regression over their sum and the binned shape corrects
for words that tell the same.  Both are fitted on at most SAMPLE labelled rows (the first by
a hash of their id; labels beyond that are not needed).
Over all documents the evidence gives soft counts by host (``source``) and path (``source``
and ``lang``), combined before the shuffle.  A host's rate is shrunk to the global rate and
a path's to its host's, the sparser the more; how much is found from the rates' spread over
hosts and over paths.  A document's posterior is its path's rate moved by its evidence.

Defined results: a null text counts as empty; null hosts and paths are groups of their own;
rows that repeat count each; labels that are null are left out; without labels the evidence
is 0 and everything is kept; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import finished, mark, written

SAMPLE = 20_000
BUCKETS = 1 << 18
WORD_FEATURES = 512
#: The table of rates, one row per path, is broadcast up to so many rows; beyond it Spark joins as it sees fit.
BROADCAST_PATHS = 50_000
TARGETS = ("quality", "toxic")
SHAPES = 6
BINS = 12
#: Rates of hosts and paths are known from so many rows at least before they count at all.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6

_MARKS = b".,!?;:\"'()[]"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))


def features(text: str | None) -> tuple[set[bytes], list[int]]:
    """Distinct words, without marks and case, and the bins of the shape of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(None, _MARKS).lower().split()
    distinct = set(words)
    n = max(1, len(words))
    size = max(1, len(raw))
    symbols = (size - len(raw.translate(None, _SYMBOLS))) / size if raw else 0.0
    upper = (size - len(raw.translate(None, _UPPER))) / size if raw else 0.0
    exclaimed = raw.count(b"!!") / n
    longest = max((len(w) for w in distinct), default=0)
    bins = [
        min(BINS - 1, int(len(distinct) / n * BINS)),
        min(BINS - 1, int(symbols * 120)),
        min(BINS - 1, int(upper * 24)),
        min(BINS - 1, int(math.log2(n + 1))),
        min(BINS - 1, int(exclaimed * 24)),
        min(BINS - 1, longest // 4),
    ]
    return distinct, bins


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


@dataclass
class Evidence:
    """Log likelihood ratios of a target being 1: of word buckets, and the regression's weights
    over one column per shape and bin, the word sums of all targets, and a constant."""

    prior: dict[str, float] = field(default_factory=dict)
    words: dict[int, tuple[float, ...]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(TARGETS), COLUMNS)))

    def row(self, text: str | None) -> tuple[list[int], list[float]]:
        """The set columns of a text, and its word sums (held within +-WORD_BOUND)."""
        distinct, bins = features(text)
        sums = [0.0] * len(TARGETS)
        get = self.words.get
        for w in distinct:
            hit = get(zlib.crc32(w) % BUCKETS)
            if hit is not None:
                for t, x in enumerate(hit):
                    sums[t] += x
        return [k * BINS + b for k, b in enumerate(bins)], [max(-WORD_BOUND, min(WORD_BOUND, x)) for x in sums]

    def __call__(self, text: str | None) -> list[float]:
        at, sums = self.row(text)
        return [float(w[at].sum() + w[SHAPES * BINS : -1] @ sums + w[-1]) for w in self.weights]


WORD_BOUND = 20.0
COLUMNS = SHAPES * BINS + len(TARGETS) + 1


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Counts of documents with a word or shape, by label, over the bounded sample."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    first = known.select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample)
    chosen = written(first, "labelled").toPandas()  # at most ``sample`` rows of a stored table
    if not len(chosen):
        return Evidence(dict.fromkeys(TARGETS, 0.5))
    few = F.broadcast(spark.createDataFrame(chosen, "doc_id long, quality int, toxic int"))  # at most ``sample`` rows
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(few, "doc_id").select("text", "quality", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((BUCKETS, 4), np.int64)  # by 2 * quality + toxic
        total = np.zeros((1, 4), np.int64)
        for batch in batches:
            for text, q, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                k = 2 * (q > 0) + (x > 0)
                words[list({_bucket(w) for w in features(text)[0]}), k] += 1
                total[0, k] += 1
        for kind, a in enumerate((words, total)):
            seen = np.flatnonzero(a.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind, np.int32)), pa.array(seen.astype(np.int32)), *[pa.array(a[seen, j]) for j in range(4)]], ["kind", "at", "n0", "n1", "n2", "n3"])

    sums = written(labelled.mapInArrow(count, "kind int, at int, n0 long, n1 long, n2 long, n3 long").groupBy("kind", "at").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(4)]), "evidence")
    rest = sums.where("kind > 0").toPandas()
    if not len(rest):
        return Evidence(dict.fromkeys(TARGETS, 0.5))
    cells = ["n0", "n1", "n2", "n3"]
    total = rest[rest["kind"] == 1][cells].to_numpy(float).sum(axis=0)
    sides = {"quality": ([2, 3], [0, 1]), "toxic": ([1, 3], [0, 2])}
    out = Evidence()
    words: dict[int, list[float]] = {}
    for t, target in enumerate(TARGETS):
        yes, no = sides[target]
        n1, n0 = total[yes].sum(), total[no].sum()
        out.prior[target] = (n1 + 1) / (n1 + n0 + 2)
        if not n1 or not n0:
            continue
        a = sum(F.col(cells[j]) for j in yes[1:]) + F.col(cells[yes[0]])
        b = sum(F.col(cells[j]) for j in no[1:]) + F.col(cells[no[0]])
        p, q = a / F.lit(float(n1)), b / F.lit(float(n0))
        both = (a + b) / F.lit(float(n1 + n0))
        spread = F.sqrt(both * (1 - both) * F.lit(1 / n1 + 1 / n0) + F.lit(1e-12))
        z = F.abs(p - q) / spread
        top = sums.where("kind = 0").select("at", a.alias("a"), b.alias("b"), z.alias("z")).orderBy(F.desc("z"), "at").limit(WORD_FEATURES)
        for r in written(top, "telling").collect():  # at most WORD_FEATURES rows of a stored table
            if r["z"] > 8:
                words.setdefault(r["at"], [0.0] * len(TARGETS))[t] = math.log((r["a"] + 0.5) / (n1 + 1) / ((r["b"] + 0.5) / (n0 + 1)))
    out.words = {k: tuple(v) for k, v in words.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [out.row(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["quality", "toxic", "at", "sums"])

    seen = labelled.mapInArrow(rows, "quality int, toxic int, at array<int>, sums array<double>").toPandas()  # at most ``sample`` labels' rows
    x = np.zeros((len(seen), COLUMNS))
    x[np.arange(len(seen))[:, None], np.stack(seen["at"].to_numpy())] = 1
    x[:, SHAPES * BINS : -1] = np.stack(seen["sums"].to_numpy())
    x[:, -1] = 1
    for t, target in enumerate(TARGETS):
        y = (seen[target].to_numpy() > 0).astype(float)
        if 0 < y.sum() < len(y):
            out.weights[t] = regress(x, y)
            out.weights[t, -1] -= _plain_logit(out.prior[target])
    return out


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(rates: DataFrame, rate: str, n: str) -> float:
    """How many rows a prior weighs, from the spread of group rates (moments of a beta law)."""
    r = rates.agg(F.sum(F.col(n)).alias("n"), F.count("*").alias("g"), F.sum(F.col(rate) * F.col(n)).alias("s"), F.sum(F.col(n) * F.col(rate) * F.col(rate)).alias("ss"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not r["n"] or r["g"] < 2:
        return MOST_STRENGTH
    mean = r["s"] / r["n"]
    between = r["ss"] / r["n"] - mean * mean - mean * (1 - mean) * r["g"] / r["n"]
    if between <= 0:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, mean * (1 - mean) / between - 1))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, host: str = "source", path: str = "lang", broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """doc_id; by target the evidence, the path's rate and the posterior; kept: the posterior
    of quality is at least one half and that of toxicity below it."""
    since = mark(docs.sparkSession)
    evidence = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(evidence)
    names = [f"{t}_evidence" for t in TARGETS]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for batch in batches:
            found = [e(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([f[t] for f in found], pa.float64()) for t in range(len(TARGETS))]], ["doc_id", "host", "path", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    seen = written(slim.mapInArrow(weigh, "doc_id long, host string, path string, " + ", ".join(f"{n} double" for n in names)), "evidence")
    soft = [F.sum(_expit(F.col(n) + F.lit(_plain_logit(evidence.prior[t])))).alias(f"{t}_s") for t, n in zip(TARGETS, names, strict=True)]
    paths = written(seen.groupBy("host", "path").agg(F.count("*").alias("n"), *soft), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"{t}_s").alias(f"{t}_hs") for t in TARGETS]), "hosts")
    rates = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"], "path", "n", "hn", *[f"{t}_s" for t in TARGETS], *[f"{t}_hs" for t in TARGETS])
    for t in TARGETS:
        by_host = _strength(hosts.withColumn("r", F.col(f"{t}_hs") / F.col("hn")), "r", "hn")
        by_path = _strength(paths.withColumn("r", F.col(f"{t}_s") / F.col("n")), "r", "n")
        total = hosts.agg(F.sum(f"{t}_hs").alias("s"), F.sum("hn").alias("n")).first()
        top = (total["s"] + evidence.prior[t]) / (total["n"] + 1) if total["n"] else evidence.prior[t]
        host_rate = (F.col(f"{t}_hs") + F.lit(by_host * top)) / (F.col("hn") + F.lit(by_host))
        rate = (F.col(f"{t}_s") + F.lit(by_path) * host_rate) / (F.col("n") + F.lit(by_path))
        rates = rates.withColumn(f"{t}_rate", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate)))
    rates = written(rates.select(F.col("host").alias("h"), F.col("path").alias("p"), *[f"{t}_rate" for t in TARGETS]), "rates")
    if rates.count() <= broadcast_paths:
        rates = F.broadcast(rates)
    joined = seen.join(rates, seen["host"].eqNullSafe(F.col("h")) & seen["path"].eqNullSafe(F.col("p")), "left")
    posterior = {t: _expit(_logit(F.col(f"{t}_rate")) + F.col(f"{t}_evidence")) for t in TARGETS}
    judged = joined.select(
        "doc_id",
        *[F.round(n, 6).alias(n) for n in names],
        *[F.round(f"{t}_rate", 6).alias(f"{t}_path_rate") for t in TARGETS],
        *[F.round(posterior[t], 6).alias(f"p_{t}") for t in TARGETS],
        ((posterior["quality"] >= 0.5) & (posterior["toxic"] <= 0.5)).alias("kept"),
    )
    return finished(judged, "judged", since)


def _plain_logit(p: float) -> float:
    return math.log(p / (1 - p))
