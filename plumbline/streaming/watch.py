"""Incremental runs: changed files replace what was known of them, removed ones go, and wide rules run
again over the groups they touch.

State is a written table per batch, one row per file and fact; a batch that runs again starts from the
version before it, and a run that starts again finds the last version by what is in its folder.
Defined results: of several events of a file in a batch the last counts (ties: a removal, then the
larger text); events of other kinds than created, modified, removed, renamed are skipped; an event
without a path is skipped; a stream without events leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.cut import new_path

#: Kinds of events that matter; a renamed file is there under its new path.
KINDS = ("created", "modified", "removed", "renamed")


def relevant(events: DataFrame) -> DataFrame:
    """File events (path, kind, ts, text) that change what is known."""
    return events.where(F.col("kind").isin(*KINDS) & F.col("path").isNotNull())


def sessions(events: DataFrame, key: str, at: str, gap_seconds: float, watermark: str | None = None) -> DataFrame:
    """Trailing debounce: events of a key closer than the gap belong together; each group's first
    and last event and its size.  On a stream, ``watermark`` bounds the state."""
    source = events.withWatermark(at, watermark) if watermark else events
    held = source.groupBy(key, F.session_window(F.col(at), f"{round(gap_seconds * 1000)} milliseconds")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return held.drop("session_window")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_events(batch: DataFrame) -> DataFrame:
    """The last event of each file."""
    return latest(relevant(batch), "path", [F.desc("ts"), F.desc(F.col("kind") == "removed"), F.desc("text")])


class State:
    """Facts by file, one written version per batch."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _fs(self, path: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """The batches whose version is complete, in order."""
        fs, where = self._fs(f"{self.folder}/state")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.folder}/state/{n}/_SUCCESS")[1]))

    def before(self, batch: int | None = None) -> DataFrame:
        """The facts of the last version, or of the last before a batch."""
        held = [v for v in self.versions() if batch is None or v < batch]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/state/{held[-1]}")

    def write(self, rows: DataFrame, batch: int, keep: int = 2) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")
        for v in [v for v in self.versions() if v < batch][: -(keep - 1) or None]:
            fs, where = self._fs(f"{self.folder}/state/{v}")
            fs.delete(where, True)


def step(state: DataFrame, events: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state after, facts that came, facts that went): files with an event lose their facts, those
    that are there get new ones from ``extract`` over (path, text); all others keep theirs."""
    last = last_events(events)
    touched = last.select(F.col("path").alias("file")).distinct()
    fresh = extract(last.where("kind <> 'removed'").select("path", "text")).select(*state.columns)
    gone = state.join(touched, "file", "left_semi")
    return state.join(touched, "file", "left_anti").select(*state.columns).unionByName(fresh), fresh, gone.select(*state.columns)


def dirty_groups(results: DataFrame, state: DataFrame, fresh: DataFrame, gone: DataFrame, key: str, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A wide rule's results by ``key``: groups that a changed file was or is part of are evaluated
    again over the state, all others stay."""
    dirty = fresh.select(key).union(gone.select(key)).distinct()
    return results.join(dirty, key, "left_anti").select(*results.columns).unionByName(evaluate(state.join(dirty, key, "left_semi")).select(*results.columns))


def without_files(slots: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every slot's table without the rows of files (file) that went."""
    files = gone.select("file").distinct()
    return {name: rows.join(files, "file", "left_anti").select(*rows.columns) for name, rows in slots.items()}


def run(events: DataFrame, folder: str, schema: str, extract: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame, int], None] | None = None) -> State:
    """Runs a stream of file events to its end, batch by batch, into the state below ``folder``; a
    second run goes on where the first ended.  ``after`` sees the state after each batch."""
    spark = events.sparkSession
    state = State(spark, folder, schema)

    def one(batch: DataFrame, n: int) -> None:
        now, _, _ = step(state.before(n), batch, extract)
        state.write(now, n)
        if after is not None:
            after(state.before(n + 1), n)

    query = events.writeStream.foreachBatch(one).option("checkpointLocation", f"{state.folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return state


def event_files(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in the folder ``path``, ``per_batch`` files a batch, the oldest
    first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def replayed(events: DataFrame, batches: int) -> str:
    """The rows of ``events`` (``batch`` from 0) as one file for each batch, in a folder of the shared
    place: what a stream over them reads batch by batch."""
    base = new_path(events.sparkSession, "events")
    for k in range(batches):
        events.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(base)
    return base
