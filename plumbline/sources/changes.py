"""What changed, under version control: unified diffs as tables, and git on the driver.

Defined results: a file whose hunks only delete has no ranges, and is changed all the same; a deleted
file is not there; text outside of a file's hunks is skipped; an empty diff changes nothing.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_diff(lines: DataFrame) -> DataFrame:
    """file, first_line, last_line (both null: no range) from the lines of unified diffs (diff, at,
    line): one row for each range of the new text, and one for a file without any.

    The file of a hunk is the last header above it: headers and hunks are few, so lines of contents
    are left out first, and each diff is ordered by itself."""
    marks = lines.where(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ "))
    name = F.regexp_extract("line", r"\A\+\+\+ (?:b/)?(.*?)\r?\z", 1)
    header = F.when(F.col("line").startswith("+++ "), F.when(name == "/dev/null", F.lit("")).otherwise(name))
    w = Window.partitionBy("diff").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.withColumn("file", F.last(header, ignorenulls=True).over(w)).where("file <> ''")
    start = F.regexp_extract("line", r"\A@@ .*?(?<=\s)\+(\d{1,9})(?:,\d{1,9})?(?=\s)", 1)
    count = F.regexp_extract("line", r"\A@@ .*?(?<=\s)\+\d{1,9},(\d{1,9})(?=\s)", 1)
    n = F.when(count == "", F.lit(1)).otherwise(count.cast("int"))
    first = F.when((start != "") & (n > 0), start.cast("int"))
    ranges = held.select("file", first.alias("first_line"), (first + n - 1).alias("last_line"))
    some = ranges.where("first_line IS NOT NULL").distinct()
    none = ranges.select("file").distinct().join(some.select("file"), "file", "left_anti")
    return some.unionByName(none.select("file", F.lit(None).cast("int").alias("first_line"), F.lit(None).cast("int").alias("last_line")))


def diff_lines(texts: DataFrame) -> DataFrame:
    """diff, at, line from whole diffs (diff, text)."""
    return texts.select("diff", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def merge_base(repo: str, ref: str) -> str:
    return _git(repo, "merge-base", ref, "HEAD").strip()


def diff_text(repo: str, mode: str = "worktree", ref: str = "HEAD") -> str:
    """The diff without context of the work tree, of what is staged, or of HEAD since it parted from
    ``ref``."""
    spans = {"worktree": [ref], "staged": ["--cached", ref], "merge-base": [f"{ref}...HEAD"]}
    if mode not in spans:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(spans)}")
    return _git(repo, "diff", "-U0", "--no-color", "--no-ext-diff", "--diff-filter=AMR", *spans[mode])


def changed(spark: SparkSession, repo: str, mode: str = "worktree", ref: str = "HEAD") -> DataFrame:
    """file, first_line, last_line of what changed; files that git does not know yet are changed as
    a whole in the work tree."""
    texts = spark.createDataFrame([("git", diff_text(repo, mode, ref))], "diff string, text string")
    found = parse_diff(diff_lines(texts))
    if mode == "worktree":
        new = [(f, None, None) for f in _git(repo, "ls-files", "--others", "--exclude-standard").splitlines()]
        found = found.unionByName(spark.createDataFrame(new, "file string, first_line int, last_line int"))
    return found


def changed_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Of the files (path, ...) those that changed."""
    return files.join(changes.select(F.col("file").alias("path")).distinct(), "path", "left_semi")


def at_ref(spark: SparkSession, repo: str, ref: str, paths: list[str] | None = None) -> DataFrame:
    """path, text of the files at a commit: all, or those of ``paths`` that it has."""
    named = _git(repo, "ls-tree", "-r", "--name-only", ref).splitlines()
    held = [(p, _git(repo, "show", f"{ref}:{p}")) for p in named if paths is None or p in paths]
    return spark.createDataFrame(held, "path string, text string")
