"""Files below folders, with ignore files, as a table.

Folders are listed and read by Spark's binary file source, so a store that only Spark reads works and
reading is spread over executors.  Ignore files are read first (they are few), and become one filter.

Defined results: a file that is no UTF-8 is read with replacement marks; a hidden file or folder (a
name with a leading dot) is left out unless asked for; a pattern in a deeper ignore file wins over
one above it, a later line over an earlier; a folder that is ignored hides all below it.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions taken by default; declaration files, which are left out.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "rs", "astro", "html", "htm")
DECLARATIONS = (".d.ts", ".d.cts", ".d.mts")
IGNORE_FILES = (".gitignore", ".plumblineignore")


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression over the path below the ignore file's folder, whether it takes back), or
    None for a blank or a comment.  A pattern with a slash inside is bound to that folder, one with a
    slash at the end is for folders."""
    text = re.sub(r"(?<!\\)\s+\Z", "", line)
    if not text or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text[1:] if back else re.sub(r"\A\\(?=[!#])", "", text)
    folder = text.endswith("/")
    text = text.rstrip("/")
    bound = "/" in text
    text = text.removeprefix("/")
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if text.startswith("**/", k) and (k == 0 or text[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if text.startswith("/**", k) and k + 3 == len(text):
            out, k = out + "/.*", k + 3
            continue
        if c == "*":
            while text.startswith("*", k + 1):
                k += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in text[k + 2 :]:
            end = text.index("]", k + 2)
            body = text[k + 1 : end]
            out += ("[^/" if body[0] in "!^" else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if body[0] in "!^" else body) + "]"
            k = end
        elif c == "\\" and k + 1 < len(text):
            k += 1
            out += re.escape(text[k])
        else:
            out += re.escape(c)
        k += 1
    head = "" if bound else "(?:.*/)?"
    return rf"\A{head}{out}{'/.*' if folder else '(?:/.*)?'}\z", back


def ignored(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """Whether ignore lines (folder, line) leave a path out: the last that matches decides, but for
    what an ignored folder hides."""
    out = F.lit(False)
    for folder, line in sorted(patterns, key=lambda p: p[0].count("/") + bool(p[0])):
        found = ignore_regex(line)
        if found is None:
            continue
        head = folder.rstrip("/") + "/" if folder else ""
        below = F.substr(path, F.lit(len(head) + 1)) if head else path
        hit = path.startswith(head) & below.rlike(found[0]) if head else below.rlike(found[0])
        out = F.when(hit, F.lit(not found[1])).otherwise(out)
    return out


def wanted(path: Column, extensions: tuple[str, ...] = EXTENSIONS, hidden: bool = False, declarations: bool = False) -> Column:
    """Whether a path below the root is to be taken, by its name alone."""
    out = F.regexp_extract(path, r"\.([^./]*)\z", 1).isin(list(extensions))
    if not hidden:
        out = out & ~path.rlike(r"(\A|/)\.[^/]")
    if not declarations:
        for end in DECLARATIONS:
            out = out & ~path.endswith(end)
    return out


def select(files: DataFrame, patterns: list[tuple[str, str]] = (), **options) -> DataFrame:  # noqa: ANN003
    """Of files (path, ...), below a root, those to be taken, in order of their paths."""
    return files.where(wanted(F.col("path"), **options) & ~ignored(F.col("path"), list(patterns))).orderBy("path")


def _levels(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of that name (a glob) in the folders below ``root``, level by level: one listing of the
    file system for each level.  Spark's own listing leaves out names with a leading dot."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[str] = []
    folders = fs.makeQualified(base).toString().rstrip("/")
    while True:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folders}/{name}"))
        out += [s.getPath().toString() for s in found or []]
        folders += "/*"
        below = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folders}/*"))
        if not below:
            return out


def discover(spark: SparkSession, root: str, respect_ignore: bool = True, **options) -> DataFrame:  # noqa: ANN003
    """path (below ``root``), text, content_sha of the files of a folder."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    head = re.sub(r"/+", "/+", re.escape(re.sub(r"/+", "/", full)))
    below = lambda p: re.sub(f"\\A{head}/+", "", p)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listing = read.load(root).select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("content_sha"))
    if options.get("hidden"):
        dotted = [p for p in _levels(spark, root, "*") if re.search(r"(\A|/)\.[^/]", below(p))]
        listing = listing.unionByName(_on_driver(spark, dotted).withColumn("content_sha", F.sha2("text", 256)))
    patterns: list[tuple[str, str]] = []
    if respect_ignore:
        for name in IGNORE_FILES:
            for r in _on_driver(spark, _levels(spark, root, name)).orderBy("path").collect():  # ignore files
                patterns += [(posixpath.dirname(below(r["path"])), line) for line in (r["text"] or "").splitlines()]
    named = listing.withColumn("path", F.regexp_replace("path", f"^{head}/+", ""))
    held = named.where(wanted(F.col("path"), **options) & ~ignored(F.col("path"), patterns))
    return held.select("path", F.make_valid_utf8("text").alias("text"), "content_sha").orderBy("path")


def _on_driver(spark: SparkSession, found: list[str]) -> DataFrame:
    """path, text of files whose names Spark's sources leave out: ignore files, and hidden ones if asked
    for.  Those are few, and read one by one."""
    rows = []
    for path in found:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(where).isFile():
            stream = fs.open(where)
            rows.append((path, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(rows, "path string, text string")


def in_memory(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """path, text of texts that are held in memory."""
    return spark.createDataFrame(sources, "path string, text string")


def overlay(files: DataFrame, buffers: DataFrame) -> DataFrame:
    """The files with the texts of open buffers (path, text) in place of their own; buffers of files
    that are not there are added.  A null text of a buffer is an empty one."""
    open_ = buffers.groupBy("path").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    return files.select("path", "text").join(open_, "path", "left_anti").unionByName(open_.select("path", "text"))


def fingerprint(files: DataFrame) -> Column:
    """A hash over all paths and content hashes, the same in any order, as a scalar: the sums of two
    independent 64-bit hashes of each, and their number.  Nothing is gathered."""
    a, b = F.xxhash64("path", F.sha2(F.coalesce("text", F.lit("")), 256)), F.xxhash64(F.lit(1), "path", F.sha2(F.coalesce("text", F.lit("")), 256))
    sums = F.concat_ws(":", F.count("*"), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("decimal(38,0)")))
    return files.agg(F.sha2(sums, 256)).scalar()
