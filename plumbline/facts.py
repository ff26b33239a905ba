"""Fact tables of source files, extracted in one pass over the files.

``extract`` reads each file once and gives one row per file with all its facts as arrays; the tables
are projections of that stored table.  Imports and exports alone are read without the rest.  Resolution of specifiers is a join with the listing of files.

Defined results: a null text counts as empty; a file that cannot be read as a program gives an
error and no facts; paths are distinct (``sources.discover`` gives each once); an empty table gives
empty tables; other columns of the input are not carried.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.cut import spread, written
from plumbline.lang import prose, rust, typescript

SPAN = "struct<start_byte:int,end_byte:int,line:int,column:int>"
_NAME = "struct<source_name:string,local_name:string,kind:string,type_only:boolean,local_use_count:int>"
_COLUMNS = {
    "imports": f"array<struct<from_file:string,specifier:string,type_only:boolean,span:{SPAN},names:array<{_NAME}>,candidates:array<string>>>",
    "exports": f"array<struct<file:string,name:string,kind:string,type_only:boolean,span:{SPAN},source_specifier:string,candidates:array<string>,declares:string>>",
    "functions": f"array<struct<name:string,span:{SPAN},params:int,lines:int,cyclomatic:int,cognitive:int,throws:int,returns_error:int,mixed:boolean>>",
    "marks": f"array<struct<kind:string,detail:string,span:{SPAN}>>",
    "shapes": f"array<struct<file:string,name:string,span:{SPAN},fields:array<struct<name:string,type:string>>,extends:array<string>>>",
    "statements": f"array<struct<block:int,run:int,at:int,span:{SPAN},exact:bigint,shape:bigint,bytes:int>>",
    "types": "array<struct<start_byte:int,end_byte:int,text:string,members:array<string>,null:boolean,undefined:boolean,any:boolean>>",
    "words": f"array<struct<word:string,span:{SPAN}>>",
}
_MODULES = ("imports", "exports")


def _schema(columns: Iterable[str]) -> str:
    return "file string, language string, error string, " + ", ".join(f"{k} {_COLUMNS[k]}" for k in columns)


#: Languages by extension.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "typescript", ".jsx": "typescript", ".mjs": "typescript", ".cjs": "typescript", ".astro": "astro", ".rs": "rust", ".html": "html", ".htm": "html", ".md": "markdown", ".mdx": "markdown", ".typ": "typst"}


def language_of(path: str) -> str:
    return LANGUAGES.get(posixpath.splitext(path)[1].lower(), "other")


def _program(path: str, text: str, paths: dict[str, list[str]] | None) -> dict[str, Any]:
    source = typescript.Source(path, text, paths)
    if source.faults:
        return {"error": source.faults[0]}
    functions = source.functions()
    typed, types = source.typed()
    return {"imports": source.imports, "exports": source.exports, "functions": functions, "marks": source.marks() + source.habits() + typed, "types": types, "shapes": source.shapes(), "statements": source.statements(), "words": prose.program_words(source)}


def _modules(path: str, text: str, paths: dict[str, list[str]] | None) -> dict[str, Any]:
    source = typescript.Source(path, text, paths)
    return {"error": source.faults[0]} if source.faults else {"imports": source.imports, "exports": source.exports}


#: Readers by language: facts of (path, text, path patterns).  Others can be added.
ADAPTERS: dict[str, Callable[[str, str, dict[str, list[str]] | None], dict[str, Any]]] = {
    "typescript": _program,
    "astro": lambda path, text, paths: _program(path, typescript.astro_script(text), paths),
    "rust": lambda path, text, paths: rust.facts(path, text),
    "markdown": lambda path, text, paths: {"words": prose.markdown_words(text)},
}


def read_one(path: str, text: str | None, paths: dict[str, list[str]] | None = None, columns: Iterable[str] = tuple(_COLUMNS)) -> dict[str, Any]:
    language = language_of(path)
    row: dict[str, Any] = {"file": path, "language": language, "error": None} | {k: [] for k in columns}
    adapter = ADAPTERS.get(language)
    if adapter is _program and set(columns) <= set(_MODULES):
        adapter = _modules
    return row | adapter(path, text or "", paths) if adapter else row


def _again(row: dict[str, Any], path: str) -> dict[str, Any]:
    """The facts of a text for another path of the same folder."""
    named = {"imports": "from_file", "exports": "file", "shapes": "file"}
    return row | {"file": path} | {k: [x | {name: path} for x in row[k]] for k, name in named.items() if row.get(k)}


def extract(files: DataFrame, paths: dict[str, list[str]] | None = None, columns: Iterable[str] = tuple(_COLUMNS)) -> DataFrame:
    """One row per row of ``files`` (path, text), with the ``columns`` wanted.  Reading a text takes
    far longer than moving it, so texts are dealt to some tasks per core.  A task remembers short texts: one that occurs again in a folder is not read
    again."""
    columns = tuple(columns)
    schema = to_arrow_schema(StructType.fromDDL(_schema(columns)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, Any]] = {}

        def read(path: str, text: str | None) -> dict[str, Any]:
            if not text or len(text) > 4000 or ADAPTERS.get(language_of(path)) is not _program:
                return read_one(path, text, paths, columns)
            key = posixpath.dirname(path) + "\0" + language_of(path), text
            row = held.get(key)
            if row is not None:
                return _again(row, path)
            if len(held) >= 500:
                held.clear()
            held[key] = row = read_one(path, text, paths, columns)
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                block = batch.slice(at, 50)
                found = [read(p, t) for p, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in found], schema=schema)

    return spread(files.where("path IS NOT NULL").select("path", F.col("text").cast("string").alias("text")), "path").mapInArrow(rows, _schema(columns))


@dataclass
class Facts:
    """The fact tables of ``files`` (path, text), over one stored extraction."""

    files: DataFrame
    paths: dict[str, list[str]] | None = None

    @cached_property
    def stored(self) -> DataFrame:
        return written(extract(self.files, self.paths), "facts")

    @cached_property
    def modules(self) -> DataFrame:
        """file, language, error, imports and exports: ``stored`` where there is one, else without the
        rest, which takes most of the time."""
        return self.__dict__.get("stored") or written(extract(self.files, self.paths, _MODULES), "modules")

    def _each(self, column: str) -> DataFrame:
        held = self.modules if column in _MODULES else self.stored
        return held.select("file", "language", F.posexplode(column).alias("ordinal", "x"))

    @cached_property
    def listing(self) -> DataFrame:
        """Paths of all files."""
        return self.files.where("path IS NOT NULL").select(F.col("path").alias("file")).distinct()

    def _resolved(self, rows: DataFrame, to: str) -> DataFrame:
        """``to``: the first candidate that is a file.  Candidates that exist are found by an
        equi-join that sends no table to the driver; specifiers without any keep a null."""
        listing = self.listing.withColumnRenamed("file", "c").hint("merge")
        tries = rows.select("file", "ordinal", F.posexplode("candidates").alias("rank", "c")).join(listing, "c", "left_semi")
        first = tries.groupBy("file", "ordinal").agg(F.min_by("c", "rank").alias(to)).hint("merge")
        return rows.drop("candidates").join(first.withColumnsRenamed({"file": "__f", "ordinal": "__o"}), (F.col("file") == F.col("__f")) & (F.col("ordinal") == F.col("__o")), "left").drop("__f", "__o")

    @cached_property
    def imports(self) -> DataFrame:
        rows = self._each("imports").select("file", "ordinal", "x.specifier", "x.type_only", "x.span", "x.names", "x.candidates")
        return written(self._resolved(rows, "resolved").withColumnRenamed("file", "from_file"), "imports")

    @cached_property
    def exports(self) -> DataFrame:
        rows = self._each("exports").select("file", "ordinal", "x.name", "x.kind", "x.type_only", "x.span", "x.source_specifier", "x.declares", "x.candidates")
        return written(self._resolved(rows, "resolved_source"), "exports")

    @property
    def names(self) -> DataFrame:
        """Imported names, one row each."""
        return self.imports.select("from_file", "ordinal", "specifier", "resolved", F.col("type_only").alias("statement_type_only"), "span", F.explode("names").alias("n")).select("*", "n.*").drop("n")

    @property
    def functions(self) -> DataFrame:
        return self._each("functions").select("file", "language", "ordinal", "x.*")

    @property
    def marks(self) -> DataFrame:
        return self._each("marks").select("file", "language", "ordinal", "x.*")

    @property
    def shapes(self) -> DataFrame:
        return self._each("shapes").select("ordinal", "x.*")

    @property
    def statements(self) -> DataFrame:
        return self._each("statements").select("file", "x.*")

    @property
    def types(self) -> DataFrame:
        """file, start_byte, end_byte, text, members, null, undefined, any: the types of values, as far as
        their own files declare them.  A type checker's table can stand in its place."""
        return self._each("types").select("file", "x.*").distinct()

    @property
    def words(self) -> DataFrame:
        return self._each("words").select("file", "ordinal", "x.word", "x.span")

    @property
    def errors(self) -> DataFrame:
        return self.modules.where("error IS NOT NULL").select("file", "error")

    @cached_property
    def lines(self) -> DataFrame:
        """path, line, text, start_byte, is_blank, is_comment of every line."""
        return lines(self.files)


def lines(files: DataFrame) -> DataFrame:
    """path, line, text, start_byte, is_blank, is_comment: one row per line, its place by the bytes
    of the lines before it (a line's end counts one)."""
    each = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    size = F.transform(each, lambda x: F.octet_length(x) + 1)
    # the running sum of one file's lines, in two steps: blocks of 1024, and lines within their block
    rows = files.select("path", F.posexplode(F.arrays_zip(each.alias("text"), size.alias("size"))).alias("k", "x")).select("path", F.col("k").cast("int").alias("k"), "x.text", "x.size")
    from pyspark.sql import Window

    within = Window.partitionBy("path", F.floor(F.col("k") / 1024)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", F.floor(F.col("k") / 1024).alias("b")).agg(F.sum("size").alias("n"))
    before = blocks.select(F.col("path").alias("__p"), F.col("b").alias("__b"), F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, (F.col("path") == F.col("__p")) & (F.floor(F.col("k") / 1024) == F.col("__b")))
    bare = F.btrim("text", F.lit(" \t\r"))
    return placed.select("path", (F.col("k") + 1).alias("line"), "text", (F.col("base") + F.col("own")).cast("int").alias("start_byte"), (bare == "").alias("is_blank"), bare.rlike(r"\A(//|/\*|\*|#)").alias("is_comment"))
