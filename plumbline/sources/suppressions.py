"""Directives in comments that silence findings: the next line, a block, a whole file.

    // <tool>-ignore: Check.Id: reason      // <tool>-ignore Check.Id - reason      // <tool>-ignore
    // <tool>-ignore-start: Check.Id ... // <tool>-ignore-end
    // <tool>-ignore-file: Check.Id
    // <tool>-disable-next-line A.B, C.D    /* <tool>-disable A.B */ ... /* <tool>-enable */    // <tool>-disable-file

Defined results: an id of null silences every check; a block that is not closed runs to the last
line; a directive without a line after it silences nothing; a null text has no directives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOOL = "plumbline"


def looks_like_check_id(text: str) -> bool:
    return "." in text and re.fullmatch(r"[A-Za-z][A-Za-z0-9._]*", text) is not None


def _one(rest: str) -> list[str]:
    """The id of ``: Check.Id: reason``; none means all."""
    rest = rest.strip().lstrip(":")
    while rest.endswith("*/"):
        rest = rest[:-2]
    found = rest.strip().partition(":")[0].strip()
    return [found] if found else []


def _listed(rest: str) -> list[str]:
    parts = [p.strip() for p in rest.split(",")]
    parts = [p.partition("*/")[0].strip() for p in parts if p and not p.startswith(("*/", "//"))]
    return [p for p in parts if p]


def _after(line: str, word: str) -> str | None:
    at = line.find(word)
    return None if at < 0 else line[at + len(word) :]


def _file_ids(line: str, tool: str) -> list[str] | None:
    rest = _after(line, f"{tool}-ignore-file")
    if rest is not None:
        return _one(rest)
    rest = _after(line, f"{tool}-disable-file")
    return None if rest is None else _listed(rest)


def _start_ids(line: str, tool: str) -> list[str] | None:
    rest = _after(line, f"{tool}-ignore-start")
    if rest is not None:
        return _one(rest)
    rest = _after(line, f"{tool}-disable")
    return None if rest is None or rest.startswith(("-next-line", "-file")) else _listed(rest)


def _end_ids(line: str, tool: str) -> list[str] | None:
    rest = _after(line, f"{tool}-ignore-end")
    if rest is not None:
        return _one(rest)
    rest = _after(line, f"{tool}-enable")
    return None if rest is None else _listed(rest)


def _next_ids(line: str, tool: str) -> list[str] | None:
    rest = _after(line, f"{tool}-ignore")
    if rest is not None and not rest.startswith(("-start", "-end", "-file")):
        bare = rest.lstrip()
        if bare.startswith(":"):
            return _one(bare)
        while bare.endswith("*/"):
            bare = bare[:-2]
        words = bare.split()
        if not words:
            return []
        first = words[0].rstrip(":")
        if looks_like_check_id(first):
            return [first]
    rest = _after(line, f"{tool}-disable-next-line")
    return None if rest is None else _listed(rest)


def directives(text: str | None, tool: str = TOOL) -> list[dict[str, Any]]:
    """One row per directive and id: scope, line_from, line_to (null for a file), check_id (null for
    all), the directive's own line and bytes, and whether it names an id in the ``ignore`` spelling."""
    out: list[dict[str, Any]] = []
    if not text or f"{tool}-" not in text:
        return out
    raw = text.split("\n")
    if raw[-1] == "":
        raw.pop()
    lines = [x.strip() for x in raw]
    blocks: list[tuple[list[str], int, int, str]] = []  # ids, first line, bytes before, text
    starts = [0]
    for x in raw:
        starts.append(starts[-1] + len(x.encode("utf-8", "surrogatepass")) + 1)

    def add(scope: str, ids: list[str], a: int | None, z: int | None, at: int, spelled: str) -> None:
        for check in ids or [None]:
            out.append({"scope": scope, "line_from": a, "line_to": z, "check_id": check, "line": at, "start_byte": starts[at - 1], "end_byte": starts[at] - 1, "scoped": check is not None and f"{tool}-ignore" in spelled, "text": spelled})

    for k, line in enumerate(lines):
        at = k + 1
        if f"{tool}-" not in line:
            continue
        ids = _file_ids(line, tool)
        if ids is not None:
            add("file", ids, None, None, at, line)
            continue
        if line.startswith(("//", "/*")):
            ids = _start_ids(line, tool)
            ended = _end_ids(line, tool) if ids is None else None
            if ids is not None:
                blocks.append((ids, at, at, line))
            elif ended is not None:
                closed = list(range(len(blocks))) if not ended else []
                for check in ended:
                    held = [j for j, b in enumerate(blocks) if j not in closed and (not b[0] or check in b[0])]
                    closed += held[-1:]
                for j in closed:
                    b = blocks[j]
                    add("range", b[0], b[1], at - 1, b[2], b[3])
                blocks = [b for j, b in enumerate(blocks) if j not in closed]
        ids = _next_ids(line, tool)
        if ids is not None:
            following = next((j + 1 for j in range(k + 1, len(lines)) if lines[j]), None)
            if following is not None:
                add("line", ids, following, following, at, line)
    for b in blocks:
        add("range", b[0], b[1], len(lines), b[2], b[3])
    return out


def broad(text: str | None, tool: str = TOOL) -> list[dict[str, int]]:
    """Places of directives for the next line that lead a comment and name no check."""
    out = []
    at = 0
    for number, line in enumerate((text or "").split("\n"), 1):
        m = re.match(rf"\s*(?://|/\*)\s*(?={re.escape(tool)}-ignore)", line)
        if m:
            rest = line[m.end() + len(f"{tool}-ignore") :]
            words = rest.strip().removesuffix("*/").split()
            if not rest.startswith(("-start", "-end", "-file")) and not rest.lstrip().startswith(":") and not (words and looks_like_check_id(words[0].rstrip(":"))):
                column = len(line[: m.end()].encode("utf-8", "surrogatepass"))
                size = len(line.encode("utf-8", "surrogatepass"))
                out.append({"start_byte": at + column, "end_byte": at + size, "line": number, "column": column + 1})
        at += len(line.encode("utf-8", "surrogatepass")) + 1
    return out


_SCHEMA = "file string, scope string, line_from int, line_to int, check_id string, line int, start_byte int, end_byte int, scoped boolean, text string"


def scan(files: DataFrame, tool: str = TOOL) -> DataFrame:
    """The directives of ``files`` (path, text); only texts that hold the tool's name are read by Python."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        for batch in batches:
            found = [{"file": p} | d for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in directives(t, tool)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    held = files.where(F.contains("text", F.lit(f"{tool}-"))).select("path", F.col("text").cast("string").alias("text"))
    return held.mapInArrow(rows, _SCHEMA)


def scan_broad(files: DataFrame, tool: str = TOOL) -> DataFrame:
    """file, start_byte, end_byte, line, column of directives that name no check."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"file": p} | d for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in broad(t, tool)]
            names = ["file", "start_byte", "end_byte", "line", "column"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], pa.string() if n == "file" else pa.int32()) for n in names], names)

    held = files.where(F.contains("text", F.lit(f"{tool}-ignore"))).select("path", F.col("text").cast("string").alias("text"))
    return held.mapInArrow(rows, "file string, start_byte int, end_byte int, line int, column int")
