"""Functions of texts, spans and ids as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a body longer than this is cut, with a mark.
MOST_CHARS = 8_000
CUT_MARK = "\n... (truncated)"


def truncated(body: Column, most: int = MOST_CHARS) -> Column:
    return F.when(F.char_length(body) > most, F.concat(F.left(body, F.lit(most)), F.lit(CUT_MARK))).otherwise(body)


def looks_like_check_id(text: Column) -> Column:
    """Category.Name: a letter first, then letters, digits, dots and underscores, with one dot at least."""
    return F.coalesce(F.contains(text, F.lit(".")) & text.rlike(r"\A[A-Za-z][A-Za-z0-9._]*\z"), F.lit(False))


def leading_case(model: Column, word: Column) -> Column:
    """``word`` with a capital in front if ``model`` has one of A to Z."""
    return F.when(model.rlike(r"\A[A-Z]"), F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))).otherwise(word)


def docs_url(check_id: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), check_id)


def version(text: Column) -> Column:
    """(major, minor) of ``MAJOR.MINOR``; null for anything else."""
    ok = text.rlike(r"\A[0-9]{1,9}\.[0-9]{1,9}\z")
    part = lambda k: F.split_part(text, F.lit("."), F.lit(k)).cast("int")
    return F.when(ok, F.struct(part(1).alias("major"), part(2).alias("minor")))


def civil_date(days: Column) -> Column:
    """The date of a number of days since 1970-01-01, as YYYY-MM-DD."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def config_hash(options: Column) -> Column:
    """Of a map of options: the same whatever their order."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(options))), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays taken as sets; two empty ones are 0."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ > 0, F.size(F.array_intersect(a, b)) / all_).otherwise(F.lit(0.0))


def line_column(text: Column, byte: Column) -> Column:
    """(line, column) of a byte offset, both from 1, the column in bytes; an offset beyond the end is
    at the end."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    before = F.substr(raw, F.lit(1), F.least(byte, F.octet_length(raw)))
    # breaks are counted in the bytes themselves, so that a cut inside a character does no harm
    shown = F.hex(before)
    pairs = F.regexp_replace(shown, "(..)", "$1 ")
    upto = F.length(F.regexp_replace(F.regexp_replace(pairs, "0A ", "!"), "[^!]", ""))
    last = F.element_at(F.split(pairs, "0A "), -1)
    return F.struct((upto + 1).cast("int").alias("line"), (F.length(last) / 3 + 1).cast("int").alias("column"))


def header(text: Column) -> Column:
    """A function's text before the first brace outside of parentheses; all of it if there is none.

    Parentheses that close are taken away from the inside, a level at a time, up to eight deep; what
    is left before the brace tells how far the header goes."""
    plain = text
    for _ in range(8):
        plain = F.regexp_replace(plain, r"\(([^(){]*|[^()]*)\)", "\ue000$1\ue001")
    return F.btrim(_before_brace(plain))


def _before_brace(plain: Column) -> Column:
    """Up to the first brace that no marked parenthesis holds."""
    parts = F.split(plain, r"\{")
    depth = lambda x: F.length(F.regexp_replace(x, "[^\ue000]", "")) - F.length(F.regexp_replace(x, "[^\ue001]", ""))
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("depth"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["depth"] + depth(x)
        joined = F.concat(acc["held"], F.when(acc["held"] == "", F.lit("")).otherwise(F.lit("{")), x)
        return F.when(acc["done"], acc).otherwise(F.struct(joined.alias("held"), now.alias("depth"), (now <= 0).alias("done")))

    held = F.aggregate(parts, start, step, lambda acc: acc["held"])
    return F.translate(held, "\ue000\ue001", "()")


def display_width(text: str) -> int:
    """Columns a text takes: 2 for wide characters, 0 for marks that join the one before."""
    out = 0
    for c in text:
        if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me"):
            continue
        out += 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return out


def _class_of(test: Callable[[str], bool]) -> str:
    """A Java character class of all characters that pass."""
    out, first = [], None
    for k in range(0x110000 + 1):
        hit = k < 0x110000 and not 0xD800 <= k < 0xE000 and test(chr(k))
        if hit and first is None:
            first = k
        elif not hit and first is not None:
            out.append(f"\\x{{{first:X}}}-\\x{{{k - 1:X}}}")
            first = None
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def _width_classes() -> tuple[str, str]:
    """Characters two columns wide, and those of no width."""
    none = lambda c: bool(unicodedata.combining(c)) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me")
    return _class_of(lambda c: unicodedata.east_asian_width(c) in "WF" and not none(c)), _class_of(none)


def width_of(text: Column) -> Column:
    """``display_width`` as a column."""
    wide, none = _width_classes()
    return F.when(text.rlike(r"\A[\x20-\x7e]*\z"), F.char_length(text)).otherwise(F.char_length(text) + F.regexp_count(text, F.lit(wide)) - F.regexp_count(text, F.lit(none)))
