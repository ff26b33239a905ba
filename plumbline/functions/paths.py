"""Globs in two dialects, and functions of paths and texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, literal_separator: bool = False) -> str:
    """An anchored Java regular expression.  Policies let ``*`` cross separators; public-API
    lists, overrides and context suppressions do not (``literal_separator``)."""
    one, many = ("[^/]", "[^/]*") if literal_separator else (".", ".*")
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "*":
            out += many
        elif c == "?":
            out += one
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            body = glob[k + 1 : end]
            barred = body[0] in "!^"
            # a class of the glob has ranges only: what else a Java class would read is escaped
            out += ("[^" if barred else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if barred else body) + "]"
            k = end
        elif c == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out += "(?:" + "|".join(glob_regex(x, literal_separator)[6:-2] for x in glob[k + 1 : end].split(",")) + ")"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return "(?s)\\A" + out + "\\z"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def literal_prefix(glob: str) -> int:
    """How many characters come before the first special one."""
    return len(re.match(r"[^*?\[{]*", glob)[0])


def matches(path: Column, glob: str, literal_separator: bool = False) -> Column:
    return path.rlike(glob_regex(glob, literal_separator))


def has_prefix(path: Column, prefix: str) -> Column:
    """Directory-bounded: the prefix itself or below it."""
    bare = prefix.rstrip("/")
    return (path == bare) | path.startswith(bare + "/")


def basename(path: Column) -> Column:
    """The last part, extension included."""
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def signature(text: Column) -> Column:
    """SHA-256 of the text with runs of blanks as one space, none at the ends."""
    return F.sha2(F.btrim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), 256)


def category(check_id: Column) -> Column:
    return F.split_part(check_id, F.lit("."), F.lit(1))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def layer_of(path: Column, layers: dict[str, list[str]]) -> Column:
    """The layer whose matching glob has the longest literal prefix, ties to the smaller name; a
    layer with a matching ``!`` glob is out.  Null if none matches.  One expression, no join."""
    known = []
    for name, globs in layers.items():
        barred = [g[1:] for g in globs if g.startswith("!")]
        for g in globs:
            if not g.startswith("!"):
                test = matches(path, g)
                for b in barred:
                    test = test & ~matches(path, b)
                known.append((-literal_prefix(g), name, test))
    out = F.lit(None).cast("string")
    for _, name, test in sorted(known, key=lambda x: x[:2], reverse=True):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def classified(path: Column, parts: list[str] | tuple[str, ...]) -> Column:
    """Whether the path, with forward slashes, holds one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(normal(path), F.lit(p))
    return out


def normal(path: Column) -> Column:
    """Forward slashes, no ``./`` in front, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A(?:\./)+", ""), r"(?<=.)/+\z", "")


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; one that is not there stays as it is."""
    bare = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(normal(path).startswith(bare), F.substr(normal(path), F.lit(len(bare) + 1))).otherwise(normal(path))


def stem(path: Column) -> Column:
    """The last part without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*\z", "")


def from_template(template: str, path: Column) -> Column:
    """``{name}`` in a template stands for the path's stem; the result lies in the path's folder."""
    name = F.replace(F.lit(template), F.lit("{name}"), stem(path))
    return F.when(dirname(path) == "", name).otherwise(F.concat(dirname(path), F.lit("/"), name))


def first_layer(path: Column, layers: dict[str, list[str]]) -> Column:
    """The layer of the predicate language: the first, by name, one of whose globs matches."""
    out = F.lit(None).cast("string")
    for name in sorted(layers, reverse=True):
        for g in layers[name]:
            out = F.when(matches(path, g), F.lit(name)).otherwise(out)
    return out


def public(path: Column, entries: list[str], pointers: Column | None = None) -> Column:
    """Whether a path is of the public surface: named by an entry, matched by a glob in which ``*``
    stops at slashes, or, without its extension, among ``pointers`` (an array, from the manifest)."""
    bare = normal(path)
    out = F.lit(False)
    for e in entries:
        if e.startswith("package.json:"):
            continue
        e = re.sub(r"\A(?:\./)+", "", e)
        out = out | (matches(bare, e.replace("\\", "/"), True) if is_glob(e) else bare == F.lit(e))
    if pointers is not None:
        out = out | F.coalesce(F.array_contains(pointers, F.regexp_replace(bare, r"(?<=[^/])\.[^./]*\z", "")), F.lit(False))
    return out
