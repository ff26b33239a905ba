"""A predicate language over files, compiled to column expressions.

    [require | forbid] predicate
    predicate = and, or, not, parentheses over comparisons and exists(path)
    comparison = subject (matches | == | != | in | imports [as type | as value] |
                 transitively imports | exports) operand
    operand = string | basename(x) | dirname(x) | file.path | operand + operand

A null subject reads '' for ==, and is unlike everything for !=; a null operand reads ''; a file
without imports or exports has none.  So every comparison is true or false, and a rule never loses a
file to a null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.paths import basename, dirname, is_glob, matches

MAX_DEPTH = 64
_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>==|!=|[()+,]))""")
_WORDS = {"and", "or", "not", "matches", "imports", "exports", "in", "transitively", "as"}


class PredicateError(ValueError):
    """The text is not a predicate, or asks for something unknown."""


@dataclass(frozen=True)
class Facts:
    """Columns that a predicate may ask for.  ``imports`` is an array of structs (specifier,
    resolved, type_only, and with ``named`` names, an array of structs with type_only); ``exports``
    of names; ``reachable`` of all paths reached by imports.  ``transitive`` gives, for a pattern,
    whether the file reaches an import of it (without it or ``reachable``: its own imports);
    ``exists`` gives a test for a path."""

    path: Column
    layer: Column | None = None
    imports: Column | None = None
    exports: Column | None = None
    reachable: Column | None = None
    exists: Callable[[Column], Column] | None = None
    transitive: Callable[[str], Column] | None = None
    named: bool = False


SUBJECTS = ("file", "file.path", "file.layer")
OPERATORS = ("matches", "==", "!=", "in", "imports", "exports", "transitively")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements that make ``a`` into ``b``."""
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        before, row[0] = row[0], k
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _like(word: str, known: tuple[str, ...]) -> str:
    """A hint at the nearest known word, if one is within two edits."""
    near = min(known, key=lambda k: (edit_distance(word, k), k))
    return f"; did you mean {near!r}?" if edit_distance(word, near) <= 2 else ""


def _named(value: Column, pattern: str) -> Column:
    return matches(value, pattern) if is_glob(pattern) else value == F.lit(pattern)


def _any(values: Column, test: Callable[[Column], Column]) -> Column:
    """Whether any element passes; none of a null array does."""
    return F.coalesce(F.exists(values, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


class _Parser:
    def __init__(self, source: str, facts: Facts) -> None:
        self._facts, self._at, self._depth = facts, 0, 0
        self._tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise PredicateError(f"unexpected {source[at : at + 10]!r} at {at}")
            self._tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()

    def _peek(self) -> str:
        return self._tokens[self._at][1] if self._at < len(self._tokens) else ""

    def _take(self, wanted: str | None = None) -> tuple[str, str]:
        if self._at >= len(self._tokens) or (wanted is not None and self._peek() != wanted):
            raise PredicateError(f"expected {wanted or 'more'}, found {self._peek() or 'the end'!r}")
        self._at += 1
        return self._tokens[self._at - 1]

    def _accept(self, word: str) -> bool:
        if self._peek() == word and self._tokens[self._at][0] != "text":
            self._at += 1
            return True
        return False

    def top(self) -> tuple[str, Column]:
        kind = "forbid" if self._accept("forbid") else "require" if self._accept("require") else ""
        out = self._or()
        if self._at < len(self._tokens):
            raise PredicateError(f"unexpected {self._peek()!r}")
        return kind, out

    def _or(self) -> Column:
        self._depth += 1
        if self._depth > MAX_DEPTH:
            raise PredicateError("nested too deep")
        out = self._and()
        while self._accept("or"):
            out = out | self._and()
        self._depth -= 1
        return out

    def _and(self) -> Column:
        out = self._not()
        while self._accept("and"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        return ~self._atom() if self._accept("not") else self._atom()

    def _atom(self) -> Column:
        if self._accept("("):
            out = self._or()
            self._take(")")
            return out
        kind, name = self._take()
        if kind != "name" or name in _WORDS:
            raise PredicateError(f"a predicate cannot start with {name!r}")
        if name == "exists":
            self._take("(")
            path = self._operand()
            self._take(")")
            return F.coalesce(self._need("exists", self._facts.exists)(F.coalesce(path, F.lit(""))), F.lit(False))
        return self._comparison(name)

    def _need(self, what: str, found):  # noqa: ANN001, ANN202
        if found is None:
            raise PredicateError(f"there are no facts for {what}")
        return found

    def _subject(self, name: str) -> Column:
        if name in ("file", "file.path"):
            return self._facts.path
        if name == "file.layer":
            return self._need(name, self._facts.layer)
        raise PredicateError(f"unknown subject {name!r}{_like(name, SUBJECTS)}")

    def _string(self) -> str:
        kind, text = self._take()
        if kind != "text":
            raise PredicateError(f"a string is needed, not {text!r}")
        return text[1:-1]

    def _comparison(self, name: str) -> Column:
        subject = self._subject(name)
        _, op = self._take()
        text = F.coalesce(subject, F.lit(""))
        if op == "matches":
            return F.coalesce(matches(subject, self._string()), F.lit(False))
        if op == "==":
            return text == F.coalesce(self._operand(), F.lit(""))
        if op == "!=":
            return subject.isNull() | (text != F.coalesce(self._operand(), F.lit("")))
        if op == "in":
            return self._need("layers", self._facts.layer).eqNullSafe(F.coalesce(self._operand(), F.lit("")))
        if op == "transitively":
            self._take("imports")
            pattern = self._string()
            if self._facts.transitive is not None:
                return F.coalesce(self._facts.transitive(pattern), F.lit(False))
            if self._facts.reachable is not None:
                return _any(self._facts.reachable, lambda p: _named(p, pattern))
            return self._imports(pattern, "")
        if op == "imports":
            kind = self._take()[1] if self._accept("as") else ""
            if kind not in ("", "type", "value"):
                raise PredicateError(f"imports as {kind!r} is unknown{_like(kind, ('type', 'value'))}")
            return self._imports(self._string(), kind)
        if op == "exports":
            pattern = self._string()
            return _any(self._need("exports", self._facts.exports), lambda n: _named(n, pattern))
        raise PredicateError(f"unknown operator {op!r}{_like(op, OPERATORS)}")

    def _imports(self, pattern: str, kind: str) -> Column:
        """An import of the specifier or the resolved path; as type, if the statement or one of its
        names is for types; as value, if the statement is not and it has no names or one for values."""

        def hit(x: Column) -> Column:
            found = F.coalesce(_named(x["specifier"], pattern), F.lit(False)) | F.coalesce(_named(x["resolved"], pattern), F.lit(False))
            typed = F.coalesce(x["type_only"], F.lit(False))
            if kind == "type":
                names = _any(x["names"], lambda n: n["type_only"]) if self._facts.named else F.lit(False)
                return found & (typed | names)
            if kind == "value":
                names = (F.coalesce(F.size(x["names"]), F.lit(0)) <= 0) | _any(x["names"], lambda n: ~n["type_only"]) if self._facts.named else F.lit(True)
                return found & ~typed & names
            return found

        return _any(self._need("imports", self._facts.imports), hit)

    def _operand(self) -> Column:
        out = self._term()
        while self._accept("+"):
            out = F.concat(out, self._term())
        return out

    def _term(self) -> Column:
        kind, text = self._take()
        if kind == "text":
            return F.lit(text[1:-1])
        if text in ("basename", "dirname"):
            self._take("(")
            inner = self._operand()
            self._take(")")
            return basename(inner) if text == "basename" else dirname(inner)
        if kind == "name":
            return self._subject(text)
        raise PredicateError(f"unexpected {text!r}")


def compile_predicate(source: str, facts: Facts) -> tuple[str, Column]:
    """("require" | "forbid" | "", condition)."""
    return _Parser(source, facts).top()


def violation(rule: str, facts: Facts, when: str | None = None) -> Column:
    """Whether a file breaks the rule: it lacks what is required (or stated bare), or has what is
    forbidden, where ``when`` holds."""
    kind, holds = compile_predicate(rule, facts)
    broken = holds if kind == "forbid" else ~holds
    return compile_predicate(when, facts)[1] & broken if when else broken
