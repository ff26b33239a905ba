"""Tokens of TypeScript and JavaScript sources.

One pattern takes the next token; what it cannot know from the text alone (whether a slash starts a
regular expression, where a template goes on after its ``${...}``) comes from the tokens before.
A quote without its partner on the line is punctuation, so that prose in markup does not swallow
the rest of a file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""
    \s*+(?:
    (?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)
  | (?P<name>[\#@]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)
  | (?P<number>0[xXbBoO][0-9A-Fa-f_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
  | (?P<string>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")
  | (?P<mark>=>|\.\.\.|\?\.(?!\d)|\?\?=|\?\?|===|!==|==|!=|<=|>=|&&=|\|\|=|&&|\|\||\+\+|--|\*\*=|\*\*|<<=|[-+*/%&|^]=|.)
    )
    """,
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
#: After these words a slash starts a regular expression.
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, mark, comment
    text: str
    start: int
    end: int


def tokens(text: str) -> tuple[list[Token], list[Token], list[str]]:
    """Tokens, comments, and what does not close."""
    out: list[Token] = []
    comments: list[Token] = []
    open_marks: list[str] = []
    faults: list[str] = []
    at, n = 0, len(text)
    pairs = {")": "(", "]": "[", "}": "{"}

    def chunk(start: int) -> int:
        """The rest of a template up to its end or the next ``${``."""
        end = _CHUNK.match(text, start + 1).end()
        if text.startswith("${", end):
            open_marks.append("${")
            end += 2
        elif end < n:
            end += 1
        else:
            faults.append("a template does not end")
        out.append(Token("template", text[start:end], start, end))
        return end

    match = _TOKEN.match  # blanks before a token are part of the match
    while m := match(text, at):
        kind = m.lastgroup
        start, at = m.span(kind)
        if kind == "comment":
            comments.append(Token(kind, m[kind], start, at))
            continue
        if kind == "mark":
            c = text[start]
            if c == "`":
                at = chunk(start)
                continue
            if c == "}" and open_marks and open_marks[-1] == "${":
                open_marks.pop()
                at = chunk(start)
                continue
            if c == "/" and _starts_operand(out):
                r = _REGEX.match(text, start)
                if r:
                    at = r.end()
                    out.append(Token("regex", r[0], start, at))
                    continue
            if c in "([{":
                open_marks.append(c)
            elif c in pairs:
                if open_marks and open_marks[-1] == pairs[c]:
                    open_marks.pop()
                else:
                    faults.append(f"unexpected {c!r}")
        out.append(Token(kind, text[start:at], start, at))
    faults += [f"{c!r} does not close" for c in open_marks]
    return out, comments, faults


def _starts_operand(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "mark":
        return last.text not in (")", "]", "}", "++", "--")
    if last.kind == "template":
        return last.text.endswith("${")
    return last.kind == "name" and last.text in _BEFORE_OPERAND


def partners(toks: list[Token]) -> dict[int, int]:
    """By index of an opening bracket the index of its closing one, and the other way round."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    for k, t in enumerate(toks):
        if t.kind != "mark":
            continue
        if t.text in ("(", "[", "{"):
            stack.append((t.text, k))
        elif t.text in pairs:
            while stack:
                mark, j = stack.pop()
                if mark == pairs[t.text]:
                    out[j], out[k] = k, j
                    break
    return out


class Places:
    """Byte offsets, lines and columns (from 1, in bytes) of places in a text."""

    def __init__(self, text: str) -> None:
        self._plain = text.isascii()
        if not self._plain:
            self._bytes = [0]
            total = 0
            for c in text:
                total += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                self._bytes.append(total)
        self._lines = [0] + [self.byte(m.end()) for m in re.finditer("\n", text)]

    def byte(self, at: int) -> int:
        return at if self._plain else self._bytes[at]

    def span(self, start: int, end: int) -> dict[str, int]:
        a = self.byte(start)
        line = bisect_right(self._lines, a)
        return {"start_byte": a, "end_byte": self.byte(end), "line": line, "column": a - self._lines[line - 1] + 1}

    def line(self, at: int) -> int:
        return bisect_right(self._lines, self.byte(at))
