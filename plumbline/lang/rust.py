"""Places of a Rust source that rules ask for, outside of tests: unwrap calls, macros that stop the
program, public items without a doc comment."""

from __future__ import annotations

import re
from typing import Any

from plumbline.lang.lexer import Places, Token, partners

_TOKEN = re.compile(
    r"""
    (?P<blank>\s+)
  | (?P<comment>//[^\n]*)
  | (?P<open>/\*)
  | (?P<string>b?r(?P<hash>\#*)".*?"(?P=hash)|b?c?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')
  | (?P<name>'?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)
  | (?P<number>\d[\w.]*)
  | (?P<mark>::|->|=>|.)
    """,
    re.X | re.S,
)
_ITEMS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait"}
_BEFORE_ITEM = {"async", "const", "unsafe", "extern", "default"}


def tokens(text: str) -> tuple[list[Token], list[Token]]:
    out: list[Token] = []
    comments: list[Token] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup if m["string"] is None else "string", m.end()
        if kind == "open":  # block comments nest
            depth = 1
            while depth and end < len(text):
                step = re.compile(r"/\*|\*/").search(text, end)
                if not step:
                    end = len(text)
                    break
                depth += 1 if step[0] == "/*" else -1
                end = step.end()
            comments.append(Token("comment", text[at:end], at, end))
        elif kind == "comment":
            comments.append(Token("comment", m[0], at, end))
        elif kind != "blank":
            out.append(Token(kind, m[0], at, end))
        at = end
    return out, comments


def facts(path: str, text: str) -> dict[str, Any]:
    toks, comments = tokens(text)
    pair, places = partners(toks), Places(text)
    opened = [k for k, t in enumerate(toks) if t.kind == "mark" and t.text in ("(", "[", "{", ")", "]", "}") and k not in pair]
    if opened:
        return {"error": f"{toks[opened[0]].text!r} has no partner"}
    texts = [t.text if t.kind != "string" else '""' for t in toks]
    inside = _test_ranges(toks, texts, pair)
    tested = lambda at: any(a <= at < z for a, z in inside)
    docs = {c.end: c for c in comments}
    marks: list[dict[str, Any]] = []
    add = lambda kind, k, detail: None if tested(toks[k].start) else marks.append({"kind": kind, "detail": detail, "span": places.span(toks[k].start, toks[k].end)})
    for k, t in enumerate(toks):
        if t.kind != "name":
            continue
        if t.text == "unwrap" and k and texts[k - 1] == "." and texts[k + 1 : k + 2] == ["("]:
            add("rust_unwrap", k, "unwrap")
        elif t.text in ("todo", "unimplemented") and texts[k + 1 : k + 2] == ["!"]:
            add("rust_stop", k, t.text)
        elif t.text == "pub" and k + 1 < len(toks) and texts[k + 1] != "(":
            at = k + 1
            while texts[at : at + 1] and (texts[at] in _BEFORE_ITEM or toks[at].kind == "string") and not (texts[at] == "const" and texts[at + 1 : at + 2] not in (["fn"], ["unsafe"], ["async"])):
                at += 1
            if at + 1 < len(toks) and texts[at] in _ITEMS and not _documented(text, toks, texts, pair, k, docs):
                add("rust_pub", at + 1, f"{_ITEMS[texts[at]]} {texts[at + 1]}")
    return {"marks": marks}


def _attributes(texts: list[str], pair: dict[int, int], k: int) -> list[tuple[int, int]]:
    """Attributes right before token ``k``, nearest first."""
    out = []
    k -= 1
    while k > 0 and texts[k] == "]" and k in pair and texts[pair[k] - 1] == "#":
        out.append((pair[k] - 1, k))
        k = pair[k] - 2
    return out


def _documented(text: str, toks: list[Token], texts: list[str], pair: dict[int, int], k: int, docs: dict[int, Token]) -> bool:
    first = k
    for a, z in _attributes(texts, pair, k):
        if texts[a + 2] == "doc":
            return True
        first = a
    floor = toks[first - 1].end if first else 0
    ends = [toks[k].start] + [toks[a].start for a, _ in _attributes(texts, pair, k)]
    for end in ends:  # comments above the item and above each of its attributes
        at = end
        while True:
            bare = text[:at].rstrip() if at > floor else ""
            c = docs.get(len(bare)) if bare else None
            if c is None or c.start < floor:
                break
            if (c.text.startswith("///") and not c.text.startswith("////")) or (c.text.startswith("/**") and not c.text.startswith("/***") and c.text != "/**/"):
                return True
            at = c.start
    return False


def _test_ranges(toks: list[Token], texts: list[str], pair: dict[int, int]) -> list[tuple[int, int]]:
    """Places of test functions, and of items that exist in tests only."""
    out = []
    for k, t in enumerate(toks):
        if t.kind != "name" or t.text not in ("fn", "mod", "impl"):
            continue
        first = k
        while first and (texts[first - 1] in _BEFORE_ITEM or texts[first - 1] == "pub" or (texts[first - 1] == ")" and pair.get(first - 1, 0) and texts[pair[first - 1] - 1] == "pub")):
            first = pair[first - 1] - 1 if texts[first - 1] == ")" else first - 1
        held = [texts[a + 2 : z] for a, z in _attributes(texts, pair, first)]
        test = any((x[:1] == ["cfg"] and "test" in x[1:]) or (t.text == "fn" and x[:1] == ["test"]) for x in held)
        if test or (t.text == "mod" and texts[k + 1 : k + 2] == ["tests"]):
            body = next((j for j in range(k, len(toks)) if texts[j] in ("{", ";")), None)
            if body is not None and texts[body] == "{":
                out.append((t.start, toks[pair[body]].end))
    return out
