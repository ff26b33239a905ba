"""Words of prose that tell a spelling dialect: in comments and prose-like strings of programs, and in
Markdown outside of code, links and front matter."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any

from plumbline.lang.lexer import Places

if TYPE_CHECKING:
    from plumbline.lang.typescript import Source

#: British spellings and the American ones for them.
SPELLINGS = dict(
    pair.split()
    for pair in (
        "analyse analyze;analysed analyzed;analyser analyzer;analysing analyzing;artefact artifact;artefacts artifacts;behaviour behavior;behaviours behaviors;"
        "cancelled canceled;cancelling canceling;catalogue catalog;catalogues catalogs;categorise categorize;categorised categorized;categorises categorizes;"
        "centre center;centred centered;colour color;coloured colored;colours colors;customise customize;customised customized;customises customizes;"
        "defence defense;deserialise deserialize;deserialised deserialized;deserialises deserializes;favourite favorite;grey gray;initialise initialize;"
        "initialised initialized;initialising initializing;initialises initializes;labelled labeled;labelling labeling;labour labor;maximise maximize;"
        "maximised maximized;maximises maximizes;minimise minimize;minimised minimized;minimises minimizes;modelling modeling;neighbour neighbor;"
        "neighbours neighbors;normalise normalize;normalised normalized;normalising normalizing;normalises normalizes;normalisation normalization;"
        "optimise optimize;optimised optimized;optimises optimizes;optimisation optimization;organise organize;organised organized;organises organizes;"
        "organisation organization;prioritise prioritize;prioritised prioritized;prioritises prioritizes;recognise recognize;recognised recognized;"
        "recognises recognizes;serialise serialize;serialised serialized;serialises serializes;serialisation serialization;summarise summarize;"
        "summarised summarized;summarises summarizes;synchronise synchronize;synchronised synchronized;synchronises synchronizes;travelling traveling;"
        "utilise utilize;utilises utilizes;visualise visualize;visualised visualized;visualises visualizes"
    ).split(";")
)
_AMERICAN = {v: k for k, v in SPELLINGS.items()}
_WORD = re.compile(r"[A-Za-z0-9_]+")


def dialect_of(word: str) -> tuple[str, str] | None:
    """("british" or "american", the other spelling)."""
    low = word.lower()
    if low in SPELLINGS:
        return "british", SPELLINGS[low]
    return ("american", _AMERICAN[low]) if low in _AMERICAN else None


def _words(text: str, a: int, z: int, places: Places, out: list[dict[str, Any]]) -> None:
    for m in _WORD.finditer(text, a, z):
        if dialect_of(m[0]):
            out.append({"word": m[0], "span": places.span(m.start(), m.end())})


def program_words(source: Source) -> list[dict[str, Any]]:
    """In comments, and in strings with a blank that are not the value of a tag's attribute."""
    out: list[dict[str, Any]] = []
    for c in source.comments:
        _words(source.text, c.start, c.end, source.places, out)
    for k, t in enumerate(source.toks):
        if t.kind in ("string", "template") and " " in t.text and not (t.kind == "string" and k and source.toks[k - 1].text == "="and source._in_tag(k)):
            _words(source.text, t.start, t.end, source.places, out)
    return sorted(out, key=lambda w: w["span"]["start_byte"])


_FENCE = re.compile(r"\s*(`{3,}|~{3,})(.*)")
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)|\]\([^)\n]*\)|</?[A-Za-z][^>]*>|<[a-z]+://[^>]*>|\S+://\S*")


def prose_spans(text: str) -> list[tuple[int, int]]:
    """Places of prose: not in front matter, fenced blocks, code spans, link targets, tags, addresses,
    definitions of references, or module lines."""
    out: list[tuple[int, int]] = []
    lines = text.splitlines(keepends=True)
    first = 0
    if text.startswith(("---\n", "---\r\n")):
        close = next((k for k, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), None)
        first = close + 1 if close is not None else 0
    at = sum(map(len, lines[:first]))
    fence = ""
    for line in lines[first:]:
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif not re.match(r"\s{0,3}\[[^\]]+\]:|(import|export)\s", line):
            start = 0
            for c in _CODE.finditer(line):
                if start < c.start():
                    out.append((at + start, at + c.start()))
                start = c.end()
            if start < len(line):
                out.append((at + start, at + len(line)))
        at += len(line)
    return out


def markdown_words(text: str) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = []
    places = Places(text)
    for a, z in prose_spans(text):
        _words(text, a, z, places, out)
    return out


def leading_case(model: str, word: str) -> str:
    """``word`` with a capital if ``model`` starts with one."""
    return word[:1].upper() + word[1:] if model[:1].isascii() and model[:1].isupper() else word
