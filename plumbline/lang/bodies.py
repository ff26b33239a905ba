"""What functions and classes do inside: how deep they nest, what they change, what they never read."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from plumbline.lang.typescript import Source

_WRITES = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="}
#: Methods of arrays that change them; methods whose callback should compute only.
MUTATING = {"push", "pop", "shift", "unshift", "splice", "sort", "reverse", "fill", "copyWithin"}
MAPPING = {"map", "filter"}


def cognitive(s: Source, a: int, z: int, name: str, inner: list[tuple[int, int]]) -> int:
    """Nesting-weighted breaks between the braces ``a`` and ``z``: a break in the flow counts one and its
    depth, an else one, a run of one logical operator one, a call of itself one; functions inside
    are left to their own count."""
    total, nested, runs = 0, [], [""]
    skip = dict(inner)
    recursive = False
    k = a + 1
    while k < z:
        if k in skip:
            k = skip[k] + 1
            continue
        t = s.toks[k]
        depth = sum(nested)
        if t.kind == "mark":
            if t.text in ("&&", "||", "??"):
                total += runs[-1] != t.text
                runs[-1] = t.text
            elif t.text == "?" and not s._is(k + 1, ":", ",", ")"):
                total += 1 + depth
            elif t.text in (";", ",", "=", "{", "}", "?", ":"):
                runs[-1] = ""
            if t.text == "{":
                before = k - 1
                if s._is(before, ")") and before in s.pair:
                    before = s.pair[before] - 1
                nested.append(s._is(before, "if", "for", "while", "switch", "catch", "else", "do", "await"))
            elif t.text == "}" and nested:
                nested.pop()
            elif t.text in ("(", "["):
                runs.append("")
            elif t.text in (")", "]") and len(runs) > 1:
                runs.pop()
        elif t.kind == "name" and not s._is(k - 1, ".", "?."):
            if t.text == "if":
                total += 1 if s._is(k - 1, "else") else 1 + depth
            elif t.text == "else":
                total += not s._is(k + 1, "if")
            elif t.text in ("for", "switch", "catch", "do"):
                total += 1 + depth
            elif t.text == "while" and not (s._is(k - 1, "}") and s._is(s.pair.get(k - 1, 0) - 1, "do")):
                total += 1 + depth
            elif name and t.text == name and s._is(k + 1, "("):
                recursive = True
        k += 1
    return total + recursive


def _parameters(s: Source, params: int) -> list[tuple[int, list[str]]]:
    """(token of the name, texts of the type) of parameters that are plain names."""
    if params < 0:
        return []
    out, at, end = [], params + 1, s.pair[params]
    while at < end:
        while s._is(at, "public", "private", "protected", "readonly", "override"):
            at += 1
        first, z = at, at
        while z < end and not s._is(z, ","):
            if s._is(z, "<"):
                depth = 0
                while z < end:
                    depth += s._is(z, "<") - s._is(z, ">")
                    if depth == 0:
                        break
                    z += 1
            z = s.pair[z] if s._is(z, "(", "[", "{") and z in s.pair else z
            z += 1
        if s.toks[first].kind == "name":
            typed = first + 1 + s._is(first + 1, "?")
            kind = [t.text for t in s.toks[typed + 1 : z]] if s._is(typed, ":") else []
            out.append((first, kind[: kind.index("=")] if "=" in kind else kind))
        at = z + 1
    return out


def _changes(s: Source, k: int) -> str:
    """How the name at token ``k`` is changed there: itself, a part of it, by a method, or not."""
    if s._is(k - 1, ".", "?.", "let", "const", "var"):
        return ""
    at, member = k + 1, ""
    while True:
        if s._is(at, ".", "?.") and at + 1 < len(s.toks):
            member, at = s.toks[at + 1].text, at + 2
        elif s._is(at, "[") and at in s.pair:
            member, at = "[]", s.pair[at] + 1
        else:
            break
    if at < len(s.toks) and s.toks[at].kind == "mark" and (s.toks[at].text in _WRITES or s.toks[at].text in ("++", "--")):
        return "mutated" if member else "reassigned"
    if s._is(k - 1, "++", "--") or s._is(k - 1, "delete"):
        return "mutated" if member else "reassigned"
    return "method" if member in MUTATING and s._is(at, "(") else ""


def function_marks(s: Source, a: int, z: int, params: int) -> list[tuple[str, int, int, str]]:
    """(kind, first token, last token, detail) of a function's parameters and locals."""
    out: list[tuple[str, int, int, str]] = []
    for first, kind in _parameters(s, params):
        name = s.toks[first].text
        uses = [k for k in range(a + 1, z) if s.toks[k].kind == "name" and s.toks[k].text == name and not s._is(k - 1, ".", "?.")]
        changed = [(k, _changes(s, k)) for k in uses]
        for k, how in changed:
            if how in ("reassigned", "mutated"):
                out.append(("mutated", k, k, f"{name} {how}"))
        listed = kind[-2:] == ["[", "]"] or kind[:2] == ["Array", "<"]
        if listed and "readonly" not in kind and uses and not any(how for _, how in changed):
            shown = "readonly " + "".join(kind) if kind[-2:] == ["[", "]"] else "Readonly" + "".join(kind)
            out.append(("readonly", first, first, f"{name} {shown}"))
    return out


def unused_locals(s: Source, bodies: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """Names that a declaration inside a function binds and nothing reads; by name, over the file."""
    counts: dict[str, int] = {}
    written: dict[str, int] = {}
    for k, t in enumerate(s.toks):
        if t.kind == "name" and not s._is(k - 1, ".", "?.") and not (s._is(k + 1, ":") and s._is(k - 1, "{", ",") and not s._is(k - 2, "?")):
            counts[t.text] = counts.get(t.text, 0) + 1
            if s._is(k + 1, "=") and not s._is(k - 1, "let", "const", "var") and s._is(k - 1, ";", "{", "}"):
                written[t.text] = written.get(t.text, 0) + 1
    out = []
    for k, t in enumerate(s.toks):
        if t.kind == "name" and s._is(k - 1, "let", "const", "var") and not t.text.startswith("_") and any(a < k < z for a, z in bodies):
            if counts.get(t.text, 0) - written.get(t.text, 0) <= 1 and not s._is(k + 1, "of", "in"):
                out.append(("unused", k, k, t.text))
    return out


def loops(s: Source) -> list[tuple[str, int, int, str]]:
    """Loops over values whose body is one push, perhaps under one condition."""
    out = []
    for k, t in enumerate(s.toks):
        if t.text != "for" or t.kind != "name" or not s._is(k + 1, "(") or k + 1 not in s.pair:
            continue
        close = s.pair[k + 1]
        if not any(s._is(j, "of") for j in range(k + 2, close)) or not s._is(close + 1, "{") or close + 1 not in s.pair:
            continue
        at, end, method = close + 2, s.pair[close + 1], "map"
        if s._is(at, "if") and s._is(at + 1, "(") and at + 1 in s.pair:
            at, method = s.pair[at + 1] + 1, "filter"
            if s._is(at, "{") and at in s.pair and s.pair[at] + 1 == end:
                at, end = at + 1, s.pair[at]
        if at + 3 < end and s.toks[at].kind == "name" and s._is(at + 1, ".") and s._is(at + 2, "push") and s._is(at + 3, "(") and at + 3 in s.pair:
            last = s.pair[at + 3]
            if last + 1 + s._is(last + 1, ";") == end and not any(s._is(j, ",", "...", "await") for j in range(at + 4, last)):
                out.append(("loop", k, s.pair[close + 1], f"{s.toks[at].text} {method}"))
    return out


def map_effects(s: Source) -> list[tuple[str, int, int, str]]:
    """Callbacks of map and filter that change what is not theirs, or write to the console."""
    out = []
    for k, t in enumerate(s.toks):
        if t.kind != "name" or t.text not in MAPPING or not s._is(k - 1, ".", "?.") or not s._is(k + 1, "(") or k + 1 not in s.pair:
            continue
        a, z = k + 1, s.pair[k + 1]
        arrow = next((j for j in range(a, z) if s._is(j, "=>")), None)
        if arrow is None and not s._is(a + 1, "function"):
            continue
        head = range(a, arrow) if arrow is not None else range(a, s.pair.get(a + 2, a + 3))
        own = {s.toks[j].text for j in head if s.toks[j].kind == "name"}
        own |= {s.toks[j].text for j in range(a, z) if s._is(j - 1, "let", "const", "var")}
        for j in range(a, z):
            x = s.toks[j]
            if x.kind == "name" and not s._is(j - 1, ".", "?.") and ((x.text == "console" and s._is(j + 1, ".")) or (x.text not in own and x.text != "this" and _changes(s, j))):
                out.append(("map_effect", k, z, t.text))
                break
    return out


def hidden_state(s: Source, bodies: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, str]]:
    """Exported functions (body, end, parameters, first token) that read a variable of the module that is
    assigned again somewhere."""
    top = {s.toks[k + 1].text for k, t in enumerate(s.toks) if t.text in ("let", "var") and t.kind == "name" and k + 1 < len(s.toks) and not any(a < k < z for a, z, _, _ in bodies)}
    state = {s.toks[k].text for k in range(len(s.toks)) if s.toks[k].kind == "name" and s.toks[k].text in top and _changes(s, k) == "reassigned"}
    out = []
    for a, z, params, first in bodies:
        lead = first
        while lead > 0 and s._is(lead - 1, "async", "default"):
            lead -= 1
        if not s._is(lead - 1, "export"):
            continue
        own = {s.toks[p].text for p, _ in _parameters(s, params)} | {s.toks[j].text for j in range(a, z) if s._is(j - 1, "let", "const", "var")}
        found = sorted({s.toks[j].text for j in range(a, z) if s.toks[j].kind == "name" and s.toks[j].text in state - own and not s._is(j - 1, ".", "?.")})
        if found:
            out.append(("hidden", first, first + 1, f"{s.toks[first + 1].text} {', '.join(found)}"))
    return out


def data_bags(s: Source) -> list[tuple[str, int, int, str]]:
    """Classes with fields only: no base, interface, decorator, method, accessor or static block, and a
    constructor, if any, that only takes fields over."""
    out = []
    for k, t in enumerate(s.toks):
        if t.text != "class" or t.kind != "name" or s._is(k - 1, ".", "?.") or k + 2 >= len(s.toks) or s.toks[k + 1].kind != "name" or not s._is(k + 2, "{") or k + 2 not in s.pair:
            continue
        lead = k - 1
        while s._is(lead, "export", "default", "abstract", "declare"):
            lead -= 1
        if lead >= 0 and (s._is(lead, ")") and s.pair.get(lead, 0) and s.toks[s.pair[lead] - 1].text.startswith("@") or s.toks[lead].text.startswith("@")):
            continue
        if _only_fields(s, k + 2):
            out.append(("data_bag", k, s.pair[k + 2], s.toks[k + 1].text))
    return out


def _only_fields(s: Source, brace: int) -> bool:
    at, end, fields = brace + 1, s.pair[brace], 0
    while at < end:
        if s.toks[at].text.startswith("@") or s._is(at, "get", "set") and s.toks[at + 1].kind == "name" or s._is(at, "static") and s._is(at + 1, "{"):
            return False
        if s._is(at, "constructor") and s._is(at + 1, "("):
            body = s.pair.get(at + 1, end) + 1
            if not s._is(body, "{") or body not in s.pair:
                return False
            j = body + 1
            while j < s.pair[body]:  # this.x = ...;
                if not (s._is(j, "this") and s._is(j + 1, ".") and s._is(j + 3, "=")):
                    return False
                while j < s.pair[body] and not s._is(j, ";"):
                    j = s.pair[j] if s._is(j, "(", "[", "{") and j in s.pair else j
                    j += 1
                j += 1
            fields += s.n_params(at + 1) > 0
            at = s.pair[body] + 1
            continue
        first = at
        while at < end and not s._is(at, ";"):
            if s._is(at, "(") and not any(s._is(j, "=", ":") for j in range(first, at)):
                return False  # a method
            if s._is(at, "=>") or s._is(at, "function"):
                return False  # behaviour held in a field
            at = s.pair[at] if s._is(at, "(", "[", "{") and at in s.pair else at
            if at + 1 < end and "\n" in s.text[s.toks[at].end : s.toks[at + 1].start] and not s._is(at, "=", ":", "|", "&", ",") and not s._is(at + 1, "=", "|", "&", "."):
                break
            at += 1
        fields += at > first or s.toks[first].kind == "name"
        at += 1
    return fields > 0


# ---------------------------------------------------------------- types that a file declares itself


def switches(s: Source) -> list[tuple[int, int, int, int, list[str], bool]]:
    """(first token, last token, first and last of the value, cases that are literals, has a default)."""
    out = []
    for k, t in enumerate(s.toks):
        if t.text != "switch" or t.kind != "name" or not s._is(k + 1, "(") or k + 1 not in s.pair:
            continue
        close = s.pair[k + 1]
        if not s._is(close + 1, "{") or close + 1 not in s.pair:
            continue
        at, end, cases, default = close + 2, s.pair[close + 1], [], False
        while at < end:
            if s._is(at, "case") and s._is(at + 2, ":") and (s.toks[at + 1].kind in ("string", "number") or s._is(at + 1, "true", "false")):
                cases.append(s._name(at + 1))
            elif s._is(at, "default") and s._is(at + 1, ":"):
                default = True
            at = s.pair[at] if s._is(at, "(", "[", "{") and at in s.pair else at
            at += 1
        out.append((k, end, k + 2, close - 1, cases, default))
    return out


def null_tests(s: Source) -> list[tuple[int, int, int, str, bool]]:
    """(first token, last token, token of the value, null or undefined, strict) of comparisons of a plain
    name with one of them."""
    out = []
    for k, t in enumerate(s.toks):
        if t.kind != "mark" or t.text not in ("==", "!=", "===", "!=="):
            continue
        for value, other in ((k - 1, k + 1), (k + 1, k - 1)):
            if s._is(other, "null", "undefined") and 0 <= value < len(s.toks) and s.toks[value].kind == "name" and not s._is(value, "null", "undefined", "this") and not s._is(value - 1, ".", "?.", "typeof") and not s._is(value + 1, ".", "?.", "(", "["):
                out.append((min(value, other), max(value, other), value, s.toks[other].text, len(t.text) == 3))
    return out


class Types:
    """The types of names, as far as a file says them: annotations and aliases of its own.  A name that is
    annotated in two ways has none."""

    def __init__(self, s: Source, params: list[int]) -> None:
        self._s = s
        self._aliases: dict[str, list[str]] = {}
        self._names: dict[str, list[str] | None] = {}
        for k, t in enumerate(s.toks):
            if t.kind != "name" or k + 2 >= len(s.toks) or s._is(k - 1, ".", "?."):
                continue
            if t.text == "type" and s.toks[k + 1].kind == "name" and s._is(k + 2, "="):
                self._aliases[s.toks[k + 1].text] = self._upto(k + 3)
            elif t.text in ("const", "let", "var") and s.toks[k + 1].kind == "name" and s._is(k + 2, ":"):
                self._annotate(s.toks[k + 1].text, self._upto(k + 3))
        for p in params:
            for first, kind in _parameters(s, p):
                optional = ["|", "undefined"] if s._is(first + 1, "?") else []
                self._annotate(s.toks[first].text, kind + optional if kind else [])

    def _annotate(self, name: str, kind: list[str]) -> None:
        self._names[name] = kind if self._names.get(name, kind) == kind and kind else None

    def _upto(self, k: int) -> list[str]:
        """The tokens of a type, up to what cannot go on."""
        out: list[str] = []
        s = self._s
        while k < len(s.toks) and not s._is(k, ";", "=", ",", ")", "}"):
            if out and "\n" in s.text[s.toks[k - 1].end : s.toks[k].start] and not s._is(k, "|", "&") and out[-1] not in ("|", "&"):
                break
            if s._is(k, "(", "[", "{") and k in s.pair:
                out += [t.text for t in s.toks[k : s.pair[k] + 1]]
                k = s.pair[k] + 1
                continue
            out.append(s.toks[k].text)
            k += 1
        return out

    def of(self, k: int) -> dict[str, Any] | None:
        """text, members (of a union of literals, else none), and whether null, undefined or anything is
        among the values of the name at token ``k``."""
        kind = self._names.get(self._s.toks[k].text)
        if not kind:
            return None
        out: dict[str, Any] = {"text": " ".join(kind), "members": [], "null": False, "undefined": False, "any": False}
        return out | {"members": out["members"] if self._parts(kind, out, set()) else []}

    def _parts(self, kind: list[str], out: dict[str, Any], seen: set[str]) -> bool:
        """Adds the parts of a union; whether all are literals."""
        literal = True
        parts: list[list[str]] = [[]]
        depth = 0
        for x in kind:
            depth += (x in ("(", "[", "{", "<")) - (x in (")", "]", "}", ">"))
            if x == "|" and depth == 0:
                parts.append([])
            else:
                parts[-1].append(x)
        for part in parts:
            x = part[0] if len(part) == 1 else ""
            if not part:
                continue
            if x in ("null", "undefined"):
                out[x] = True
                literal = False
            elif x in ("any", "unknown"):
                out["any"], literal = True, False
            elif x[:1] in "'\"" and x:
                out["members"].append(x[1:-1])
            elif x in ("true", "false") or x[:1].isdigit():
                out["members"].append(x)
            elif x in self._aliases and x not in seen:
                literal = self._parts(self._aliases[x], out, seen | {x}) and literal
            elif x in ("string", "number", "boolean", "object", "symbol", "bigint", "Date") or len(part) > 1:
                literal = False
            else:
                out["any"], literal = True, False  # declared elsewhere
        return literal


def typed_marks(s: Source, params: list[int]) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """Marks of switches and null tests, whose detail names the bytes of the value, and the types of those
    values that the file declares."""
    marks, types, known = [], [], Types(s, params)

    def value(a: int, z: int) -> str:
        span = s.span(a, z)
        found = known.of(a) if a == z else None
        if found:
            types.append({"start_byte": span["start_byte"], "end_byte": span["end_byte"], **found})
        return f"{span['start_byte']} {span['end_byte']}"

    for a, z, first, last, cases, default in switches(s):
        marks.append({"kind": "switch", "detail": "\n".join([value(first, last), "default" if default else "", *cases]), "span": s.span(a, z)})
    for a, z, k, what, strict in null_tests(s):
        marks.append({"kind": "null_test", "detail": f"{value(k, k)}\n{what}\n{'strict' if strict else 'loose'}", "span": s.span(a, z)})
    return marks, types
