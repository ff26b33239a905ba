"""Facts of a TypeScript or JavaScript source: imports, exports, functions, statements, type shapes
and single places that rules ask for.

Read from tokens, not from a full syntax tree: statements at the top level, brackets and their
partners are exact, what stands inside expressions is read by its neighbours.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from typing import Any

from plumbline.lang import bodies
from plumbline.lang.lexer import Places, Token, partners, tokens

#: Extensions tried for a specifier, in order, and those a JavaScript extension may stand for.
EXTENSIONS = (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")
ALIASES = {".js": (".ts", ".tsx", ".js"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}

_MODIFIERS = {"declare", "abstract", "async"}
_DECLARES = ("const", "let", "var", "function", "class", "interface", "type", "enum", "namespace")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "with"}
_STATEMENT_WORDS = {"return", "throw", "break", "continue", "if", "for", "while", "do", "switch", "try", "const", "let", "var", "function", "class", "import", "export", "interface", "type", "enum"}


def candidates(path: str, specifier: str, paths: dict[str, list[str]] | None = None) -> list[str]:
    """Paths that a specifier in the file ``path`` may mean, the first that exists wins.  ``paths``
    maps patterns with one ``*`` to targets, the longest fixed beginning first."""
    if specifier.startswith((".", "/")):
        bases = [posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))]
    else:
        bases = []
        for pattern in sorted(paths or {}, key=lambda p: (-len(p.partition("*")[0]), p)):
            head, star, tail = pattern.partition("*")
            if specifier == pattern or (star and specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail)):
                held = specifier[len(head) : len(specifier) - len(tail)] if star else ""
                bases += [posixpath.normpath(t.replace("*", held)) for t in paths[pattern]]
                break
        bases.append(f"node_modules/{specifier}")
    out: list[str] = []
    for base in bases:
        stem, ext = posixpath.splitext(base)
        if ext in ALIASES:
            out += [stem + x for x in ALIASES[ext]]
            continue
        if ext:
            out.append(base)
        out += [base + x for x in EXTENSIONS] + [f"{base}/index{x}" for x in EXTENSIONS]
    return out


class Source:
    """One parsed text."""

    def __init__(self, path: str, text: str, paths: dict[str, list[str]] | None = None) -> None:
        self.path, self.text, self._paths = path, text, paths
        self.toks, self.comments, self.faults = tokens(text)
        self.places, self.pair = Places(text), partners(self.toks)
        self._texts = ["" if t.kind == "string" else t.text for t in self.toks]  # a string is no word or mark
        self.imports: list[dict[str, Any]] = []
        self.exports: list[dict[str, Any]] = []
        self._own: set[int] = set()  # tokens of import and re-export statements
        self._bodies: list[tuple[int, int, int, int]] = []
        self._modules()
        self._dynamic()
        self._count_uses()

    def _is(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self._texts) and self._texts[k] in texts

    def _name(self, k: int) -> str:
        t = self.toks[k]
        return t.text[1:-1] if t.kind == "string" else t.text

    def span(self, a: int, z: int) -> dict[str, int]:
        """From token ``a`` to token ``z``, both included."""
        return self.places.span(self.toks[a].start, self.toks[min(z, len(self.toks) - 1)].end)

    def _add_import(self, a: int, z: int, specifier: str, names: list[dict[str, Any]], type_only: bool) -> None:
        row = {"from_file": self.path, "specifier": specifier, "type_only": type_only, "span": self.span(a, z), "names": names, "candidates": candidates(self.path, specifier, self._paths)}
        self.imports.append(row)

    def _add_export(self, a: int, z: int, name: str, kind: str, type_only: bool = False, source: str | None = None, declares: str = "") -> None:
        found = candidates(self.path, source, self._paths) if source is not None else []
        self.exports.append({"file": self.path, "name": name, "kind": kind, "type_only": type_only, "span": self.span(a, z), "source_specifier": source, "candidates": found, "declares": declares})

    def _modules(self) -> None:
        """Import and export statements of the top level."""
        k, n = 0, len(self.toks)
        while k < n:
            t = self.toks[k]
            if t.kind == "mark" and t.text in "([{" and k in self.pair:
                k = self.pair[k] + 1
                continue
            starts = k == 0 or not self._is(k - 1, ".", "?.")
            if t.kind == "name" and starts and t.text == "import" and not self._is(k + 1, "(", "."):
                k = self._import(k)
            elif t.kind == "name" and starts and t.text == "export":
                k = self._export(k)
            else:
                k += 1

    def _end(self, k: int) -> int:
        """The last token of a statement whose specifier is token ``k``: attributes and a semicolon."""
        if self._is(k + 1, "with", "assert") and self._is(k + 2, "{") and k + 2 in self.pair:
            k = self.pair[k + 2]
        return k + 1 if self._is(k + 1, ";") else k

    def _braced(self, k: int) -> list[tuple[int, int, str, str, bool]]:
        """(first token, last token, name, local or outer name, type only) between the braces at ``k``."""
        out, at, end = [], k + 1, self.pair.get(k, len(self.toks) - 1)
        while at < end:
            first, typed = at, False
            if self._is(at, "type") and not self._is(at + 1, ",", "}") and not (self._is(at + 1, "as") and not self._is(at + 2, "as", ",", "}") and self._is(at + 3, ",", "}")):
                typed, at = True, at + 1
            name = other = self._name(at)
            if self._is(at + 1, "as") and at + 2 < end:
                other, at = self._name(at + 2), at + 2
            out.append((first, at, name, other, typed))
            at += 1
            while at < end and not self._is(at, ","):
                at += 1
            at += 1
        return out

    def _import(self, k: int) -> int:
        a, k, type_only, names = k, k + 1, False, []
        one = lambda source, local, kind, typed=False: {"source_name": source, "local_name": local, "kind": kind, "type_only": typed, "local_use_count": 0}
        if self._is(k, "type") and not self._is(k + 1, "from", ",", "=") or (self._is(k, "type") and self._is(k + 1, "from") and self._is(k + 2, "from")):
            type_only, k = True, k + 1
        while k < len(self.toks) and self.toks[k].kind != "string":
            if self._is(k, "{"):
                names += [one(name, local, "named", typed) for _, _, name, local, typed in self._braced(k)]
                k = self.pair.get(k, len(self.toks))
            elif self._is(k, "*"):
                names.append(one("*", self._name(min(k + 2, len(self.toks) - 1)), "namespace"))
                k += 2
            elif self._is(k, "=", ";"):
                return k  # import x = require(...)
            elif self.toks[k].kind == "name" and not (self._is(k, "from") and k + 1 < len(self.toks) and self.toks[k + 1].kind == "string"):
                names.append(one("default", self.toks[k].text, "default"))
            k += 1
        if k >= len(self.toks):
            return k
        z = self._end(k)
        self._own.update(range(a, z + 1))
        self._add_import(a, z, self._name(k), names, type_only)
        return z + 1

    def _export(self, a: int) -> int:
        k, toks = a + 1, self.toks
        if self._is(k, "default"):
            z = self._default_end(k + 1)
            self._add_export(a, z, "default", "default", declares="default")
            return k + 1
        type_only = False
        if self._is(k, "type") and self._is(k + 1, "{", "*"):
            type_only, k = True, k + 1
        if self._is(k, "*"):
            name = "*"
            if self._is(k + 1, "as"):
                name, k = self._name(k + 2), k + 2
            if not self._is(k + 1, "from") or k + 2 >= len(toks):
                return k + 1
            z, source = self._end(k + 2), self._name(k + 2)
            self._own.update(range(a, z + 1))
            self._add_export(a, z, name, "reexport", type_only, source)
            self._add_import(a, z, source, [{"source_name": "*", "local_name": "*", "kind": "namespace", "type_only": False, "local_use_count": 0}], type_only)
            return z + 1
        if self._is(k, "{"):
            held, close = self._braced(k), self.pair.get(k, len(toks) - 1)
            if self._is(close + 1, "from") and close + 2 < len(toks):
                z, source = self._end(close + 2), self._name(close + 2)
                self._own.update(range(a, z + 1))
                names = []
                for first, last, name, outer, typed in held:
                    names.append({"source_name": name, "local_name": outer, "kind": "named", "type_only": type_only or typed, "local_use_count": 0})
                    self._add_export(first, last, outer, "reexport", type_only or typed, source)
                self._add_import(a, z, source, names, type_only)
                return z + 1
            for first, last, _, outer, typed in held:
                self._add_export(first, last, outer, "named", type_only or typed, declares="list")
            return close + 1
        return self._declaration(k)

    def _default_end(self, k: int) -> int:
        """Where ``export default`` ends: after a body, else at the end of the line's expression."""
        z = k
        while z < len(self.toks):
            if self._is(z, "(", "[", "{") and z in self.pair:
                body = self._is(z, "{")
                z = self.pair[z]
                if body and not self._is(z + 1, ";", ".", "(", ",", "as", "satisfies"):
                    return z
            if self._is(z, ";"):
                return z
            following = z + 1
            if following >= len(self.toks) or ("\n" in self.text[self.toks[z].end : self.toks[following].start] and self.toks[following].kind == "name" and self.toks[following].text in _STATEMENT_WORDS):
                return z
            z += 1
        return len(self.toks) - 1

    def _declaration(self, k: int) -> int:
        toks = self.toks
        while k < len(toks) and toks[k].text in _MODIFIERS:
            k += 1
        if k >= len(toks):
            return k
        word = toks[k].text
        if word == "const" and self._is(k + 1, "enum"):
            k, word = k + 1, "enum"
        if word in ("function", "class", "interface", "type", "enum", "namespace", "module"):
            k += 1
            if self._is(k, "*"):
                k += 1
            if k < len(toks) and toks[k].kind == "name":
                self._add_export(k, k, toks[k].text, "named", word in ("interface", "type"), declares=word)
            return k + 1
        if word in ("const", "let", "var", "using"):
            return self._bindings(k + 1)
        return k

    def _bindings(self, k: int) -> int:
        """The names that ``const a = 1, { b, c: [d] } = e;`` binds."""
        toks = self.toks
        while k < len(toks):
            if self._is(k, "{", "[") and k in self.pair:
                self._pattern(k)
                k = self.pair[k] + 1
            elif toks[k].kind == "name":
                self._add_export(k, k, toks[k].text, "named", declares="variable")
                k += 1
            # on to the next binding, or out
            while k < len(toks) and not self._is(k, ",", ";"):
                if self._is(k, "(", "[", "{") and k in self.pair:
                    k = self.pair[k]
                elif self._is(k, "}"):
                    return k
                elif k and "\n" in self.text[toks[k - 1].end : toks[k].start] and toks[k].kind == "name" and toks[k].text in _STATEMENT_WORDS and not self._is(k - 1, "="):
                    return k
                k += 1
            if not self._is(k, ","):
                return k
            k += 1
        return k

    def _pattern(self, k: int) -> None:
        """Names bound by a destructuring pattern: after a colon its target, else the name itself."""
        at, end = k + 1, self.pair[k]
        while at < end:
            if self._is(at, "..."):
                at += 1
                continue
            if self._is(at, "{", "[") and at in self.pair:
                self._pattern(at)
                at = self.pair[at] + 1
            elif self._is(k, "{") and self._is(at + 1, ":"):
                at += 2
                continue
            elif self.toks[at].kind == "name":
                self._add_export(at, at, self.toks[at].text, "named", declares="variable")
                at += 1
            while at < end and not self._is(at, ","):
                at = self.pair[at] if self._is(at, "(", "[", "{") and at in self.pair else at
                at += 1
            at += 1

    def _dynamic(self) -> None:
        """import("literal") anywhere: a namespace."""
        for k, t in enumerate(self.toks):
            if t.text == "import" and t.kind == "name" and self._is(k + 1, "(") and not self._is(k - 1, ".") and k + 2 < len(self.toks) and self.toks[k + 2].kind == "string" and self._is(k + 3, ")", ","):
                name = {"source_name": "*", "local_name": "*", "kind": "namespace", "type_only": False, "local_use_count": 0}
                self._add_import(k, self.pair.get(k + 1, k + 3), self._name(k + 2), [name], False)

    def _count_uses(self) -> None:
        """References to imported names outside of import statements."""
        tally: dict[str, int] = {n["local_name"]: 0 for i in self.imports for n in i["names"] if n["local_name"] != "*"}
        if not tally:
            return
        for k, t in enumerate(self.toks):
            if t.kind == "name" and t.text in tally and k not in self._own and not self._is(k - 1, ".", "?.", *_DECLARES) and not (self._is(k + 1, ":") and self._is(k - 1, "{", ",") and not self._is(k - 2, "?")):
                tally[t.text] += 1
        for i in self.imports:
            for n in i["names"]:
                n["local_use_count"] = tally.get(n["local_name"], 0)

    # ------------------------------------------------------------ functions

    def functions(self) -> list[dict[str, Any]]:
        """Functions with a block: name, parameters, lines, branches, and how they fail."""
        found = []
        for k, t in enumerate(self.toks):
            if t.kind == "mark" and t.text == "{" and k in self.pair:
                head = self._head(k)
                if head:
                    found.append((k, self.pair[k], *head))
        inner = {a: [(x, y) for x, y, *_ in found if a < x and y < z] for a, z, *_ in found}
        self._bodies = [(a, z, params, first) for a, z, params, first, _ in found]
        return [self._function(a, z, params, first, name, inner[a]) for a, z, params, first, name in found]

    def _head(self, brace: int) -> tuple[int, int, str] | None:
        """(opening parenthesis or -1, first token, name) of the function whose body opens at ``brace``."""
        k = brace - 1
        if self._is(k, "=>"):
            k -= 1
            if self._is(k, ")") and k in self.pair:
                params = self.pair[k]
                first = params - 1 if self._is(params - 1, "async") else params
                return params, first, self._bound_name(first)
            typed = self._typed_from(k)
            if typed is not None:
                return typed, typed, self._bound_name(typed)
            if self.toks[k].kind == "name":
                return -1, k, self._bound_name(k)
            return None
        if not self._is(k, ")"):
            typed = self._typed_from(k)
            if typed is None:
                return None
            params = typed
        elif k in self.pair:
            params = self.pair[k]
        else:
            return None
        before = params - 1
        if self._is(before, ">"):  # type parameters
            depth = 0
            while before >= 0:
                depth += self._is(before, ">") - self._is(before, "<")
                before -= 1
                if depth == 0:
                    break
        if before < 0:
            return None
        t = self.toks[before]
        if t.text == "function" or (t.text == "*" and self._is(before - 1, "function")):
            return params, before, ""
        if t.kind not in ("name", "string") or t.text in _NOT_CALLS or t.text in _STATEMENT_WORDS - {"function"}:
            return None
        if self._is(before - 1, "function") or (self._is(before - 1, "*") and self._is(before - 2, "function")):
            return params, before - 1, t.text
        if self._is(before - 1, "new", ".", "=", "return", "await", "=>", "(", "&&", "||", "?", ":"):
            return None  # a call before a block
        return params, before, t.text

    def _typed_from(self, k: int) -> int | None:
        """Walks back over a return type to the parenthesis of the parameters."""
        for _ in range(60):
            if k < 1 or self._is(k, ";", "{", "=", "extends", "implements", *_STATEMENT_WORDS):
                return None
            if self._is(k, ":") and self._is(k - 1, ")") and k - 1 in self.pair:
                return self.pair[k - 1]
            k = self.pair[k] - 1 if self._is(k, ")", "]", "}") and k in self.pair else k - 1
        return None

    def _bound_name(self, first: int) -> str:
        if self._is(first - 1, "=", ":") and first >= 2 and self.toks[first - 2].kind == "name":
            return self.toks[first - 2].text
        return ""

    def n_params(self, params: int) -> int:
        if params < 0:
            return 1
        end = self.pair[params]
        n, at, held = 0, params + 1, False
        while at < end:
            if self._is(at, "(", "[", "{") and at in self.pair:
                held, at = True, self.pair[at]
            elif self._is(at, "<"):
                depth = 0
                while at < end:
                    depth += self._is(at, "<") - self._is(at, ">")
                    if depth == 0:
                        break
                    at += 1
            elif self._is(at, ","):
                n, held = n + held, False
            else:
                held = True
            at += 1
        return n + held

    def _function(self, a: int, z: int, params: int, first: int, name: str, inner: list[tuple[int, int]]) -> dict[str, Any]:
        toks, skip = self.toks, {x: y for x, y in inner}
        branches, throws, errors = 0, [], []
        k = a + 1
        while k < z:
            if k in skip:
                k = skip[k] + 1
                continue
            t = toks[k]
            if t.kind == "name" and t.text in ("if", "for", "while", "case", "catch") and not self._is(k - 1, ".", "?."):
                branches += 1
            elif t.kind == "mark" and (t.text in ("&&", "||", "??") or (t.text == "?" and not self._is(k + 1, ":", ",", ")") and not self._is(k + 1, ";"))):
                branches += 1
            elif t.kind == "name" and t.text == "throw":
                throws.append(k)
            elif t.kind == "name" and t.text == "return" and self._is(k + 1, "{") and self._fails(k + 1):
                errors.append(k)
            k += 1
        start, end = self.places.line(toks[a].start), self.places.line(toks[z].start)
        inside = self.text.split("\n")[start : end - 1]
        code = 0
        in_block = False
        for line in inside:
            bare = line.strip()
            if in_block:
                in_block = "*/" not in bare
            elif bare.startswith("/*"):
                in_block = "*/" not in bare
            elif bare and not bare.startswith("//"):
                code += 1
        lines = end - start - (len(inside) - code)
        block = {k: max((x for x in range(a, k) if self._is(x, "{") and self.pair.get(x, -1) > k), default=a) for k in throws + errors}
        mixed = any(block[x] != block[y] for x in throws for y in errors)
        return {"name": name, "span": self.span(first, z), "params": self.n_params(params), "lines": lines, "cyclomatic": 1 + branches, "cognitive": bodies.cognitive(self, a, z, name, inner), "throws": len(throws), "returns_error": len(errors), "mixed": mixed}

    def _fails(self, brace: int) -> bool:
        """Whether an object literal tells of a failure: an error that is not null, or ok: false."""
        k, end = brace + 1, self.pair.get(brace, brace)
        while k < end:
            if self.toks[k].kind == "name" and self._is(k, "error", "err") and self._is(k - 1, "{", ","):
                if self._is(k + 1, ",", "}") or (self._is(k + 1, ":") and not self._is(k + 2, "null", "undefined")):
                    return True
            if self._is(k, "ok", "success") and self._is(k + 1, ":") and self._is(k + 2, "false"):
                return True
            k = self.pair[k] if self._is(k, "(", "[", "{") and k in self.pair else k
            k += 1
        return False

    # ------------------------------------------------------------ places, shapes, statements

    def habits(self) -> list[dict[str, Any]]:
        """Marks of what functions and classes do inside; after ``functions``."""
        held = bodies.unused_locals(self, [(a, z) for a, z, _, _ in self._bodies]) + bodies.loops(self) + bodies.map_effects(self) + bodies.hidden_state(self, self._bodies) + bodies.data_bags(self)
        for a, z, params, _ in self._bodies:
            held += bodies.function_marks(self, a, z, params)
        return [{"kind": kind, "detail": detail, "span": self.span(a, z)} for kind, a, z, detail in held]

    def typed(self) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
        """Marks that types decide, and the types the file declares; after ``functions``."""
        return bodies.typed_marks(self, [params for _, _, params, _ in self._bodies])

    def marks(self) -> list[dict[str, Any]]:
        """(kind, detail, span) of single places."""
        out: list[dict[str, Any]] = []
        add = lambda kind, a, z, detail="": out.append({"kind": kind, "detail": detail, "span": self.span(a, z)})
        for k, t in enumerate(self.toks):
            if t.kind == "string":
                if k and self._is(k - 1, "=") and self._in_tag(k):
                    continue
                forced = ("'" if t.text[0] == '"' else '"') in t.text[1:-1]
                add("quote", k, k, ("single" if t.text[0] == "'" else "double") + (" forced" if forced else ""))
            elif t.kind == "name" and not self._is(k - 1, ".", "?."):
                if t.text == "console" and self._is(k + 1, ".") and k + 3 < len(self.toks) and self._is(k + 3, "("):
                    add("console", k, self.pair.get(k + 3, k + 3), self.toks[k + 2].text)
                elif t.text == "debugger":
                    add("debugger", k, k + 1 if self._is(k + 1, ";") else k)
                elif t.text == "eval" and self._is(k + 1, "(") and not self._is(k - 1, "function"):
                    add("eval", k, self.pair.get(k + 1, k + 1), "eval")
                elif t.text == "new" and self._is(k + 1, "Function"):
                    add("eval", k, self.pair.get(k + 2, k + 1), "Function")
                elif t.text == "instanceof" and k + 1 < len(self.toks) and self.toks[k + 1].kind == "name":
                    add("asserted", k + 1, k + 1, self.toks[k + 1].text)
                elif t.text == "let" and k + 1 < len(self.toks) and self.toks[k + 1].kind == "name":
                    add("let", k + 1, k + 1, self.toks[k + 1].text)
            elif t.kind == "name" and t.text in ("toBeInstanceOf", "toThrow", "toThrowError") and self._is(k + 1, "(") and k + 2 < len(self.toks) and self.toks[k + 2].kind == "name":
                add("asserted", k + 2, k + 2, self.toks[k + 2].text)
            elif t.kind == "mark" and t.text in ("==", "!=") and not self._is(k - 1, "null") and not self._is(k + 1, "null"):
                add("loose", k, k, t.text)
            elif t.kind == "mark" and t.text == "&&":
                chain = self._optional(k)
                if chain:
                    add("optional", *chain)
            elif t.kind == "mark" and t.text == "||" and k + 1 < len(self.toks):
                right = self.toks[k + 1]
                if k >= 2 and self.toks[k - 1].kind == "name" and self._is(k - 2, ".", "?.") and (right.kind in ("string", "number") or (right.kind == "template" and not right.text.endswith("${")) or right.text in ("true", "false", "null", "undefined", "[", "{")):
                    add("nullish", self._member_start(k - 1), self.pair.get(k + 1, k + 1))
        writes: set[str] = set()
        for k, t in enumerate(self.toks):
            if t.kind != "mark":
                continue
            if t.text in ("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??=") and k and self.toks[k - 1].kind == "name" and not self._is(k - 2, ".", "?.", "let", "const", "var"):
                writes.add(self.toks[k - 1].text)
            elif t.text in ("++", "--"):
                for j in (k - 1, k + 1):
                    if 0 <= j < len(self.toks) and self.toks[j].kind == "name":
                        writes.add(self.toks[j].text)
        return [m for m in out if m["kind"] != "let" or m["detail"] not in writes]

    def _in_tag(self, k: int) -> bool:
        """Whether ``name = "..."`` stands in a tag: the nearest angle before it opens one."""
        for j in range(k - 1, max(-1, k - 40), -1):
            if self._is(j, ";", "const", "let", "var", ">"):
                return False
            if self._is(j, "<"):
                return self.toks[j + 1].kind == "name" and self.toks[j + 1].start == self.toks[j].end
        return False

    def _member_start(self, k: int) -> int:
        while k >= 2 and self._is(k - 1, ".", "?.") and self.toks[k - 2].kind == "name":
            k -= 2
        return k

    def _optional(self, k: int) -> tuple[int, int] | None:
        """a.b && a.b.c: the left side again on the right, with a member more."""
        if not k or self.toks[k - 1].kind != "name":
            return None
        a = self._member_start(k - 1)
        size = k - a
        left, right = [t.text for t in self.toks[a:k]], [t.text for t in self.toks[k + 1 : k + 1 + size]]
        if left == right and (self._is(k + 1 + size, ".")) and not self._is(a - 1, ".", "?.", "!"):
            return a, k + 2 + size
        return None

    def shapes(self) -> list[dict[str, Any]]:
        """Interfaces and object types: their fields with the types as written."""
        out = []
        for k, t in enumerate(self.toks):
            if t.kind != "name" or t.text not in ("interface", "type") or k + 1 >= len(self.toks) or self.toks[k + 1].kind != "name" or self._is(k - 1, ".", "?."):
                continue
            at, extends = k + 2, []
            if t.text == "type":
                if not (self._is(at, "=") and self._is(at + 1, "{")):
                    continue
                at += 1
            elif self._is(at, "extends"):
                first = at + 1
                while at < len(self.toks) and not self._is(at, "{"):
                    at += 1
                extends = [x.strip() for x in self.text[self.toks[first].start : self.toks[at - 1].end].split(",")] if at < len(self.toks) else []
            if not self._is(at, "{") or at not in self.pair:
                continue
            out.append({"file": self.path, "name": self.toks[k + 1].text, "span": self.span(k, self.pair[at]), "fields": self._fields(at), "extends": extends})
        return out

    def _fields(self, brace: int) -> list[dict[str, str]]:
        fields, k, end = {}, brace + 1, self.pair[brace]
        while k < end:
            if self._is(k, "readonly") and not self._is(k + 1, ":", "?"):
                k += 1
            name, at = self._name(k), k + 1
            if self._is(at, "?"):
                name, at = name + "?", at + 1
            z = at
            while z < end and not self._is(z, ";", ",") and not (z > at and "\n" in self.text[self.toks[z - 1].end : self.toks[z].start] and not self._is(z, "|", "&")):
                z = self.pair[z] if self._is(z, "(", "[", "{") and z in self.pair else z
                z += 1
            if self._is(at, ":") and z > at + 1:
                fields[name] = re.sub(r"\s+", " ", self.text[self.toks[at + 1].start : self.toks[z - 1].end])
            k = z + 1 if self._is(z, ";", ",") else z
            if z == at:
                k = max(k, at + 1)
        return [{"name": a, "type": b} for a, b in fields.items()]

    def statements(self) -> list[dict[str, Any]]:
        """Statements of every block, one after the other: the block, the run without imports and
        re-exports that it stands in, and two hashes, of the tokens as written, and with literals
        taken alike."""
        out: list[dict[str, Any]] = []
        blocks = [(-1, len(self.toks))] + [(k, self.pair[k]) for k, t in enumerate(self.toks) if t.kind == "mark" and t.text == "{" and k in self.pair and self._is_block(k)]
        for number, (a, z) in enumerate(blocks):
            run, at, k = 0, 0, a + 1
            while k < z:
                last = self._statement_end(k, z)
                if k in self._own:
                    run += 1
                else:
                    own = self.toks[k : last + 1]
                    exact = " ".join(t.text for t in own)
                    shape = " ".join("#" if t.kind in ("string", "number", "template", "regex") else t.text for t in own)
                    same = _digest(exact)
                    out.append({"block": number, "run": run, "at": at, "span": self.span(k, last), "exact": same, "shape": same if shape == exact else _digest(shape), "bytes": len(exact)})
                    at += 1
                k = last + 1
        return out

    def _is_block(self, brace: int) -> bool:
        return self._is(brace - 1, ")", "=>", "else", "try", "finally", "do", "{", "}", ";") or brace == 0 or self._head(brace) is not None

    def _statement_end(self, k: int, z: int) -> int:
        at = k
        while at < z:
            if self._is(at, ";"):
                return at
            if self._is(at, "(", "[", "{") and at in self.pair:
                block = self._is(at, "{") and self._is_block(at)
                at = self.pair[at]
                if block and not self._is(at + 1, "else", "catch", "finally", ")", ",", ".", ";", "while"):
                    return min(at, z - 1)
            following = at + 1
            if following < z and "\n" in self.text[self.toks[at].end : self.toks[following].start] and self._breaks(at, following):
                return at
            at += 1
        return z - 1

    def _breaks(self, at: int, following: int) -> bool:
        """Whether a line break between two tokens ends a statement."""
        a, b = self.toks[at], self.toks[following]
        ends = a.kind != "mark" or a.text in (")", "]", "}", "++", "--")
        starts = b.kind in ("name", "string", "number", "template") and b.text not in ("instanceof", "in", "as", "satisfies", "else", "catch", "finally")
        return ends and starts and not (a.kind == "name" and a.text in _BEFORE_MORE)


_BEFORE_MORE = {"export", "default", "const", "let", "var", "function", "class", "new", "typeof", "await", "async", "else", "import", "from", "as", "extends", "interface", "type", "enum", "case", "void", "delete"}


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def astro_script(text: str) -> str:
    """The front matter of a component page as a script, at its own place: all else is blank."""
    m = re.match(r"\s*---[ \t]*\r?\n(.*?)^---", text, re.S | re.M)
    if not m:
        return re.sub(r"[^\n]", " ", text)
    return re.sub(r"[^\n]", " ", text[: m.start(1)]) + m[1] + re.sub(r"[^\n]", " ", text[m.end(1) :])


def mask(text: str, toks: list[Token], comments: list[Token]) -> str:
    """The text with comments and the insides of strings as blanks, place for place."""
    out = list(text)
    for t in comments:
        out[t.start : t.end] = re.sub(r"[^\n]", " ", t.text)
    for t in toks:
        if t.kind in ("string", "template", "regex") and t.end - t.start > 2:
            out[t.start + 1 : t.end - 1] = re.sub(r"[^\n]", " ", t.text[1:-1])
    return "".join(out)
