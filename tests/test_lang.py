"""Facts read from texts: programs, Rust, prose, directives, manifests, notes."""

from __future__ import annotations

import pytest
from plumbline.lang import lexer, prose, rust, typescript
from plumbline.sources import config, discover, packages, suppressions


def source(text: str, path: str = "src/a/b.ts", **more) -> typescript.Source:  # noqa: ANN003
    return typescript.Source(path, text, **more)


@pytest.mark.parametrize(
    ("text", "specifier", "type_only", "names"),
    [
        ("import x from './m'", "./m", False, [("default", "x", "default", False)]),
        ("import { a as b, type C } from \"./m\";", "./m", False, [("a", "b", "named", False), ("C", "C", "named", True)]),
        ("import * as ns from './m'", "./m", False, [("*", "ns", "namespace", False)]),
        ("import d, * as ns from './m'", "./m", False, [("default", "d", "default", False), ("*", "ns", "namespace", False)]),
        ("import './m'", "./m", False, []),
        ("import type { T } from './m'", "./m", True, [("T", "T", "named", False)]),
        ("import type from './m'", "./m", False, [("default", "type", "default", False)]),
        ("import { type } from './m'", "./m", False, [("type", "type", "named", False)]),
        ("import { default as d } from './m' with { type: 'json' };", "./m", False, [("default", "d", "named", False)]),
        ("export { a as b } from './m'", "./m", False, [("a", "b", "named", False)]),
        ("export type { T } from './m'", "./m", True, [("T", "T", "named", True)]),
        ("export * from './m'", "./m", False, [("*", "*", "namespace", False)]),
        ("f(() => import('./m').then(x => x))", "./m", False, [("*", "*", "namespace", False)]),
    ],
)
def test_imports(text, specifier, type_only, names) -> None:
    (found,) = source(text).imports
    assert (found["specifier"], found["type_only"]) == (specifier, type_only)
    assert [(n["source_name"], n["local_name"], n["kind"], n["type_only"]) for n in found["names"]] == names


@pytest.mark.parametrize("text", ["// import x from './m'", "const s = \"import x from './m'\";", "`import x from './m'`", "import(name)", "import.meta.url", "a.import('./m')", "/import x from '.'/.test(y)"])
def test_no_imports(text) -> None:
    assert source(text).imports == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("export const a = 1, b = f(2, [3]);", [("a", "named", False), ("b", "named", False)]),
        ("export const { a, b: { c }, ...d } = x, [e, , f = 2] = y", [(n, "named", False) for n in "acdef"]),
        ("export async function* g() {}\nexport abstract class C {}", [("g", "named", False), ("C", "named", False)]),
        ("export interface I {}\nexport type T = I;\nexport enum E {}\nexport const enum F {}\nexport namespace N {}", [("I", "named", True), ("T", "named", True), ("E", "named", False), ("F", "named", False), ("N", "named", False)]),
        ("export default class {}", [("default", "default", False)]),
        ("const a = 1; export { a, a as default };", [("a", "named", False), ("default", "named", False)]),
        ("export { a, default as b } from './m'; export * as n from './m'; export * from './o'", [("a", "reexport", False), ("b", "reexport", False), ("n", "reexport", False), ("*", "reexport", False)]),
        ("function f() { return { export: 1 } }", []),
    ],
)
def test_exports(text, found) -> None:
    assert [(e["name"], e["kind"], e["type_only"]) for e in source(text).exports] == found


def test_uses_of_imports() -> None:
    text = "import { a, b as c, d } from './m';\nc(a.a, { a: 1, a }, x.a); type T = d; // a\n'a'; export { c };"
    assert {n["local_name"]: n["local_use_count"] for n in source(text).imports[0]["names"]} == {"a": 2, "c": 2, "d": 1}


def test_candidates() -> None:
    at = lambda s, **k: typescript.candidates("src/a/b.ts", s, **k)
    assert at("./f.js")[:2] == ["src/a/f.ts", "src/a/f.tsx"] and at("../x")[0] == "src/x.ts" and "src/x/index.ts" in at("../x")
    assert at("@/q", paths={"@/*": ["src/*"], "*": ["lib/*"]})[0] == "src/q.ts" and at("react")[0] == "node_modules/react.ts"


def test_functions() -> None:
    text = """function f(a, b: Map<string, number>, { c, d }: X) {
  // note
  if (a && b || c) { return 1; }

  for (const x of y) { while (x?.z) {} }
  const g = (p) => { switch (p) { case 1: case 2: return a ?? b; default: return p ? 1 : 2 } };
  throw new Error("x");
}
class K { async m(x?: number): Promise<void> { try { g() } catch (e) { return { error: e } } if (x) { throw 1 } } }
call(1, 2); if (ready) { go() }
"""
    got = {f["name"]: f for f in source(text).functions()}
    assert set(got) == {"f", "g", "m"}
    assert (got["f"]["params"], got["f"]["cyclomatic"], got["f"]["lines"], got["f"]["throws"]) == (3, 6, 5, 1)
    assert (got["g"]["params"], got["g"]["cyclomatic"]) == (1, 5) and (got["m"]["params"], got["m"]["mixed"], got["m"]["returns_error"]) == (1, True, 1)


def test_places() -> None:
    text = "if (a == null || b != c) {}\nconsole.log(1); console.warn(2);\neval('x'); new Function('y'); x.eval('z');\ndebugger;\na && a.b; a.b && a.b.c; f() && f().g;\nx.y || 'd'; x || 'd'; x.y || z;\nlet u = 1; let v = 2; v += 1; let w; w = 3;\ne instanceof Err; expect(f).toThrow(Err2)"
    got = [(m["kind"], m["detail"]) for m in source(text).marks() if m["kind"] != "quote"]
    assert sorted(got) == sorted([("loose", "!="), ("console", "log"), ("console", "warn"), ("eval", "eval"), ("eval", "Function"), ("debugger", ""), ("optional", ""), ("optional", ""), ("nullish", ""), ("let", "u"), ("asserted", "Err"), ("asserted", "Err2")])


def test_quotes() -> None:
    got = [m["detail"] for m in source("a('x'); b(\"y\"); c(\"don't\"); <T k=\"z\" />; `t`").marks() if m["kind"] == "quote"]
    assert got == ["single", "double", "double forced"]


def test_shapes() -> None:
    got = source("interface A extends B, C<D> { readonly a: string; b?: { x: 1 }\n c(): void }\ntype T = { a: string, d: 'x' | 'y' };\ntype U = A | B").shapes()
    assert [(s["name"], s["extends"], [f["name"] for f in s["fields"]]) for s in got] == [("A", ["B", "C<D>"], ["a", "b?"]), ("T", [], ["a", "d"])]


def test_statements_and_faults() -> None:
    got = source("import a from 'b'\nx()\ny(1)\nif (z) { q('s'); r() } else { t }\nexport const k = () => { u() }\n").statements()
    assert [(s["block"], s["run"]) for s in got] == [(0, 1)] * 4 + [(1, 0)] * 2 + [(2, 0)] + [(3, 0)]
    assert source("a(1); b()").statements()[0]["shape"] == source("a(2); b()").statements()[0]["shape"]
    for bad in ("f(", "f())", "`a${b", "{]"):
        assert source(bad).faults
    assert not source("const a = <p>don't</p>; // it's\n").faults


def test_spans_are_bytes() -> None:
    places = lexer.Places("é\n\U0001f600x")
    assert places.span(2, 4) == {"start_byte": 3, "end_byte": 8, "line": 2, "column": 1} and places.span(3, 4)["column"] == 5


def test_component_pages() -> None:
    page = "---\nimport A from './a';\n---\n<p>import B from './b'</p>\n"
    script = typescript.astro_script(page)
    assert len(script) == len(page) and [i["specifier"] for i in source(script).imports] == ["./a"] and source(typescript.astro_script("<p>import x</p>")).imports == []


def test_rust() -> None:
    text = "/// doc\npub fn a() {}\n/** doc */\n#[inline]\npub unsafe fn b() {}\npub(crate) struct C;\n#[doc = \"x\"]\npub enum D {}\n// no\npub trait E { fn f(&self) { x.unwrap() } }\npub const F: u8 = 1;\n#[cfg(not(test))]\nfn g() { y.unwrap() }\n#[test]\nfn h() { z.unwrap(); todo!() }\nmod tests { fn i() { unimplemented!() } }\n/* /* nested */ w.unwrap() */ const S: &str = r#\"v.unwrap() \"{\"#;\n"
    got = [(m["kind"], m["detail"], m["span"]["line"]) for m in rust.facts("a.rs", text)["marks"]]
    assert got == [("rust_pub", "trait E", 10), ("rust_unwrap", "unwrap", 10)]
    assert rust.facts("a.rs", "fn f( {")["error"] and rust.facts("a.rs", "")["marks"] == []


def test_prose() -> None:
    text = "---\ntitle: colour\n---\nThe colour, `color` and [color](./color.md); see https://x.y/color <b color=1>Colours</b>.\n```ts\ncolor\n```\n[color]: ./c\n~~~~\n~~~\ncolor\n~~~~\nGray\n"
    assert [w["word"] for w in prose.markdown_words(text)] == ["colour", "color", "Colours", "Gray"]
    got = source("// the colour\nconst color = 'color'; f('a color here'); <i class=\"gray box\" />").imports
    assert got == [] and [w["word"] for w in prose.program_words(source("// the colour\nconst color = 'color'; f('a color here');"))] == ["colour", "color"]
    assert prose.leading_case("Colour", "color") == "Color" and prose.leading_case("colour", "color") == "color" and len(prose.SPELLINGS) > 70


LINES = """// plumbline-ignore: A.B: why

x
// plumbline-ignore C.D - why
// plumbline-ignore please
y
/* plumbline-disable E.F, G.H */
z
/* plumbline-enable G.H */
// plumbline-ignore-start
w
// plumbline-ignore-end: I.J
// plumbline-disable-next-line
v
// plumbline-ignore-file: K.L
// plumbline-ignore"""


def test_directives() -> None:
    got = [(d["scope"], d["line_from"], d["line_to"], d["check_id"], d["line"]) for d in suppressions.directives(LINES)]
    assert sorted(got, key=repr) == sorted(
        [("line", 3, 3, "A.B", 1), ("line", 5, 5, "C.D", 4), ("range", 7, 8, "E.F", 7), ("range", 7, 8, "G.H", 7), ("range", 10, 11, None, 10), ("line", 14, 14, None, 13), ("file", None, None, "K.L", 15)], key=repr
    )
    assert suppressions.directives(None) == [] and suppressions.directives("// plumbline-ignore-start: A.B\nx") == [{"scope": "range", "line_from": 1, "line_to": 2, "check_id": "A.B", "line": 1, "start_byte": 0, "end_byte": 30, "scoped": True, "text": "// plumbline-ignore-start: A.B"}]
    assert [b["line"] for b in suppressions.broad(LINES)] == [5, 16] and suppressions.broad("  // plumbline-ignore")[0]["column"] == 6


def test_manifests() -> None:
    got = packages.manifest('[package]\nname = "a"\nversion = "1.0.0" # v\nauthors = ["x", 3]\n[other]\nlicense = "MIT"\n')
    assert (got["name"], got["version"], got["authors"], got["license"]) == ("a", "1.0.0", ["x"], None)
    assert got["spans"]["version"] == {"start_byte": 31, "end_byte": 38, "line": 3, "column": 11} and got["spans"]["license"] is None
    assert packages.manifest("[package")["error"]


@pytest.mark.parametrize(
    ("lines", "path", "out"),
    [
        (["*.log"], "a/b.log", True), (["/a"], "x/a", False), (["/a"], "a/q", True), (["a/"], "a", False), (["a/"], "x/a/b", True), (["a/*.ts"], "a/b.ts", True), (["a/*.ts"], "a/b/c.ts", False),
        (["**/b"], "x/y/b", True), (["a/**"], "a/x/y", True), (["a/**/b"], "a/b", True), (["*.ts", "!keep.ts"], "keep.ts", False), (["#x", "", "\\#x"], "#x", True), (["a[0-9]"], "a5", True), (["a?c"], "abc", True),
    ],
)
def test_ignore_lines(spark, lines, path, out) -> None:
    from pyspark.sql import functions as F

    assert spark.range(1).select(discover.ignored(F.lit(path), [("", x) for x in lines])).first()[0] is out


def test_notes() -> None:
    text = "---\ntitle: \"How: it works\"\npriority: high\nmatch:\n  paths:\n    - src/*.ts\n    - lib/**\n  layers: [core, nowhere]\n  predicate: \"file exports 'x'\"\n---\nBody\n---\nmore\n"
    note, faults = config.read_note("n.md", text, ["core"])
    assert (note.title, note.priority, note.paths, note.layers, note.predicate, note.body) == ("How: it works", "high", ["src/*.ts", "lib/**"], ["core"], "file exports 'x'", "Body\n---\nmore") and faults == ["n.md: undeclared layer 'nowhere'"]
    assert config.read_note("n.md", "no fields")[0] is None and config.read_note("n.md", "---\na b\n---\n")[1][0].startswith("n.md: invalid") and config.read_note("n.md", "---\ntitle:\n---\n")[1] == ["n.md: no title"]


def test_public_paths_of_a_manifest() -> None:
    manifest = '{"main": "./dist/a.js", "exports": {".": {"types": "./dist/a.d.ts", "import": "./dist/esm/b.mjs"}, "./c": ["./c.js"]}}'
    assert config.manifest_paths(manifest, ["package.json:main", "package.json:bin", "x.ts"]) == (["dist/a", "src/a"], ["package.json:bin"])
    assert config.manifest_paths(manifest, ["package.json:exports"])[0] == ["c", "dist/a", "dist/esm/b", "src/a", "src/esm/b"]
    assert config.manifest_paths("{", ["package.json:main"]) == ([], ["package.json:main"]) and config.manifest_paths(None, []) == ([], [])


def habits(text: str) -> list[tuple[str, str]]:
    held = source(text)
    held.functions()
    return sorted((m["kind"], m["detail"]) for m in held.habits())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("function f(a, b) { a = 1; b.c = 2; b.d(); }", [("mutated", "a reassigned"), ("mutated", "b mutated")]),
        ("function f(a) { let b = a; const _c = 1; const d = 2; b++; }", [("unused", "d")]),
        ("const top = 1;", []),
        ("function f(x: string[], y: Array<number>, z: number[], w: readonly string[]) { x.map(g); y.push(1); return z[0] + w[0] }", [("readonly", "x readonly string[]"), ("readonly", "z readonly number[]")]),
        ("for (const x of y) { out.push(f(x)); }\nfor (const x of y) { if (x) { out.push(x) } }\nfor (const x of y) { out.push(x); g() }", [("loop", "out filter"), ("loop", "out map")]),
        ("a.map(x => { total += x; return x }); a.filter((x) => { let q = 1; q = x; return q }); a.map(x => console.log(x)); a.forEach(x => { t = x })", [("map_effect", "map"), ("map_effect", "map")]),
        ("let n = 0; let m = 1; export function next() { return n } export function set(v) { n = v } function own() { return n } export function other() { return m }", [("hidden", "next n"), ("hidden", "set n")]),
        ("class A { x = 1; y: string; constructor(z) { this.z = z; } }\nclass B extends A { x = 1 }\nclass C { x = 1; f() {} }\nclass D { f = () => 1 }\n@d class E { x = 1 }\nclass F { get x() { return 1 } }\nclass G {}", [("data_bag", "A")]),
    ],
)
def test_habits(text, found) -> None:
    assert habits(text) == found


def test_cognitive() -> None:
    text = """function f(a) {
  if (a) { for (const x of a) { if (x) { g() } } } else if (b) { c() } else { d() }
  while (a && b && c || d) { f(1) }
  const h = () => { if (q) { r() } };
  return a ? 1 : 2;
}"""
    got = {x["name"]: x["cognitive"] for x in source(text).functions()}
    # if 1, for 2, if 3, else if 1, else 1, while 1, && 1, || 1, itself 1, ternary 1; the inner one apart
    assert got == {"f": 13, "h": 1}


def test_types_that_a_file_declares() -> None:
    held = source("type A = 'x' | B; type B = 2 | true;\nfunction f(a: A, b: string | null, c?: C) { switch (a) { case 'x': case f(): } return a === undefined && b == null && null !== c && d.a === null }\nlet d: any; let e: A; let e2 = 1")
    held.functions()
    marks, types = held.typed()
    assert [m["detail"].split("\n")[1:] for m in marks] == [["", "x"], ["undefined", "strict"], ["null", "loose"], ["null", "strict"]]
    assert [(t["text"], t["members"], t["null"], t["undefined"], t["any"]) for t in types] == [("A", ["x", "2", "true"], False, False, False)] * 2 + [("string | null", [], True, False, False), ("C | undefined", [], False, True, True)]
