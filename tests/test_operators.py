"""Operators on nulls, ties, repeats, empty tables and clashing names, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from plumbline.functions import paths, texts
from plumbline.operators import bands, findings, graph, intervals, stats, windows
from plumbline.plans import predicate
from pyspark.sql import functions as F

RNG = random.Random(17)


def rows(df) -> list[tuple]:  # noqa: ANN001
    return sorted(map(tuple, df.collect()), key=repr)


FINDINGS = "event_id long, check_id string, file string, line long, priority double, b string"
FOUND = [(1, "a", "f", 5, 1.0, "x"), (1, "a", "f", 9, 1.0, "x"), (2, "b", "f", 5, None, "x"), (3, "a", None, 5, 2.0, "x"), (4, None, "f", 5, 2.0, "x"), (5, "a", "g", None, 3.0, "x"), (6, "a", "f", 600, 3.0, "x"), (6, "a", "f", 600, 3.0, "x")]
BANDS = "check_id string, file string, first_line long, last_line long, key string"
DIRECTIVES = [("a", "f", 4, 6, "k"), ("a", "f", 4, 6, "k"), (None, "g", None, None, "k"), ("c", "f", 1, 1000, "k"), ("a", None, 1, 9, "k"), ("a", "f", 300, 900, "k"), ("a", "f", 9, 2, "k")]


def covers(d: tuple, f: tuple, by_check: bool = True) -> bool:
    if d[1] is None or f[2] is None or d[1] != f[2] or (by_check and d[0] is not None and d[0] != f[1]):
        return False
    return d[2] is None or (f[3] is not None and d[2] <= f[3] <= d[3])


def test_suppression(spark) -> None:
    f, d = spark.createDataFrame(FOUND, FINDINGS), spark.createDataFrame(DIRECTIVES, BANDS)
    assert rows(findings.suppressed(f, d)) == sorted([x for x in FOUND if not any(covers(y, x) for y in DIRECTIVES)], key=repr)
    named = [y for y in DIRECTIVES if y[0] is not None]
    assert rows(findings.stale_directives(d, f)) == sorted([y for y in named if not any(covers(y, x) for x in FOUND)], key=repr)
    assert rows(findings.suppressed(f.where("false"), d)) == [] and rows(findings.suppressed(f, d.where("false"))) == sorted(FOUND, key=repr)


def test_suppression_at_a_related_place(spark) -> None:
    f = spark.createDataFrame([("a", "f", 1, [("g", 7)], "m"), ("a", "f", 2, [("h", 7)], "m"), ("a", "f", 2, [], "m")], "check_id string, file string, line long, related array<struct<file:string,line:long>>, m string")
    d = spark.createDataFrame([("a", "g", 7, 7)], "check_id string, file string, first_line long, last_line long")
    assert [r.line for r in findings.suppressed(f, d).collect()] == [2, 2]


def test_fresh_does_not_multiply(spark) -> None:
    f, d = spark.createDataFrame(FOUND, FINDINGS), spark.createDataFrame(DIRECTIVES, BANDS)
    want = sorted([(*x, any(covers(y, x, False) for y in DIRECTIVES)) for x in FOUND], key=repr)
    assert rows(findings.fresh(f, d, "event_id")) == want
    fresh, legacy = findings.fresh_counts(f, d)
    assert dict(map(tuple, fresh.collect())) == {"a": 5, "b": 1, None: 1} and rows(legacy) == []


def test_baselines_meet_null_keys(spark) -> None:
    old = spark.createDataFrame([("f", None), ("f", None), ("g", "s")], "file string, sig string")
    new = spark.createDataFrame([("f", None), ("h", "t"), (None, "s")], "file string, sig string")
    assert rows(findings.baseline_tag(new, old, "file", "sig")) == sorted([("f", None, True), ("h", "t", False), (None, "s", False)], key=repr)
    assert rows(findings.baseline_delta(old, new, "file", "sig")) == sorted([("f", None, 0, 1), ("g", "s", 0, 1), ("h", "t", 1, 0), (None, "s", 1, 0)], key=repr)
    assert rows(findings.would_fire_clear(old, new, "file", "sig")) == sorted([("g", "s", "clear"), ("h", "t", "fire"), (None, "s", "fire")], key=repr)
    assert rows(findings.pruned(old, new, "file", "sig")) == [("f", None), ("f", None)]


def test_a_budget_is_met_by_the_check_before_the_category(spark) -> None:
    counts = spark.createDataFrame([("a", None, 5), (None, "a", 3), (None, "c", 7)], "check_id string, category string, n long")
    budgets = spark.createDataFrame([("a", 10), ("c", 1), ("d", 0)], "name string, budget long")
    assert rows(findings.over_budget(counts, budgets)) == [("a", 10, 5), ("c", 1, 7), ("d", 0, 0)]


def assembled(items: list[tuple], budget: int) -> list[tuple]:
    """Pinned first; then each check's best in turn, the best heads first, skipping what does not fit."""
    order = lambda i: (-i[3], i[0], i[1], i[2])
    out = sorted([i for i in items if i[4]], key=order)
    spent = sum(max(20, i[5]) for i in out)
    groups = defaultdict(list)
    for i in sorted([i for i in items if not i[4]], key=order):
        groups[i[0]].append(i)
    while any(groups.values()):
        for c in sorted([c for c in groups if groups[c]], key=lambda c: (-groups[c][0][3], c)):
            i = groups[c].pop(0)
            if spent + max(20, i[5]) <= budget:
                spent += max(20, i[5])
                out.append(i)
    return sorted(out)


@pytest.mark.parametrize("budget", [0, 130, 400, 10_000])
def test_digest(spark, budget) -> None:
    items = [(RNG.choice("abc"), f"t{k % 3}", f"b{k}", RNG.randint(1, 4), k % 9 == 0, RNG.randint(5, 60)) for k in range(40)]
    df = spark.createDataFrame(items, "check_id string, title string, body string, score int, pinned boolean, tokens long")
    assert sorted(tuple(r)[:6] for r in findings.digest(df, budget).collect()) == assembled(items, budget)


def test_budget_with_ties_in_its_order(spark) -> None:
    items = [(1, "a", 30), (1, "b", 30), (1, "c", 50), (2, "a", 30), (None, "a", 20)]
    df = spark.createDataFrame(items, "place long, name string, tokens long")
    got = [tuple(r) for r in findings.budgeted(df, 110, "tokens", ["place", "name"]).collect()]
    assert got == [(1, "a", 30), (1, "b", 30), (1, "c", 50)]
    assert [r.name for r in findings.budgeted(df, 61, "tokens", ["place", "name"]).collect()] == ["a", "b"]
    assert findings.budgeted(df.where("false"), 100, "tokens", ["place", "name"]).count() == 0


def test_gates(spark) -> None:
    f = spark.createDataFrame([("a", "f", s) for s in (*findings.SEVERITIES, "odd", None)], "check_id string, file string, severity string")
    assert [r.severity for r in findings.gate(f, "medium").collect()] == ["medium", "high", "critical"]
    assert findings.in_scope(f, [], None).count() == 0 and findings.in_scope(f, None, f.limit(1)).count() == 7
    many = spark.createDataFrame(FOUND, FINDINGS)
    assert {r.n_all for r in findings.first_n(many, 2).collect()} == {8} and findings.first_n(many, 0).count() == 8


def test_scopes(spark) -> None:
    scopes = [("f", k, a, a + n) for k, (a, n) in enumerate([(1, 900), (5, 10), (5, 10), (700, 3), (2000, 5), (7, 0)])] + [("g", 99, 3, 4), (None, 98, 1, 9)]
    points = [(RNG.randint(1, 3), "f", RNG.randint(1, 2100)) for _ in range(60)] + [(1, "g", 1), (2, "g", 5), (3, None, 4), (4, "f", None)]

    def found(f, at):  # noqa: ANN001, ANN202
        if f is None or at is None:
            return None, None
        inside = [(z - a, a, s) for g, s, a, z in scopes if g == f and a <= at <= z]
        after = [(a, s) for g, s, a, z in scopes if g == f and a > at]
        return (min(inside)[2], "inside") if inside else (min(after)[1], "next") if after else (None, None)

    got = intervals.enclosing_scope(spark.createDataFrame(points, "event_id long, file string, at long"), spark.createDataFrame(scopes, "file string, scope long, first long, last long"), "event_id")
    assert rows(got) == sorted([(k, *found(f, at)) for k, f, at in points], key=repr)


@pytest.mark.parametrize("width", [1, 3, 6])
def test_self_overlap(spark, width) -> None:
    places = [(RNG.choice("ab"), RNG.randint(1, 60)) for _ in range(90)] + [("c", None), (None, 4), (None, 5)]
    want = []
    for g in {p[0] for p in places}:
        last = None
        for at in sorted({p[1] for p in places if p[0] == g and p[1] is not None}):
            if last is None or at - last >= width:
                want.append((g, at))
                last = at
    got = intervals.drop_self_overlap(spark.createDataFrame(places, "g string, at long"), width, "g")
    assert rows(got) == sorted(want, key=repr)


def test_claims(spark) -> None:
    held = [(RNG.choice("fg"), a := RNG.randint(1, 80), a + RNG.randint(0, 6), k) for k in range(70)]
    want = []
    for f in "fg":
        taken: list[tuple[int, int]] = []
        for x in sorted((x for x in held if x[0] == f), key=lambda x: (x[1], x[2], x[3])):
            free = not any(x[1] <= z and a <= x[2] for a, z in taken)
            want.append((*x, free))
            if free:
                taken.append((x[1], x[2]))
    df = spark.createDataFrame(held, "file string, start long, end long, k long")
    assert [r for r in rows(intervals.claim(df, ["start", "end", "k"])) if r[4]] == sorted([w for w in want if w[4]], key=repr)


def test_overlap_of_bands(spark) -> None:
    a = [(k, "f", x := RNG.randint(1, 3000), x + RNG.randint(0, 700)) for k in range(40)] + [(99, None, 1, 5)]
    b = [("f", x := RNG.randint(1, 3000), x + RNG.randint(0, 40)) for _ in range(15)] + [(None, 1, 9)]
    got = bands.overlapping(spark.createDataFrame(a, "key long, file string, first_line long, last_line long"), spark.createDataFrame(b, "file string, first_line long, last_line long"), F.col("p.file") == F.col("b.file"))
    assert sorted(r.key for r in got.collect()) == [k for k, f, x, z in a if f and any(g == f and x <= w and v <= z for g, v, w in b)]


# ---------------------------------------------------------------- graphs


def random_graph(n: int, m: int) -> list[tuple[int, int]]:
    return [(RNG.randrange(n), RNG.randrange(n)) for _ in range(m)]


def reach(edges: list[tuple[int, int]], start: int, most: int = 10**9) -> dict[int, int]:
    out: dict[int, int] = {}
    level, depth = [start], 0
    while level and depth < most:
        depth += 1
        level = [b for x in level for a, b in edges if a == x and b not in out]
        out.update({b: depth for b in level if b not in out})
        level = sorted({b for b in level if out[b] == depth})
    return out


@pytest.mark.parametrize("local", [0, 10**6])
def test_search_and_strong_components(spark, local, monkeypatch) -> None:
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    edges = random_graph(24, 34) + [(3, 3), (30, 31), (31, 32), (32, 30)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None), edges[0]], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (3,), (30,), (77,), (None,)], "id long")
    got = rows(graph.closure(df, seeds=seeds))
    assert got == sorted([(s, s, 0) for s in (0, 3, 30, 77)] + [(s, b, d) for s in (0, 3, 30) for b, d in reach(edges, s).items() if b != s], key=repr)
    assert rows(graph.bounded_bfs(df, seeds, 2)) == sorted([(s, b, d) for s in (0, 3, 30) for b, d in reach(edges, s, 2).items() if b != s], key=repr)
    nodes = {x for e in edges for x in e}
    far = {x: set(reach(edges, x)) for x in nodes}
    want = [(x, min(y for y in nodes if y in far[x] and x in far[y])) for x in nodes if x in far[x]]
    assert rows(graph.strong_components(df, local_edges=local)) == sorted(want, key=repr)
    assert graph.strong_components(df.where("false"), local_edges=local).count() == 0


def test_blast_radius_ways(spark) -> None:
    edges = [(2, 1, "x"), (3, 1, "y"), (4, 2, "x"), (4, 3, "x"), (5, 4, "x"), (6, 5, "x"), (7, 6, "x"), (1, 1, "x"), (9, 8, "x"), (4, 8, "y")]
    df = spark.createDataFrame(edges, "src long, dst long, name string")
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    got = {r.id: (r.depth, r.root, r.path, r.score) for r in graph.blast_radius(df, ids(1, 8, 8), names=spark.createDataFrame([(1, "y"), (8, "q")], "id long, name string"), tests=ids(5, 9)).collect()}
    assert got == {2: (1, 1, [1, 2], 70), 3: (1, 1, [1, 3], 95), 9: (1, 8, [8, 9], 75), 4: (1, 8, [8, 4], 70), 5: (2, 8, [8, 4, 5], 60), 6: (3, 8, [8, 4, 5, 6], 40), 7: (4, 8, [8, 4, 5, 6, 7], 25)}


def test_reaching_and_replacing(spark) -> None:
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 1), (5, 5), (6, 7)], "src long, dst long")
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "id long")
    assert rows(graph.reaching(edges, ids(1, 3, 4, 5, 6), ids(3, 5))) == [(1, 3), (3, 3), (4, 3), (5, 5)]
    assert sorted(r.dst for r in graph.neighbours(edges, ids(1, 1, 6)).collect()) == [2, 7]


# ---------------------------------------------------------------- statistics and sets


def test_statistics(spark) -> None:
    values = [1.0] * 9 + [100.0, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    assert [r.k for r in stats.outliers(df, "v", sigmas=2).collect()] == [9]
    assert stats.outliers(df.limit(3), "v", sigmas=0).count() == 0 and stats.outliers(df.where("false"), "v").count() == 0
    names = spark.createDataFrame([("a", "f", 2), ("a", "e", 9), ("a", "e", 9), ("b", "x", 1), (None, "y", 1), (None, "z", 1)], "name string, file string, at long")
    assert rows(stats.duplicate_names(names, "name", "file", "at")) == [("a", "e", 9, 2)]
    assert rows(stats.related_places(names, "name", "file", "at")) == [("a", "e", 9, 1), ("a", "f", 2, 2)]
    votes = spark.createDataFrame([(x,) for x in ["p"] * 5 + ["q"] * 3 + [None]], "v string")
    assert rows(stats.corpus_majority(votes, "v")) == [("p", 5, True), ("q", 3, False)]
    assert rows(stats.corpus_majority(votes, "v", least=9)) == [("p", 5, False), ("q", 3, False)]
    assert rows(stats.corpus_majority(votes, "v", pinned="q")) == [("p", 5, False), ("q", 3, True)]
    assert rows(stats.fans(spark.createDataFrame([(1, 2), (1, 2), (2, 2), (1, None)], "src long, dst long"), spark.createDataFrame([(7,)], "id long"))) == [(1, 0, 3), (2, 3, 1), (7, 0, 0)]


def test_groups_of_similar_sets(spark) -> None:
    sets = [(k, RNG.choice("gh"), RNG.sample("abcdefg", RNG.randint(0, 6))) for k in range(40)]
    df = spark.createDataFrame(sets, "id long, grp string, tokens array<string>")
    got = {(r.grp, r.a, r.b) for r in windows.jaccard_groups(df, "grp", 75).collect()}
    first: dict = {}
    for k, g, t in sorted(sets):
        if len(t) >= 2:
            first.setdefault((g, frozenset(t)), k)
    items = [(g, k, s) for (g, s), k in first.items()]
    want = {(g, min(a, b), max(a, b)) for g, a, s in items for h, b, t in items if g == h and a < b and 100 * len(s & t) >= 75 * len(s | t)}
    assert got == want


def test_largest_cluster(spark) -> None:
    members = spark.createDataFrame([(1, 1, "g"), (2, 1, "g"), (3, 3, "g"), (4, 3, "g"), (5, 5, "h"), (6, 5, "h"), (7, 5, "h")], "id long, label long, group string")
    assert sorted(r.id for r in windows.largest_cluster(members).collect()) == [3, 4, 5, 6, 7]
    assert sorted(r.id for r in windows.largest_cluster(members, members.where("id = 4").select("id")).collect()) == [1, 2, 5, 6, 7]


# ---------------------------------------------------------------- predicates, paths, texts


def test_nulls_do_not_lose_a_file(spark) -> None:
    kind = "array<struct<specifier:string,resolved:string,type_only:boolean,names:array<struct<type_only:boolean>>>>"
    one = lambda typed, *names: [("m", "src/m.ts", typed, [(n,) for n in names])]
    df = spark.createDataFrame([("a", None, None, None), ("b", "x", one(True), ["run"]), ("c", "y", one(False, True), []), ("d", "y", one(False, False, True), ["e"]), ("e", "y", one(False), None)], f"path string, layer string, imports {kind}, exports array<string>")
    facts = predicate.Facts(path=F.col("path"), layer=F.col("layer"), imports=F.col("imports"), exports=F.col("exports"), named=True)
    want = {
        "require file imports 'm'": "a", "file imports as type 'm'": "ae", "forbid file imports as type 'm'": "bcd", "forbid file imports as value 'm'": "de",
        "require file exports 'r*'": "acde", "file.layer == ''": "bcde", "file.layer != 'y'": "cde", "file in 'x'": "acde", "require file transitively imports 'src/*'": "a", "not file in 'y' and file exports 'run'": "acde",
    }
    for text, paths_ in want.items():
        assert "".join(sorted(r.path for r in df.where(predicate.violation(text, facts)).collect())) == paths_, text
    for text, hint in {"fil == 'x'": "did you mean 'file'", "file importz 'x'": "did you mean 'imports'"}.items():
        with pytest.raises(predicate.PredicateError, match=hint):
            predicate.compile_predicate(text, facts)
    assert predicate.edit_distance("kitten", "sitting") == 3 and predicate.edit_distance("", "ab") == 2


def test_paths(spark) -> None:
    held = spark.createDataFrame([("./src\\a/b.test.ts",), ("src/lib/x.ts",), ("dist/x.js",), ("a.b/c",)], "p string")
    p = F.col("p")
    got = held.select(paths.normal(p), paths.classified(p, [".test."]), paths.from_template("__tests__/{name}.spec.ts", paths.normal(p)), paths.public(p, ["src/lib/*.ts", "./a.b/c"], F.array(F.lit("dist/x"))), paths.relative(p, "src")).collect()
    assert [tuple(r) for r in got] == [
        ("src/a/b.test.ts", True, "src/a/__tests__/b.test.spec.ts", False, "a/b.test.ts"),
        ("src/lib/x.ts", False, "src/lib/__tests__/x.spec.ts", True, "lib/x.ts"),
        ("dist/x.js", False, "dist/__tests__/x.spec.ts", True, "dist/x.js"),
        ("a.b/c", False, "a.b/__tests__/c.spec.ts", True, "a.b/c"),
    ]
    for glob, yes, no in (("a[!b-c]d", "aed", "abd"), ("a[[]d", "a[d", "abd"), ("[a&&b]", "&", "c"), ("{src,lib}/**/x", "lib/q/r/x", "etc/x")):
        assert tuple(spark.range(1).select(paths.matches(F.lit(yes), glob), paths.matches(F.lit(no), glob)).first()) == (True, False), glob


def test_texts(spark) -> None:
    held = ["plain", "日本", "áb", "", "tab\tx", "😀", None]
    got = spark.createDataFrame([(x,) for x in held], "t string").select(texts.width_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if x is None else texts.display_width(x) for x in held] and texts.display_width("日本") == 4
    long = "déjà\nvu \ncafé"
    for at in range(len(long.encode()) + 3):
        before = long.encode()[:at]
        want = (before.count(b"\n") + 1, len(before.rpartition(b"\n")[2]) + 1)
        assert tuple(spark.range(1).select(texts.line_column(F.lit(long), F.lit(at))).first()[0]) == want
    for text, want in {"fn f(a: {b: c}) -> x { y }": "fn f(a: {b: c}) -> x", "no brace": "no brace", "f() { g({}) }": "f()", "f(a, (b) => { c }) { d }": "f(a, (b) => { c })"}.items():
        assert spark.range(1).select(texts.header(F.lit(text))).first()[0] == want, text
    one = spark.range(1).select(texts.version(F.lit("1.20")), texts.version(F.lit("1.x")), texts.civil_date(F.lit(19_000)), texts.looks_like_check_id(F.lit("A.b_1")), texts.looks_like_check_id(F.lit("1.b")), texts.config_hash(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))) == texts.config_hash(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)))).first()
    assert (tuple(one[0]), *one[1:]) == ((1, 20), None, "2022-01-08", True, False, True)
