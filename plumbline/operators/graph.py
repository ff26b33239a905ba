"""Graph operators over an edge table (src, dst).  Each round is a written table.

Tables that grow with the graph are joined by sorting: as stored they are small enough for Spark to
send them to the driver and from there to all tasks, round by round, which grows with the graph.

Defined results, unless an operator says otherwise: edges with a null end count for nothing,
repeated edges count once, other columns of the edges are not carried, an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.cut import mark, release, spread, written

#: Up to so many edges a graph, or a weak component of one, is searched, or its strong components
#: found, in one process.
LOCAL_EDGES = 200_000
#: Up to so many rows of a frontier go to all tasks.
FEW = 10_000


def closure(edges: DataFrame, most_depth: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): everything reachable from the seeds (id), at its smallest depth; a node
    reaches itself at depth 0.  Without seeds all nodes are: a table of up to the square of their
    number, for small graphs only."""
    edges = _edges(edges)
    starts = seeds.select(F.col("id").alias("src")) if seeds is not None else edges.select("src").union(edges.select("dst"))
    starts = starts.where("src IS NOT NULL").distinct()
    own = starts.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"))
    return own.unionByName(bfs(edges, starts, most_depth).where("src <> dst"))


def _edges(edges: DataFrame) -> DataFrame:
    return written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")


def bfs(edges: DataFrame, starts: DataFrame, most_depth: int | None = None, local_edges: int | None = None) -> DataFrame:
    """(src, dst, depth) from the nodes of ``starts`` (src), over one edge at least and
    ``most_depth`` at most; a start reaches itself over a cycle only.  ``edges`` are stored rows.

    Up to ``local_edges`` edges (default LOCAL_EDGES) go to all tasks, which search from the starts of
    their own.  Beyond that a weak component of up to so many edges is searched by the task that holds
    it, and in larger ones every depth is a round of joins."""
    limit = LOCAL_EDGES if local_edges is None else local_edges
    starts = starts.distinct()
    if edges.limit(limit + 1).count() <= limit:
        return _searched(edges, starts, most_depth)
    small, large = _parted(edges, limit)
    if small is None:
        return _joined(edges, starts, most_depth)
    held = written(starts.where("src IS NOT NULL").select("src"), "starts")
    part = small.select("part", "src").unionByName(small.select("part", F.col("dst").alias("src"))).distinct()
    placed = part.join(held.hint("merge"), "src").select("part", "src", F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"))
    kind = edges.schema["src"].dataType
    arrow = to_arrow_type(kind)

    def reach(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        after: dict = {}
        for a, b in rows:
            if b is not None:
                after.setdefault(a, []).append(b)
        for a, b in rows:
            if b is None:
                yield from _depths(after, a, most_depth, arrow)

    found = _by_part(small.unionByName(placed), reach, f"src {kind.simpleString()}, dst {kind.simpleString()}, depth int")
    return found if large is None else found.unionByName(_joined(large, held, most_depth))


def _joined(edges: DataFrame, starts: DataFrame, most_depth: int | None) -> DataFrame:
    """``bfs`` with a round of joins for each depth."""
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).hint("merge")
    frontier = written(starts.join(edges.hint("merge"), "src").select("src", "dst", F.lit(1).alias("depth")).distinct(), "frontier")
    seen, depth = frontier, 1
    while (most_depth is None or depth < most_depth) and frontier.limit(1).count():
        depth += 1
        new = frontier.select("src", "dst").join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = written(new.join(seen.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def _parted(edges: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges (part, src, dst) of the weak components of at most ``limit`` edges, and those (src, dst) of
    the others; none where there are none."""
    labels = components(edges).select(F.col("id").alias("src"), F.col("label").alias("part")).hint("merge")
    held = written(edges.select("src", "dst").join(labels, "src").select("part", "src", "dst"), "parts")
    large = written(held.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("part"), "large")  # at most a row per ``limit`` edges
    if not large.limit(1).count():
        return held, None
    small = held.join(large, "part", "left_anti")
    return small if small.limit(1).count() else None, written(held.join(large, "part", "left_semi").select("src", "dst"), "edges")


def _by_part(rows: DataFrame, solve: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``solve`` makes of the pairs (src, dst) of each part of ``rows`` (part, src, dst), in tasks that
    hold one part at a time (of a size bounded by the caller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if held:
                        yield from solve(held)
                    part, held = p, []
                held.append((a, b))
        if held:
            yield from solve(held)

    return spread(rows.select("part", "src", "dst"), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _depths(after: dict, start: object, most_depth: int | None, arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(src, dst, depth) of what ``start`` reaches over the edges ``after``."""
    depths: dict = {}
    level, depth = [start], 0
    while level and (most_depth is None or depth < most_depth):
        depth += 1
        level = [n for n in dict.fromkeys(n for x in level for n in after.get(x, ())) if n not in depths]
        depths.update(dict.fromkeys(level, depth))
    ends = list(depths)
    for at in range(0, len(ends), 100_000):
        own = ends[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([start] * len(own), arrow), pa.array(own, arrow), pa.array([depths[e] for e in own], pa.int32())], ["src", "dst", "depth"])


def _searched(edges: DataFrame, starts: DataFrame, most_depth: int | None) -> DataFrame:
    """The same by tasks that hold all edges (a number bounded by the caller)."""
    after: dict = {}
    for r in edges.collect():
        after.setdefault(r["src"], []).append(r["dst"])
    shared = edges.sparkSession.sparkContext.broadcast(after)
    kind = edges.schema["src"].dataType
    arrow = to_arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_of = shared.value
        for batch in batches:
            for start in batch.column(0).to_pylist():
                yield from _depths(next_of, start, most_depth, arrow)

    return starts.select("src").mapInArrow(rows, f"src {kind.simpleString()}, dst {kind.simpleString()}, depth int")


def bounded_bfs(edges: DataFrame, seeds: DataFrame, most_depth: int) -> DataFrame:
    """(src, dst, depth) within ``most_depth`` steps of the seeds (id), a start itself left out."""
    edges = _edges(edges)
    return bfs(edges, seeds.select(F.col("id").alias("src")), most_depth).where("src <> dst")


def neighbours(edges: DataFrame, nodes: DataFrame, out: bool = True) -> DataFrame:
    """Edges that leave (or enter) the nodes (id), with the edges' own columns."""
    here = "src" if out else "dst"
    return edges.join(nodes.select(F.col("id").alias("__n")).distinct(), F.col(here) == F.col("__n"), "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node reachable without regard to direction, of every node of
    ``edges`` (src, dst).

    Each round takes the smallest label among neighbours (combined before the shuffle) and then the
    label of that label.  Labels only fall, so the rounds end when one changes none; tables of
    rounds before the last two are deleted."""
    spark = edges.sparkSession
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    both = written(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    start = mark(spark)
    while True:
        near = both.join(labels.hint("merge"), both["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("near"))
        met = written(labels.join(near.hint("merge"), labels["id"] == near["src"], "left").select("id", "label", F.least("label", "near").alias("new")), "labels")
        far = met.select(F.col("id").alias("new"), F.col("new").alias("far"))
        jumped = written(met.join(far.hint("merge"), "new").select("id", "label", F.least("new", "far").alias("new")), "labels")
        done = not jumped.where("new < label").limit(1).count()
        labels = jumped.select("id", F.col("new").alias("label"))
        release(spark, start, keep=1)
        if done:
            return labels


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, scc) of the nodes on cycles, self loops included; scc is the smallest member.

    Up to ``local_edges`` edges they are found on the driver.  Beyond that a weak component of up to so
    many edges is solved by the task that holds it.  In larger ones nodes without an edge in or out
    are trimmed, round by round; what is left, if still large, is coloured: the smallest node that
    reaches a node colours it; what reaches the colour's node within the colour is one component.
    Components found leave, the rest is trimmed and coloured again."""
    spark = edges.sparkSession
    every = _edges(edges)
    kind = every.schema["src"].dataType
    arrow = to_arrow_type(kind)
    loops = every.where("src = dst").select(F.col("src").alias("id"))
    left = every.where("src <> dst")
    found = spark.createDataFrame([], f"id {kind.simpleString()}, scc {kind.simpleString()}")

    def solved(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = [(i, min(m)) for m in tarjan(rows) if len(m) > 1 for i in m]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], arrow) for k in (0, 1)], ["id", "scc"])

    if left.limit(local_edges + 1).count() > local_edges:
        small, large = _parted(left, local_edges)
        if small is not None:
            found = found.unionByName(_by_part(small, solved, f"id {kind.simpleString()}, scc {kind.simpleString()}"))
        left = left.where("false") if large is None else large
    while True:
        n = left.limit(local_edges + 1).count()
        while n > local_edges:
            core = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct().hint("merge"), "id", "left_semi")
            core = written(core, "core").hint("merge")
            kept = written(left.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
            before, n = left.count(), kept.count()
            left = kept
            if n > 0.9 * before:
                break  # hardly any are trimmed any more
        if n <= local_edges:
            members = tarjan([(r["src"], r["dst"]) for r in left.collect()])  # at most ``local_edges`` rows
            own = spark.createDataFrame([(i, min(m)) for m in members if len(m) > 1 for i in m], found.schema)
            found = found.unionByName(own)
            break
        own = _coloured(left)
        found = found.unionByName(own)
        gone = own.select("id").hint("merge")
        left = written(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    found = written(found, "components")
    big = found.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    several = found.join(big.hint("merge"), "scc", "left_semi").select("id", "scc")
    alone = loops.join(several.select("id").hint("merge"), "id", "left_anti").select("id", F.col("id").alias("scc"))
    return several.unionByName(alone)


def _coloured(left: DataFrame) -> DataFrame:
    """(id, scc) of the components that hold the smallest node reaching them."""
    colour = written(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("colour", F.col("id")), "colour")
    while True:
        reach = left.join(colour.hint("merge"), left["src"] == colour["id"]).groupBy("dst").agg(F.min("colour").alias("c"))
        new = written(colour.join(reach.hint("merge"), colour["id"] == reach["dst"], "left").select("id", "colour", F.least("colour", "c").alias("new")), "colour")
        done = not new.where("new < colour").limit(1).count()
        colour = new.select("id", F.col("new").alias("colour"))
        if done:
            break
    inside = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")).hint("merge"), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("d")).hint("merge"), "dst")
    inside = written(inside.where("c = d").select("src", "dst", "c"), "inside")
    frontier = written(colour.where("id = colour").select("id", F.col("colour").alias("scc")), "scc")
    own = frontier
    while frontier.limit(1).count():
        back = frontier.join(inside.hint("merge"), (frontier["id"] == inside["dst"]) & (frontier["scc"] == inside["c"])).select(F.col("src").alias("id"), "scc").distinct()
        frontier = written(back.join(own.hint("merge"), ["id", "scc"], "left_anti"), "scc")
        own = own.unionByName(frontier)
    return written(own, "scc")


def tarjan(edges: list[tuple]) -> list[list]:
    """Strong components of a small graph, without recursion: nodes are numbered as they are entered,
    and a node whose lowest reachable number is its own closes a component."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    held: list = []
    on: set = set()
    out: list[list] = []
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    held.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(held.pop())
                        on.discard(own[-1])
                    out.append(own)
    return out


def blast_radius(edges: DataFrame, changed: DataFrame, most_depth: int = 4, names: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """Who imports the changed nodes (id): the smallest depth, the way back to the changed node, and
    a score that falls by depth.

    ``edges`` (src, dst, and ``name`` if ``names`` are given); ``names`` (id, name): exported names
    that changed, an importer of one of them at depth 1 matches; ``tests`` (id) score 5 more.  Of
    several ways to a node the shallowest wins, then one that matches, then that to the smallest
    changed node, then the smallest way.  Changed nodes themselves are left out; a node that is not
    reached has no row; self imports lead nowhere."""
    since = changed.select("id").where("id IS NOT NULL").distinct()
    named = names is not None
    back = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("next"), *(["name"] if named else []))
    hit = F.lit(False)
    if named:
        met = names.select(F.col("id").alias("at"), "name").distinct().withColumn("__m", F.lit(True))
        back = back.join(met, ["at", "name"], "left")
        hit = F.coalesce("__m", F.lit(False))
    back = written(back.groupBy("at", "next").agg(F.max(hit).alias("hit")), "back")
    frontier = written(since.select("id", F.col("id").alias("root"), F.array("id").alias("path"), F.lit(False).alias("hit")), "frontier")
    seen, found = since, None
    for depth in range(1, most_depth + 1):
        steps = frontier.select(F.col("id").alias("at"), "root", "path", F.col("hit").alias("before")).join(back, "at").join(seen.select(F.col("id").alias("next")), "next", "left_anti")
        matched = F.col("hit") if depth == 1 else F.col("before")
        best = F.min(F.struct((~matched).alias("miss"), "root", F.concat("path", F.array("next")).alias("path"))).alias("b")
        new = steps.groupBy(F.col("next").alias("id")).agg(best).select("id", F.lit(depth).cast("long").alias("depth"), "b.root", "b.path", (~F.col("b.miss")).alias("hit"))
        frontier = written(new, "frontier")
        found = frontier if found is None else found.unionByName(frontier)
        seen = seen.unionByName(frontier.select("id"))
        if not frontier.limit(1).count():
            break
    extra = F.lit(0)
    if tests is not None:
        found = found.join(tests.select("id", F.lit(5).alias("__t")).distinct(), "id", "left")
        extra = F.coalesce("__t", F.lit(0))
    base = F.when(F.col("hit") & (F.col("depth") == 1), F.lit(95)).otherwise(F.lit(70))
    return found.select("id", "depth", "root", "path", "hit", F.greatest(F.lit(6), base - 15 * (F.col("depth") - 1) + extra).cast("long").alias("score"))


def reaching(edges: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target): of the seeds (id), those that reach a target node (id), themselves included, with
    the smallest target.  Walks back from the targets, so that work grows with what reaches them; a
    node keeps one target, and goes on when it has found a smaller one."""
    edges = _edges(edges)
    best = frontier = written(targets.where("id IS NOT NULL").select("id", F.col("id").alias("target")).distinct(), "reached")
    while n := frontier.limit(FEW + 1).count():
        far = F.broadcast(frontier) if n <= FEW else frontier.hint("merge")
        new = edges.join(far, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.min("target").alias("target"))
        held = best.select("id", F.col("target").alias("had")).hint("merge")
        frontier = written(new.join(held, "id", "left").where("had IS NULL OR target < had").select("id", "target"), "reached")
        best = written(best.unionByName(frontier).groupBy("id").agg(F.min("target").alias("target")), "reached")
    return best.join(seeds.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "target")


# ---------------------------------------------------------------- the property graph of imports


def node_id(kind: str, *parts: str) -> Column:
    """A node's number from its kind and name: the same in every run, without a join."""
    return F.xxhash64(F.lit(kind), *[F.coalesce(F.col(p), F.lit("")) for p in parts])


def vertices(files: DataFrame, exports: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """id, type, path, lang, name, kind: files (file, language), exported symbols (file, name, kind) and
    layers (layer)."""
    none = lambda n: F.lit(None).cast("string").alias(n)
    out = files.select(node_id("file", "file").alias("id"), F.lit("file").alias("type"), F.col("file").alias("path"), F.col("language").alias("lang"), none("name"), none("kind")).distinct()
    out = out.unionByName(exports.select(node_id("symbol", "file", "name").alias("id"), F.lit("symbol").alias("type"), F.col("file").alias("path"), none("lang"), "name", "kind").distinct())
    return out if layers is None else out.unionByName(layers.select(node_id("layer", "layer").alias("id"), F.lit("layer").alias("type"), none("path"), none("lang"), F.col("layer").alias("name"), none("kind")).distinct())


def import_edges(imports: DataFrame) -> DataFrame:
    """src, dst, type, import_kind, source_name, local_name, type_only, owner: one edge for each name of a
    resolved import (from_file, resolved, type_only, names), one bare edge for an import of none."""
    rows = imports.where("resolved IS NOT NULL").select("from_file", "resolved", "type_only", F.explode_outer("names").alias("n"))
    typed = F.col("type_only") | F.coalesce("n.type_only", F.lit(False))
    return rows.select(
        node_id("file", "from_file").alias("src"),
        node_id("file", "resolved").alias("dst"),
        F.when(typed, F.lit("imports_as_type")).otherwise(F.lit("imports_as_value")).alias("type"),
        F.coalesce("n.kind", F.lit("side_effect")).alias("import_kind"),
        F.col("n.source_name").alias("source_name"),
        F.col("n.local_name").alias("local_name"),
        typed.alias("type_only"),
        F.col("from_file").alias("owner"),
    )


def layer_edges(placed: DataFrame) -> DataFrame:
    """Edges from files to their layers, from (file, layer); a file without a layer has none."""
    held = placed.where("layer IS NOT NULL").distinct()
    return held.select(node_id("file", "file").alias("src"), node_id("layer", "layer").alias("dst"), F.lit("in_layer").alias("type"), F.lit(None).cast("string").alias("import_kind"), F.lit(None).cast("string").alias("source_name"), F.lit(None).cast("string").alias("local_name"), F.lit(False).alias("type_only"), F.col("file").alias("owner"))


def replace_owner(edges: DataFrame, owners: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """The edges without those that the files ``owners`` (file) contributed, and with their new ones."""
    kept = edges.join(owners.select(F.col("file").alias("owner")).distinct(), "owner", "left_anti").select(*edges.columns)
    return kept if fresh is None else kept.unionByName(fresh)


def lookup(vertices: DataFrame, paths: DataFrame) -> DataFrame:
    """Vertices of the files ``paths`` (path): found by their number."""
    return vertices.join(paths.select(F.xxhash64(F.lit("file"), "path").alias("id")).distinct(), "id", "left_semi")


def incoming(edges: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """By node: whether it is taken as a namespace, by default, and the set of names taken.  ``tests``
    (id): importers whose edges count for the second triple of columns only when they are not among
    them.  The names of one node are distinct export names, so the sets are bounded by its exports."""
    rows = edges.where("type IN ('imports_as_value', 'imports_as_type')")
    rows = rows.withColumn("__t", F.lit(False)) if tests is None else rows.join(tests.select(F.col("id").alias("src"), F.lit(True).alias("__t")).distinct(), "src", "left").withColumn("__t", F.coalesce("__t", F.lit(False)))
    own = ~F.col("__t")
    ns, default = F.col("import_kind") == "namespace", (F.col("import_kind") == "default") | ((F.col("import_kind") == "named") & (F.col("source_name") == "default"))
    named = F.when((F.col("import_kind") == "named") & (F.col("source_name") != "default"), F.col("source_name"))
    return rows.groupBy(F.col("dst").alias("id")).agg(
        F.max(ns).alias("namespace"), F.max(default).alias("default"), F.array_sort(F.collect_set(named)).alias("names"),
        F.max(ns & own).alias("namespace_own"), F.max(default & own).alias("default_own"), F.array_sort(F.collect_set(F.when(own, named))).alias("names_own"),
    )
