"""Queries over the driver's tables, by name, and the same in SQL.

The tables hold no source code; each operator runs on a stand-in of the same structure: lines of
orders are imports, events are findings, texts are files.  ``tree`` has those over a source tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.cut import new_path
from plumbline.functions import paths, texts
from plumbline.operators import findings as fi
from plumbline.operators import bands as band_joins
from plumbline.operators import graph, intervals, stats, windows
from plumbline.plans import predicate
from plumbline.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- flows between nations, and the import graph of the tree


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): nations whose suppliers sell to the other's customers."""
    line, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust, supp = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst")), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    sold = line.join(supp, line["l_suppkey"] == supp["s_suppkey"]).join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(cust, orders["o_custkey"] == cust["c_custkey"])
    return sold.select("src", "dst").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): all imports of the tree of ``corpora``, by the numbers of its files."""
    a = table(spark, sf_dir, "lineitem").where("l_quantity >= 46").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))).select("src", "dst").distinct()


FLOWS_SQL = """flows AS (SELECT DISTINCT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
EDGES_SQL = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 46)"
SEEDS = "p_partkey % 97 = 0"


@query(f"""WITH {FLOWS_SQL} SELECT e.src, e.dst, 'r' || a.n_regionkey AS src_layer, 'r' || b.n_regionkey AS dst_layer FROM flows e
JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey
WHERE a.n_regionkey <> b.n_regionkey AND b.n_regionkey <> (a.n_regionkey + 1) % 5""")
def layer_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between regions that the list of allowed pairs does not hold."""
    layers = {f"r{k}": [f"r{k}/*"] for k in range(5)}
    place = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), paths.layer_of(F.concat(F.lit("r"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey")), layers).alias("layer"))
    met = flows(spark, sf_dir).join(place.select(F.col("key").alias("src"), F.col("layer").alias("src_layer")), "src").join(place.select(F.col("key").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
    allowed = F.array(*[F.lit(f"r{k}>r{(k + 1) % 5}") for k in range(5)])
    return met.where((F.col("src_layer") != F.col("dst_layer")) & ~F.array_contains(allowed, F.concat("src_layer", F.lit(">"), "dst_layer"))).select("src", "dst", "src_layer", "dst_layer")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(SEEDS).select(F.col("p_partkey").alias("id"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS src, p_partkey AS dst FROM part WHERE {SEEDS} UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM r""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some files reach, themselves included."""
    return graph.closure(edges(spark, sf_dir), seeds=seeds(spark, sf_dir)).select("src", "dst")


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src, dst, 1 AS depth FROM edges WHERE src IN (SELECT p_partkey FROM part WHERE {SEEDS}) UNION SELECT b.src, e.dst, depth + 1 FROM b JOIN edges e ON b.dst = e.src WHERE depth < 3)
SELECT src, dst, min(depth)::INT AS depth FROM b WHERE src <> dst GROUP BY 1, 2""")
def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bounded_bfs(edges(spark, sf_dir), seeds(spark, sf_dir), 3)


@query(f"""WITH {EDGES_SQL} SELECT e.src, e.dst FROM edges e WHERE dst IN (SELECT p_partkey FROM part WHERE {SEEDS})""")
def neighbours_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), seeds(spark, sf_dir), out=False)


@query(f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
SELECT a.src AS id, least(a.src, min(b.dst)) AS scc FROM (SELECT src FROM reach WHERE src = dst) a LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.dst = y.src AND x.src = y.dst) b ON a.src = b.src GROUP BY a.src""")
def import_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles with their strong component."""
    return graph.strong_components(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES_SQL}, linked AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT src, dst FROM linked UNION SELECT r.src, b.dst FROM reach r JOIN linked b ON r.dst = b.src)
SELECT src AS id, least(src, min(dst)) AS label FROM reach GROUP BY src""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


@query("""WITH RECURSIVE sides AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), r AS (SELECT min(a) AS id FROM sides UNION SELECT CASE WHEN r.id % 2 = 0 THEN s.b ELSE s.a END FROM r JOIN sides s ON r.id = s.a OR r.id = s.b)
SELECT id, min(id) OVER () AS label FROM r""")
def trade_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that lines of orders connect, all of them: parts are even, suppliers odd."""
    return graph.components(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")))


@query(f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT p_partkey AS id FROM part WHERE {SEEDS}), b AS (SELECT id, id AS root, 0 AS depth FROM c UNION SELECT e.src, b.root, depth + 1 FROM b JOIN edges e ON e.dst = b.id AND e.src <> e.dst WHERE depth < 4),
m AS (SELECT id, min(depth) AS depth FROM b WHERE id NOT IN (SELECT id FROM c) GROUP BY id)
SELECT m.id, m.depth::BIGINT AS depth, greatest(6, 70 - 15 * (m.depth - 1) + CASE WHEN m.id % 4 = 0 THEN 5 ELSE 0 END)::BIGINT AS score FROM m""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who depends on some files, at most four steps away; every fourth file is a test."""
    tests = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"))
    return graph.blast_radius(edges(spark, sf_dir), seeds(spark, sf_dir), tests=tests).select("id", "depth", "score")


@query(f"""WITH {EDGES_SQL}, f AS (SELECT src, count(*) AS fan_out FROM edges GROUP BY 1), s AS (SELECT avg(fan_out) AS m, stddev_samp(fan_out) AS sd FROM f)
SELECT src, fan_out, round(m, 6) AS mean, round(sd, 6) AS sd FROM f, s WHERE fan_out > m + 3 * sd AND fan_out >= 2""")
def fan_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fans = edges(spark, sf_dir).groupBy("src").agg(F.count("*").alias("fan_out"))
    return stats.outliers(fans, "fan_out", sigmas=3, least_rows=2, least_value=2).select("src", "fan_out", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {EDGES_SQL} SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges UNION ALL SELECT p_partkey, 0, 0 FROM part) GROUP BY id""")
def fan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fans(edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


# ---------------------------------------------------------------- consumption, names, majorities


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def orphan_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return part.join(line.where("l_returnflag = 'R' AND l_quantity > 45"), part["p_partkey"] == line["l_partkey"], "left_anti").select("p_partkey")


@query("""SELECT p_partkey, count(*) AS total FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_type = 'ECONOMY')
GROUP BY p_partkey HAVING count(*) FILTER (WHERE l_quantity > 40) = 0""")
def dead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are sold, never in a large quantity, and whose brand is not sold as a whole."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    counts = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("total"), F.count_if(F.col("l_quantity") > 40).alias("used")).where("used = 0")
    shielded = part.where("p_size = 50 AND p_type = 'ECONOMY'").select("p_brand")
    return counts.join(part.join(shielded, "p_brand", "left_anti"), "p_partkey").select("p_partkey", "total")


@query("""WITH d AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT p_brand, p_type FROM d WHERE
NOT EXISTS (SELECT 1 FROM part p JOIN lineitem ON l_partkey = p_partkey WHERE l_discount = 0.1 AND l_returnflag = 'R' AND l_quantity > 45 AND p.p_brand = d.p_brand AND p.p_type = d.p_type)
AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = d.p_brand AND p.p_size = 49 AND p.p_name LIKE 'small%')""")
def unused_reexport(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_discount = 0.1 AND l_returnflag = 'R' AND l_quantity > 45")
    named = line.join(part, line["l_partkey"] == part["p_partkey"]).select("p_brand", "p_type")
    whole = part.where("p_size = 49 AND p_name LIKE 'small%'").select("p_brand")
    return part.select("p_brand", "p_type").distinct().join(named, ["p_brand", "p_type"], "left_anti").join(whole, "p_brand", "left_anti").select("p_brand", "p_type")


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'ECONOMY' ELSE p_type || '/Brand#1' END AS prefix FROM part WHERE p_type = 'ECONOMY' OR (p_type = 'STANDARD' AND p_brand = 'Brand#1')")
def forbid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "p_type", "p_brand", "p_name")
    prefixes = ("ECONOMY", "STANDARD/Brand#1")
    first = F.coalesce(*[F.when(paths.has_prefix(path, p), F.lit(p)) for p in prefixes])
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("prefix")).where("prefix IS NOT NULL")


@query("SELECT l_orderkey, min(l_linenumber) AS anchor FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_returnflag = 'R')")
def require_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines, none of which bears the prefix; anchored at the first line."""
    spec = F.concat_ws("/", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("anchor"), F.bool_or(paths.has_prefix(spec, "R")).alias("met")).where("NOT met").select("l_orderkey", "anchor")


@query("""SELECT doc_id, g AS glob FROM documents, (VALUES ('src1*/en/*', '^src1.*/en/.*$'), ('src[3-4]/*', '^src[3-4]/.*$')) v(g, r) WHERE regexp_matches(source || '/' || lang || '/' || doc_id, r)""")
def frozen_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each frozen glob that a path matches."""
    globs = ("src1*/en/*", "src[3-4]/*")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    hits = F.array_compact(F.array(*[F.when(paths.matches(path, g), F.lit(g)) for g in globs]))
    return table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.explode(hits).alias("glob"))


@query("""SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND NOT (regexp_matches(source, '^src1.*$') OR doc_id::VARCHAR LIKE '%7')
AND NOT (lang = 'de' AND n_chars < 100)""")
def dsl_scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted rule, compiled to one filter."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    short = F.array(F.struct(F.when(F.col("n_chars") < 100, F.lit("short")).otherwise(F.lit("long")).alias("specifier"), F.lit(None).cast("string").alias("resolved"), F.lit(False).alias("type_only")))
    facts = predicate.Facts(path=path, layer=F.col("lang"), imports=short)
    broken = predicate.violation("require dirname(file) matches 'src1*' or file matches '*7' or (file in 'de' and file imports 'short')".replace("dirname(file) matches", "file.path matches"), facts, when="file.layer == 'en' or file.layer == 'de'")
    return table(spark, sf_dir, "documents").where(broken).select("doc_id")


@query("SELECT p_name, min(p_partkey) AS p_partkey, count(*) - 1 AS n_related FROM part GROUP BY 1 HAVING count(*) >= 2")
def duplicate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicate_names(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""WITH r AS (SELECT l_suppkey, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE, 9) AS ratio FROM lineitem GROUP BY 1), s AS (SELECT avg(ratio) AS m, stddev_samp(ratio) AS sd FROM r)
SELECT l_suppkey, round(ratio, 6) AS ratio FROM r, s WHERE ratio > m + sd""")
def ratio_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 9).alias("ratio"))
    return stats.outliers(ratios, "ratio", sigmas=1, least_rows=5, least_value=0).select("l_suppkey", F.round("ratio", 6).alias("ratio"))


@query("""WITH v AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS yes, count(*) FILTER (WHERE l_returnflag <> 'R') AS no FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN yes > (yes + no) // 2 AND yes > no THEN true WHEN no > (yes + no) // 2 AND no > yes THEN false END AS majority FROM v""")
def majority_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.local_majority(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1) SELECT *, (SELECT sum(n) FROM c) >= 8 AND n > (SELECT sum(n) FROM c) // 2 AS is_majority FROM c")
def majority_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_majority(table(spark, sf_dir, "orders"), "o_orderstatus")


# ---------------------------------------------------------------- texts


_WORD_SQL = r"SELECT doc_id AS id, list_distinct(regexp_extract_all(text, '[^ \t\r\n\x0b\x0c]+')) AS tokens FROM documents WHERE text IS NOT NULL"


@query(rf"""WITH s AS ({_WORD_SQL}), k AS (SELECT list_sort(tokens) AS t, min(id) AS id, len(tokens) AS n FROM s WHERE len(tokens) > 0 GROUP BY t, n), e AS (SELECT id, n, unnest(t) AS w FROM k),
p AS (SELECT x.id AS a, y.id AS b, x.n AS xn, y.n AS yn, count(*) AS n_both FROM e x JOIN e y ON x.w = y.w AND x.id < y.id GROUP BY 1, 2, 3, 4)
SELECT a, b, n_both, (xn + yn - n_both)::BIGINT AS n_either FROM p WHERE 100 * n_both >= 80 * (xn + yn - n_both)""")
def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal word sets that are similar."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\x0B\f]+"), F.lit(0))
    return windows.similar_sets(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), words.alias("tokens")))


@query(r"""WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n\x0b\x0c]+'))) AS t FROM documents),
k AS (SELECT t, min(doc_id) AS class_id, count(*) AS n FROM s WHERE len(t) > 0 GROUP BY t), e AS (SELECT class_id, n, len(t) AS size, unnest(t) AS w FROM k),
p AS (SELECT x.class_id AS a, y.class_id AS b, y.n, x.size AS xs, y.size AS ys, count(*) AS n_both FROM e x JOIN e y ON x.w = y.w AND x.class_id <> y.class_id GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT a, sum(n) AS near FROM p WHERE 100 * n_both >= 80 * (xs + ys - n_both) GROUP BY a)
SELECT doc_id, class_id, coalesce(n - 1 + coalesce(near, 0), 0)::BIGINT AS n_links FROM s LEFT JOIN k ON s.t = k.t LEFT JOIN l ON l.a = k.class_id""")
def similarity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class in ``similarity_join`` and its number of similar documents."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\x0B\f]+"), F.lit(0))
    return windows.similar_members(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens"))).withColumnRenamed("id", "doc_id")


_LINES_SQL = r"""l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents),
w AS (SELECT doc_id, k::BIGINT AS at_, array_to_string(lines[k : k + 2], chr(10)) AS content FROM l, unnest(range(1, len(lines) - 1)) AS r(k)),
g AS (SELECT * FROM w WHERE length(content) >= 80)"""


@query(f'''WITH {_LINES_SQL} SELECT sha256(content) AS content_sha256, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min({{'d': doc_id, 'k': at_}}).d AS doc_id, min({{'d': doc_id, 'k': at_}}).k AS "at" FROM g GROUP BY content HAVING count(*) >= 2''')
def duplicate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three lines that occur at least twice."""
    return windows.repeated_windows(windows.line_windows(table(spark, sf_dir, "documents"), width=3))


@query(f"""WITH RECURSIVE {_LINES_SQL}, p AS (SELECT DISTINCT doc_id, sha256(content) AS content_sha256, at_ FROM g),
kept AS (SELECT doc_id, content_sha256, min(at_) AS "at" FROM p GROUP BY 1, 2
  UNION ALL SELECT k.doc_id, k.content_sha256, (SELECT min(p.at_) FROM p WHERE p.doc_id = k.doc_id AND p.content_sha256 = k.content_sha256 AND p.at_ >= k."at" + 3) FROM kept k WHERE k."at" IS NOT NULL)
SELECT * FROM kept WHERE "at" IS NOT NULL""")
def self_overlap_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of windows that a text repeats, without those that overlap the one kept before."""
    found = windows.line_windows(table(spark, sf_dir, "documents"), width=3).select("doc_id", F.sha2("content", 256).alias("content_sha256"), "at")
    return intervals.drop_self_overlap(found, 3, "doc_id", "content_sha256")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'))) AS signature FROM documents")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", paths.signature(F.coalesce("text", F.lit(""))).alias("signature"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, max(length(line)) AS longest, count(*) FILTER (WHERE length(line) > 120) AS n_long FROM l GROUP BY 1 HAVING max(length(line)) > 120")
def max_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.char_length)
    found = table(spark, sf_dir, "documents").select("doc_id", sizes.alias("s"))
    return found.select("doc_id", F.array_max("s").cast("long").alias("longest"), F.size(F.filter("s", lambda x: x > 120)).cast("long").alias("n_long")).where("longest > 120")


# ---------------------------------------------------------------- findings


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the type is the check, the user the file, the minute the line."""
    minute = F.timestamp_diff("MINUTE", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("check_id"), F.col("user_id").alias("file"), minute.cast("long").alias("line"), F.col("value").alias("priority"))


_FINDINGS_SQL = "f AS (SELECT event_id, event_type AS check_id, user_id AS file, date_diff('minute', TIMESTAMP '2024-01-01', ts)::BIGINT AS line, value AS priority FROM events)"
_BASE_SQL = f"{_FINDINGS_SQL}, g AS (SELECT *, check_id || ':' || floor(priority / 10)::BIGINT AS sig FROM f), old AS (SELECT * FROM g WHERE line < 20000), new AS (SELECT * FROM g WHERE line >= 12000)"


def bands(rows: DataFrame, check: str | None, before: int, after: int) -> DataFrame:
    out = rows.select("event_id", F.col("file"), (F.col("line") - before).alias("first_line"), (F.col("line") + after).alias("last_line"))
    return out.withColumn("check_id", F.lit(check)) if check else out


@query(f"WITH {_FINDINGS_SQL} SELECT event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM f d WHERE d.check_id = 'signup' AND f.check_id = 'error' AND d.file = f.file AND f.line BETWEEN d.line AND d.line + 600)")
def suppress_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings outside the blocks that directives open."""
    f = findings(spark, sf_dir)
    return fi.suppressed(f, bands(f.where("check_id = 'signup'"), "error", 0, 600)).select("event_id")


@query(f"WITH {_FINDINGS_SQL} SELECT event_id FROM f d WHERE check_id = 'signup' AND NOT EXISTS (SELECT 1 FROM f WHERE f.check_id = 'error' AND d.file = f.file AND f.line BETWEEN d.line AND d.line + 600)")
def stale_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return fi.stale_directives(bands(f.where("check_id = 'signup'"), "error", 0, 600), f).select("event_id")


@query(f"WITH {_FINDINGS_SQL} SELECT event_id, EXISTS (SELECT 1 FROM f d WHERE d.check_id = 'purchase' AND d.file = f.file AND f.line BETWEEN d.line - 30 AND d.line + 30) AS fresh FROM f WHERE check_id = 'error'")
def fresh_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return fi.fresh(f.where("check_id = 'error'"), bands(f.where("check_id = 'purchase'"), None, 30, 30).drop("event_id"), "event_id").select("event_id", "fresh")


@query(f"""WITH {_FINDINGS_SQL}, s AS (SELECT event_id AS scope, file, line AS a, line + (priority * 10)::BIGINT AS z FROM f WHERE check_id = 'view'), p AS (SELECT event_id, file, line FROM f WHERE check_id = 'click'),
i AS (SELECT p.event_id, min({{'w': z - a, 'a': a, 'scope': scope}}).scope AS scope FROM p JOIN s ON p.file = s.file AND p.line BETWEEN a AND z GROUP BY 1),
n AS (SELECT p.event_id, min({{'a': a, 'scope': scope}}).scope AS scope FROM p JOIN s ON p.file = s.file AND a > p.line GROUP BY 1)
SELECT p.event_id, coalesce(i.scope, n.scope) AS scope, CASE WHEN i.scope IS NOT NULL THEN 'inside' WHEN n.scope IS NOT NULL THEN 'next' END AS how FROM p LEFT JOIN i USING (event_id) LEFT JOIN n USING (event_id)""")
def enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    scopes = f.where("check_id = 'view'").select("file", F.col("event_id").alias("scope"), F.col("line").alias("first"), (F.col("line") + F.rint(F.col("priority") * 10).cast("long")).alias("last"))
    return intervals.enclosing_scope(f.where("check_id = 'click'").select("event_id", "file", F.col("line").alias("at")), scopes, "event_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = findings(spark, sf_dir).withColumn("sig", F.concat_ws(":", "check_id", F.floor(F.col("priority") / 10).cast("long")))
    return f.where("line < 20000"), f.where("line >= 12000")


@query(f"WITH {_BASE_SQL} SELECT event_id, EXISTS (SELECT 1 FROM old WHERE old.file = new.file AND old.check_id = new.check_id AND old.sig = new.sig) AS in_baseline FROM new")
def baseline_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return fi.baseline_tag(new, old, "file", "check_id", "sig").select("event_id", "in_baseline")


@query(f"""WITH {_BASE_SQL}, a AS (SELECT check_id, sig, count(*) AS n FROM old GROUP BY 1, 2), b AS (SELECT check_id, sig, count(*) AS n FROM new GROUP BY 1, 2)
SELECT * FROM (SELECT check_id, sig, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS removed FROM a FULL JOIN b USING (check_id, sig)) WHERE added > 0 OR removed > 0""")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.baseline_delta(*_versions(spark, sf_dir), "check_id", "sig")


@query(f"""WITH {_BASE_SQL} SELECT DISTINCT file, check_id, sig, 'fire' AS change FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.file = new.file AND old.sig = new.sig)
UNION ALL SELECT DISTINCT file, check_id, sig, 'clear' FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE old.file = new.file AND old.sig = new.sig)""")
def would_fire_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.would_fire_clear(*_versions(spark, sf_dir), "file", "check_id", "sig")


@query(f"WITH {_BASE_SQL} SELECT event_id FROM old WHERE EXISTS (SELECT 1 FROM new WHERE old.file = new.file AND old.sig = new.sig)")
def baseline_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the baseline still occurs."""
    old, new = _versions(spark, sf_dir)
    return fi.pruned(old, new, "file", "sig").select("event_id")


def _categories() -> Column:
    return F.when(F.col("check_id").isin("error", "view"), F.lit("page")).otherwise(F.lit("money"))


_CATEGORY_SQL = "CASE WHEN check_id IN ('error', 'view') THEN 'page' ELSE 'money' END"
_BUDGETS = [("error", 100), ("page", 5000), ("signup", 10**9), ("unknown", 0)]


@query(f"WITH {_FINDINGS_SQL} SELECT check_id, NULL AS category, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT NULL, {_CATEGORY_SQL}, count(*) FROM f GROUP BY 2")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.rollup(findings(spark, sf_dir), _categories())


_ACTUAL_SQL = f"""WITH {_FINDINGS_SQL}, c AS (SELECT check_id AS name, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT {_CATEGORY_SQL}, count(*) FROM f GROUP BY 1),
b AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::BIGINT)" for k, v in _BUDGETS)}) t(name, budget))"""


def _actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.over_budget(fi.rollup(findings(spark, sf_dir), _categories()), spark.createDataFrame(_BUDGETS, "name string, budget long"))


@query(f"{_ACTUAL_SQL} SELECT name, budget, coalesce(n, 0) AS actual FROM b LEFT JOIN c USING (name) WHERE coalesce(n, 0) > budget")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actual(spark, sf_dir).where("actual > budget")


@query(f"{_ACTUAL_SQL} SELECT name, least(budget, coalesce(n, 0)) AS budget FROM b LEFT JOIN c USING (name)")
def ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets after lowering; they never rise."""
    return _actual(spark, sf_dir).select("name", F.least("budget", "actual").alias("budget"))


@query(f"WITH {_FINDINGS_SQL} SELECT event_id, CASE WHEN file >= 100 AND check_id = 'error' THEN 'off' WHEN file BETWEEN 10 AND 19 THEN 'high' ELSE 'normal' END AS severity FROM f")
def override_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("u/"), F.col("file").cast("string"))
    rules = [(paths.matches(path, "u/1[0-9]", True), None, "high"), (paths.matches(path, "u/[0-9][0-9][0-9]*", True), "error", "off")]
    return findings(spark, sf_dir).select("event_id", fi.override(F.lit("normal"), path, F.col("check_id"), rules).alias("severity"))


@query(f"WITH {_FINDINGS_SQL} SELECT event_id, check_id, priority FROM f ORDER BY priority DESC, check_id, file, line, event_id")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.ranked(findings(spark, sf_dir)).select("event_id", "check_id", "priority")


@query(f"WITH {_FINDINGS_SQL} SELECT event_id, (SELECT count(*) FROM f) AS n_all FROM f ORDER BY priority DESC, check_id, file, line, event_id LIMIT 50")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty of the report, with how many there are."""
    return fi.first_n(findings(spark, sf_dir), 50).select("event_id", "n_all")


@query(f"WITH {_FINDINGS_SQL} SELECT event_id, row_number() OVER (PARTITION BY file, check_id ORDER BY priority DESC, event_id) AS turn FROM f")
def digest_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).withColumn("provider", F.concat_ws("/", "file", "check_id"))
    return fi.round_robin(f, "provider", "priority", "event_id").select("event_id", "turn")


@query("""WITH RECURSIVE i AS (SELECT doc_id, greatest(20, (length(text) + 3) // 4 + 20)::BIGINT AS tokens, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT 0::BIGINT AS n, 4000::BIGINT AS left_, NULL::BIGINT AS doc_id, NULL::BIGINT AS tokens, false AS taken
  UNION ALL SELECT i.n, CASE WHEN i.tokens <= t.left_ THEN t.left_ - i.tokens ELSE t.left_ END, i.doc_id, i.tokens, i.tokens <= t.left_ FROM t JOIN i ON i.n = t.n + 1)
SELECT doc_id, tokens FROM t WHERE taken""")
def digest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order of their numbers, as many as fit a budget of tokens."""
    items = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", (paths.token_estimate(F.col("text")) + 20).alias("tokens"))
    return fi.budgeted(items, 4000, "tokens", ["doc_id"])


_GAP = 6 * 3600


@query(f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {_GAP} SECOND THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.sessions(table(spark, sf_dir, "events"), "user_id", "ts", _GAP)


_STEPS = 7
_FILE_EVENTS = f"""SELECT 'u' || user_id AS path, CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' THEN 'accessed' ELSE 'modified' END AS kind, ts, event_type || ' ' || event_id AS text, event_id % {_STEPS} AS batch FROM events"""


def _file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", F.lit("removed")).when(F.col("event_type") == "signup", F.lit("accessed")).otherwise(F.lit("modified"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), kind.alias("kind"), F.col("ts"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), (F.col("event_id") % _STEPS).alias("batch"))


@query(f"""WITH e AS ({_FILE_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch DESC, ts DESC, kind = 'removed' DESC, text DESC) AS k FROM e WHERE kind <> 'accessed')
SELECT path AS file, text AS fact FROM r WHERE k = 1 AND kind <> 'removed'""")
def incremental_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of file events in seven batches, the first three in one run and the others in a second
    that starts from the first one's state: files change, go and come back; what is left equals the
    last event of each."""
    events = _file_events(spark, sf_dir)
    schema = "path string, kind string, ts timestamp_ntz, text string"
    facts = lambda files: files.select(F.col("path").alias("file"), F.col("text").alias("fact"))
    folder, source = new_path(spark, "watch"), new_path(spark, "events")
    for part in (range(3), range(3, _STEPS)):
        for k in part:
            events.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(source)
        state = watch.run(watch.event_files(spark, source, schema), folder, "file string, fact string", facts)
    return state.before()


@query(f"""WITH {_FINDINGS_SQL}, n AS (SELECT event_id, file, line AS a, line + 20 AS z FROM f WHERE check_id = 'view'), c AS (SELECT file, line - 30 AS a, line + 30 AS z FROM f WHERE check_id = 'purchase')
SELECT event_id FROM n WHERE EXISTS (SELECT 1 FROM c WHERE c.file = n.file AND n.a <= c.z AND c.a <= n.z)""")
def annotation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of one kind that a changed band overlaps."""
    f = findings(spark, sf_dir)
    notes = f.where("check_id = 'view'").select(F.col("event_id").alias("key"), "file", F.col("line").alias("first_line"), (F.col("line") + 20).alias("last_line"))
    changed = bands(f.where("check_id = 'purchase'"), None, 30, 30).select("file", "first_line", "last_line")
    return band_joins.overlapping(notes, changed, F.col("p.file") == F.col("b.file")).select(F.col("key").alias("event_id"))


@query(f"""WITH {_BASE_SQL} SELECT DISTINCT o.event_id FROM old o JOIN f d ON d.file = o.file AND ((d.check_id = 'signup' AND o.check_id = 'error') OR d.check_id = 'purchase') WHERE d.line % 50 = 0""")
def dual_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the baseline that a directive in the same file silences as well."""
    old, _ = _versions(spark, sf_dir)
    d = findings(spark, sf_dir).where("line % 50 = 0 AND check_id IN ('signup', 'purchase')")
    return fi.dual_state(old, d.select("file", F.when(F.col("check_id") == "signup", F.lit("error")).alias("check_id"))).select("event_id")


@query(f"""WITH {_FINDINGS_SQL}, c AS (SELECT file, line - 30 AS a, line + 30 AS z FROM f WHERE check_id = 'purchase'), m AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE c.file = f.file AND f.line BETWEEN a AND z) AS fresh FROM f)
SELECT 'check' AS what, check_id AS name, count(*) AS n FROM m WHERE fresh GROUP BY 2 UNION ALL SELECT 'file', file::VARCHAR, count(*) FROM m WHERE NOT fresh AND file IN (SELECT file FROM c) GROUP BY 2""")
def fresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    fresh, legacy = fi.fresh_counts(f, bands(f.where("check_id = 'purchase'"), None, 30, 30).drop("event_id"))
    return fresh.select(F.lit("check").alias("what"), F.col("check_id").alias("name"), "n").unionByName(legacy.select(F.lit("file").alias("what"), F.col("file").cast("string").alias("name"), "n"))


@query(rf"""WITH {_LINES_SQL}, x AS (SELECT *, regexp_replace(content, '[0-9]+', '#', 'g') AS plain FROM g)
SELECT sha256(plain) AS plain_sha256, count(*) AS n, count(DISTINCT content) AS n_contents, count(DISTINCT doc_id) AS n_docs, min({{'d': doc_id, 'k': at_}}).d AS doc_id, min({{'d': doc_id, 'k': at_}}).k AS "at" FROM x GROUP BY plain HAVING count(*) >= 2""")
def near_duplicate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three lines that are the same but for their numbers."""
    found = windows.line_windows(table(spark, sf_dir, "documents"), width=3)
    return windows.near_repeated(found, F.regexp_replace("content", "[0-9]+", "#"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n\x0c\x0b]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, k::BIGINT AS at_, array_to_string(ws[k : k + 49], ' ') AS content FROM w, unnest(range(1, len(ws) - 48)) AS r(k))
SELECT sha256(content) AS content_sha256, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min({'d': doc_id, 'k': at_}).d AS doc_id, min({'d': doc_id, 'k': at_}).k AS "at" FROM g GROUP BY content HAVING count(*) >= 2""")
def duplicate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty words that occur at least twice."""
    return windows.repeated_token_windows(table(spark, sf_dir, "documents"), 50)


@query(r"""WITH s AS (SELECT p_partkey AS id, p_type AS grp, list_distinct([p_name, p_brand, 's' || p_size % 7, 'k' || p_partkey % 3]) AS t FROM part), k AS (SELECT grp, list_sort(t) AS t, min(id) AS id, len(t) AS n FROM s GROUP BY 1, 2, 4),
e AS (SELECT id, grp, n, unnest(t) AS w FROM k), p AS (SELECT x.grp, x.id AS a, y.id AS b, x.n AS xn, y.n AS yn, count(*) AS n_both FROM e x JOIN e y ON x.grp = y.grp AND x.w = y.w AND x.id < y.id GROUP BY 1, 2, 3, 4, 5)
SELECT grp, a, b, n_both, (xn + yn - n_both)::BIGINT AS n_either FROM p WHERE 100 * n_both >= 60 * (xn + yn - n_both)""")
def jaccard_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one type that share most of what describes them."""
    tokens = F.array("p_name", "p_brand", F.concat(F.lit("s"), F.col("p_size") % 7), F.concat(F.lit("k"), F.col("p_partkey") % 3))
    return windows.jaccard_groups(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("grp"), tokens.alias("tokens")), "grp", percent=60)


@query("SELECT p_name, p_partkey, rank FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS rank FROM part) WHERE rank > 0")
def related_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.related_places(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("SELECT o_orderpriority, count(*) AS n, o_orderpriority = '1-URGENT' AS is_majority FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def majority_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_majority(table(spark, sf_dir, "orders"), "o_orderpriority", pinned="1-URGENT")


@query("SELECT quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.5) AS p50 FROM lineitem")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return spark.range(1).select(stats.nearest_rank(line, "l_extendedprice", 95).alias("p95"), stats.nearest_rank(line, "l_extendedprice", 50).alias("p50"))


@query(f"WITH {_FINDINGS_SQL} SELECT event_id FROM f WHERE CASE WHEN check_id = 'error' THEN 3 WHEN check_id = 'purchase' THEN 4 ELSE 1 END >= 3")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("check_id") == "error", F.lit("high")).when(F.col("check_id") == "purchase", F.lit("critical")).otherwise(F.lit("low"))
    return fi.gate(findings(spark, sf_dir).withColumn("severity", severity), "high").select("event_id")


@query(f"WITH {_FINDINGS_SQL} SELECT event_id FROM f WHERE check_id IN ('error', 'view') AND file IN (SELECT file FROM f WHERE check_id = 'signup' AND priority > 40)")
def report_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return fi.in_scope(f, ["error", "view"], f.where("check_id = 'signup' AND priority > 40")).select("event_id")


@query(f"""WITH {_FINDINGS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY priority DESC, event_id::VARCHAR) AS turn FROM f WHERE event_id % 500 <> 0) SELECT event_id, turn FROM p WHERE turn <= 20
UNION ALL SELECT event_id, 0 FROM f WHERE event_id % 500 = 0""")
def digest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of items of equal cost: pinned ones, then twenty turns of each of five checks."""
    f = findings(spark, sf_dir)
    pinned = table(spark, sf_dir, "events").where("event_id % 500 = 0").count()  # the budget of the query
    items = f.select("event_id", "check_id", F.col("event_id").cast("string").alias("title"), F.lit("").alias("body"), F.col("priority").alias("score"), (F.col("event_id") % 500 == 0).alias("pinned"), F.lit(20).cast("long").alias("tokens"))
    return fi.digest(items, 20 * (pinned + 100)).select("event_id", "turn")


@query(r"""SELECT doc_id, regexp_extract(coalesce(text, ''), '^[A-Z]') <> '' AS capital, length(coalesce(text, '')) > 8000 AS long, length(CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '... (truncated)' ELSE text END)::INT AS shown,
CASE WHEN coalesce(source, '') SIMILAR TO '[A-Za-z][A-Za-z0-9._]*' AND contains(source, '.') THEN true ELSE false END AS looks FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    capital = texts.leading_case(text, F.lit("x")) == "X"
    return table(spark, sf_dir, "documents").select("doc_id", capital.alias("capital"), (F.char_length(text) > 8000).alias("long"), F.char_length(texts.truncated(F.col("text"))).alias("shown"), texts.looks_like_check_id(F.col("source")).alias("looks"))


@query(r"""SELECT doc_id, (length(x) - length(replace(x, chr(10), '')) + 1)::INT AS line, (strlen(regexp_extract(x, '[^\n]*$')) + 1)::INT AS col FROM (SELECT doc_id, left(coalesce(text, ''), 300) AS x FROM documents)""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of a byte offset: that of the first 300 characters' end."""
    found = texts.line_column(F.col("text"), F.octet_length(F.left(F.coalesce("text", F.lit("")), F.lit(300))))
    return table(spark, sf_dir, "documents").select("doc_id", found["line"].alias("line"), found["column"].alias("col"))
