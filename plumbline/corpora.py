"""A source tree made from the driver's tables, and the lines it is made of in SQL.

Parts are files, lines of an order that follow each other are imports.  The same SQL gives the lines to
Spark, which joins them to texts and reads those back, and to DuckDB, where each line still says what
it stands for: so facts found in texts meet facts that were never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.cut import spread, written
from plumbline.facts import Facts

#: f: files.  link: imports, one for each pair of parts.  lines: (path, k, sec, ord, dst, w, flag, spec, text).
LINES_SQL = """
f AS (
  SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, replace(p_name, ' ', '_') AS nm,
    CASE p_partkey % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'data' WHEN 2 THEN 'ui' WHEN 3 THEN 'app' ELSE 'lib' END AS layer
  FROM part
),
pair AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, min(a.l_orderkey * 10 + a.l_linenumber) * 1000003 + b.l_partkey AS w, min(a.l_returnflag) AS flag
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 46 GROUP BY a.l_partkey, b.l_partkey
),
link AS (
  SELECT src, dst, w, w % 9 AS kind, flag, 'src/' || s.layer || '/m' || CAST(src AS STRING) || '.ts' AS path, 'src/' || d.layer || '/m' || CAST(dst AS STRING) || '.ts' AS dst_path,
    s.layer AS src_layer, d.layer AS dst_layer, '../' || d.layer || '/m' || CAST(dst AS STRING) || CASE WHEN w % 3 = 0 THEN '.js' ELSE '' END AS spec,
    CAST(dst AS STRING) AS d, CAST(w AS STRING) AS t
  FROM pair JOIN f s ON s.k = src JOIN f d ON d.k = dst
),
file AS (SELECT *, 'src/' || layer || '/m' || CAST(k AS STRING) || '.ts' AS path, CAST(k AS STRING) AS n FROM f),
lines AS (
  SELECT path, src AS k, 1 AS sec, w AS ord, 'import' AS what, CASE kind
    WHEN 0 THEN 'import { v' || d || '_a } from ''' || spec || ''';'
    WHEN 1 THEN 'import D' || t || ' from ''' || spec || ''';'
    WHEN 2 THEN 'import * as N' || t || ' from "' || spec || '";'
    WHEN 3 THEN 'import ''' || spec || ''';'
    WHEN 4 THEN 'import type { T' || d || ' } from ''' || spec || ''';'
    WHEN 5 THEN 'export { v' || d || '_b as r' || t || ' } from ''' || spec || ''';'
    WHEN 6 THEN 'export * from ''' || spec || ''';'
    WHEN 7 THEN 'const L' || t || ' = import(''' || spec || ''');'
    ELSE 'import { type T' || d || ', v' || d || '_b as q' || t || ' } from ''' || spec || ''';' END AS text
  FROM link
  UNION ALL SELECT path, src, 2, w, 'use', 'void ' || CASE kind WHEN 0 THEN 'v' || d || '_a' WHEN 1 THEN 'D' || t WHEN 2 THEN 'N' || t || '.x' ELSE 'q' || t END || ';'
  FROM link WHERE kind IN (0, 1, 2, 8) AND flag <> 'N'
  UNION ALL SELECT path, k, 3, 1, 'export_a', 'export const v' || n || '_a = ' || CAST(s AS STRING) || ';' FROM file
  UNION ALL SELECT path, k, 3, 2, 'export_b', 'export const v' || n || '_b = "x";' FROM file WHERE s % 2 = 0
  UNION ALL SELECT path, k, 3, 3, 'export_default', 'export default function () { return 1; }' FROM file WHERE s % 3 = 0
  UNION ALL SELECT path, k, 3, 4, 'export_type', 'export interface T' || n || ' { a: string; b: number; c' || CAST(s % 3 AS STRING) || ': boolean }' FROM file
  UNION ALL SELECT path, k, 3, 5, 'export_name', 'export function ' || nm || '() {}' FROM file WHERE k % 10 = 0
  UNION ALL SELECT path, k, 4, 1, 'ignore_console', '// plumbline-ignore: Warning.NoConsoleLog: wanted' FROM file WHERE k % 12 = 0
  UNION ALL SELECT path, k, 4, 2, 'console', '  console.log(' || n || ');' FROM file WHERE k % 6 = 0
  UNION ALL SELECT path, k, 4, 3, 'debugger', 'debugger;' FROM file WHERE k % 9 = 0
  UNION ALL SELECT path, k, 4, 4, 'eval', 'eval("1");' FROM file WHERE k % 11 = 0
  UNION ALL SELECT path, k, 4, 5, 'loose', 'if (v == w) { v(); }' FROM file WHERE k % 8 = 0
  UNION ALL SELECT path, k, 4, 6, 'long', 'const long = [' || repeat('one, ', 30) || '];' FROM file WHERE k % 13 = 0
  UNION ALL SELECT path, k, 4, 7, 'stale', '// plumbline-ignore: Warning.NoEval: gone' FROM file WHERE k % 14 = 0
  UNION ALL SELECT path, k, 4, 8, 'british', '// the colour of it' FROM file WHERE k % 5 = 0
  UNION ALL SELECT path, k, 4, 9, 'american', '// the color of it' FROM file WHERE k % 17 = 0
  UNION ALL SELECT path, k, 4, 10, 'broad', '// plumbline-ignore' FROM file WHERE k % 19 = 0
  UNION ALL SELECT path, k, 4, 11, 'text', 'const text = "y";' FROM file WHERE k % 7 = 0
  UNION ALL SELECT path, k, 4, 12, 'many', 'function many(a, b, c, d, e, f) { return a && b || c; }' FROM file WHERE k % 16 = 0
  UNION ALL SELECT path, k, 4, 13, 'block', '// plumbline-ignore-start: Warning.NoDebugger' FROM file WHERE k % 18 = 0
  UNION ALL SELECT path, k, 4, 14, 'in_block', 'debugger;' FROM file WHERE k % 18 = 0
  UNION ALL SELECT path, k, 4, 15, 'block_end', '// plumbline-ignore-end' FROM file WHERE k % 18 = 0
  UNION ALL SELECT replace(path, '.ts', '.test.ts'), k, 1, 0, 'test', 'import { v' || n || '_a } from ''./m' || n || ''';' FROM file WHERE k % 4 = 0
)"""

#: The lines with their numbers and the bytes before them: (..., line, start_byte).
NUMBERED_SQL = f"""{LINES_SQL},
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY sec, ord) AS INT) AS line,
    CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY sec, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_byte
  FROM lines
)"""

_held: dict[tuple[str, str], Facts] = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of the tree."""
    for name in ("part", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"plumbline_{name}")
    sql = f"WITH {LINES_SQL} SELECT path, sec, ord, text FROM lines".replace("FROM part\n", "FROM plumbline_part\n").replace("FROM lineitem a JOIN lineitem b", "FROM plumbline_lineitem a JOIN plumbline_lineitem b")
    lines = spark.sql(sql)
    texts = spread(lines, "path").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sec", "ord", "text"))).alias("l"))
    return texts.select("path", F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The tree's facts, extracted once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        _held[key] = Facts(written(files(spark, sf_dir), "tree"))
    return _held[key]
