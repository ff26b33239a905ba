"""Comments that say what code means: annotations, with the scope they stand for.

Defined results: an annotation after the last scope has none; several on a line count each; a null
text has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import intervals

#: Marks of annotations.
MARKS = ("@decision", "@invariant", "@why", "@warning", "@contract")


def annotations(lines: DataFrame, scopes: DataFrame | None = None, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """file, mark, text, start_line, end_line, scope from lines (path, line, text): comments that
    begin with a mark.  ``scopes`` (file, scope, first, last): the innermost that holds the line, else
    the next that starts."""
    pattern = r"\A\s*(?://+|/\*+|\*+|#+)\s*(" + "|".join(marks) + r")\b[:\s]*(.*?)\s*(?:\*/)?\s*\z"
    held = lines.where(F.col("text").rlike(pattern)).select(F.col("path").alias("file"), F.regexp_extract("text", pattern, 1).alias("mark"), F.regexp_extract("text", pattern, 2).alias("text"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    if scopes is None:
        return held.withColumn("scope", F.lit(None).cast("string"))
    keyed = held.withColumn("__key", F.struct("file", "start_line"))
    found = intervals.enclosing_scope(keyed.select("__key", "file", F.col("start_line").alias("at")).distinct(), scopes, "__key")
    return keyed.join(found.select("__key", "scope"), "__key", "left").drop("__key")


def touched(notes: DataFrame, changed: DataFrame, imports: DataFrame) -> DataFrame:
    """Annotations (file, text, start_line, end_line) that a change meets: ``how`` is 'direct' where a
    changed range (file, first_line, last_line; null lines: the whole file) overlaps the lines, else
    'importer' where a changed file imports the annotation's, with the smallest such file in ``by``."""
    from plumbline.cut import written
    from plumbline.operators import bands

    keyed = written(notes.withColumn("key", F.monotonically_increasing_id()), "annotations")
    as_bands = keyed.select("key", "file", F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"))
    ranged = bands.overlapping(as_bands, changed.where("first_line IS NOT NULL"), F.col("p.file") == F.col("b.file")).select("key")
    whole = as_bands.join(changed.where("first_line IS NULL").select("file").distinct(), "file", "left_semi").select("key")
    direct = ranged.union(whole).distinct()
    importers = imports.where("resolved IS NOT NULL AND resolved <> from_file").join(changed.select(F.col("file").alias("from_file")).distinct(), "from_file", "left_semi")
    through = importers.groupBy(F.col("resolved").alias("file")).agg(F.min("from_file").alias("by"))
    rest = keyed.join(direct, "key", "left_anti").join(through, "file").withColumn("how", F.lit("importer"))
    own = keyed.join(direct, "key", "left_semi").withColumns({"by": F.lit(None).cast("string"), "how": F.lit("direct")})
    return own.unionByName(rest.select(*own.columns)).drop("key")
