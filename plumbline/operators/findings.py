"""Operators on findings: suppression, baselines, budgets, ranking, digests.

Defined results, unless an operator says otherwise: rows that repeat count each and are kept each; a
null key meets null keys in baselines and counts; a finding without a line is covered by directives
for its whole file only; empty tables give empty ones; other columns of the findings are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.cut import written
from plumbline.operators import bands

#: Severities, least first.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def _check_met(p: str = "p", b: str = "b") -> Column:
    """A directive without an id is for all checks."""
    return F.col(f"{b}.check_id").isNull() | (F.col(f"{p}.check_id") == F.col(f"{b}.check_id"))


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings (check_id, file, line, ...) that no directive (check_id, file, first_line,
    last_line) covers.  A directive with a null check is for all checks, one with null lines for the
    whole file.  Where findings carry ``related`` places (file, line), a directive at any of them
    covers the finding too."""
    whole, ranged = directives.where("first_line IS NULL"), directives.where("first_line IS NOT NULL")
    if "related" not in findings.columns:
        on = (F.col("p.file") == F.col("b.file")) & _check_met()
        left = bands.join(findings, ranged, on, how="left_anti")
        return left.alias("p").join(whole.alias("b"), on, "left_anti")
    keyed = written(findings.withColumn("__key", F.monotonically_increasing_id()), "findings")
    own = keyed.select("__key", "check_id", "file", "line")
    other = keyed.select("__key", "check_id", F.explode("related").alias("r")).select("__key", "check_id", "r.file", "r.line")
    places = own.unionByName(other)
    on = (F.col("p.file") == F.col("b.file")) & _check_met()
    hit = bands.join(places, ranged, on, how="left_semi").select("__key").unionByName(places.alias("p").join(whole.alias("b"), on, "left_semi").select("__key"))
    return keyed.join(hit.distinct(), "__key", "left_anti").drop("__key")


def stale_directives(directives: DataFrame, findings: DataFrame) -> DataFrame:
    """Directives that name a check and cover no finding.  A directive with null lines is for the
    whole file."""
    keyed = written(directives.withColumn("__key", F.monotonically_increasing_id()), "directives")
    on = (F.col("p.file") == F.col("b.file")) & (F.col("p.check_id") == F.col("b.check_id"))
    ranged = bands.join(findings.select("check_id", "file", "line"), keyed.where("first_line IS NOT NULL"), on).select(F.col("b.__key"))
    whole = keyed.where("first_line IS NULL").alias("b").join(findings.select("check_id", "file").alias("p"), on, "left_semi").select("__key")
    return keyed.where("check_id IS NOT NULL").join(ranged.unionByName(whole).distinct(), "__key", "left_anti").drop("__key")


def fresh(findings: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Marks findings inside a changed range (file, first_line, last_line); a range with null lines is
    the whole file.  A finding is marked by its own file and line, so rows that share a key are
    neither multiplied nor mixed up; a null file is not fresh, a null line where the whole file is."""
    places = findings.select("file", "line").distinct()
    on = F.col("p.file") == F.col("b.file")
    hit = bands.join(places, changed.where("first_line IS NOT NULL"), on, how="left_semi")
    hit = hit.unionByName(places.alias("p").join(changed.where("first_line IS NULL").alias("b"), on, "left_semi")).distinct()
    hit = hit.select(F.col("file").alias("__f"), F.col("line").alias("__l"), F.lit(True).alias("__hit"))
    met = findings.join(hit, (F.col("file") == F.col("__f")) & F.col("line").eqNullSafe(F.col("__l")), "left")
    return met.select(*[F.col(f"`{c}`") for c in findings.columns if c != "fresh"], F.coalesce("__hit", F.lit(False)).alias("fresh"))


def fresh_counts(findings: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(check_id, n) of findings in changed places, and (file, n) of the others in files that changed."""
    marked = fresh(findings, changed, "check_id")
    legacy = marked.where("NOT fresh").join(changed.select("file").distinct(), "file", "left_semi")
    return marked.where("fresh").groupBy("check_id").agg(F.count("*").alias("n")), legacy.groupBy("file").agg(F.count("*").alias("n"))


def _keys_met(a: str, b: str, key: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def baseline_tag(findings: DataFrame, baseline: DataFrame, *key: str) -> DataFrame:
    """``in_baseline``: whether the baseline holds the finding's key."""
    held = baseline.select(*key).distinct().withColumn("__b", F.lit(True)).alias("b")
    met = findings.alias("f").join(held, _keys_met("f", "b", key), "left")
    return met.select(*[F.col(f"f.`{c}`") for c in findings.columns], F.coalesce("__b", F.lit(False)).alias("in_baseline"))


def baseline_delta(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """By key: how many findings are new and how many are gone, as multisets."""
    both = before.select(*key, F.lit(1).alias("__n")).unionByName(after.select(*key, F.lit(-1).alias("__n")))
    net = both.groupBy(*key).agg(F.count_if(F.col("__n") > 0).alias("b"), F.count_if(F.col("__n") < 0).alias("a"))
    gap = F.col("a") - F.col("b")
    return net.select(*key, F.greatest(gap, F.lit(0)).alias("added"), F.greatest(-gap, F.lit(0)).alias("removed")).where("added > 0 OR removed > 0")


def would_fire_clear(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """Keys only in ``after`` (fire) and only in ``before`` (clear)."""
    side = F.collect_set("__s")  # two values at most
    both = before.select(*key, F.lit("clear").alias("__s")).unionByName(after.select(*key, F.lit("fire").alias("__s")))
    found = both.groupBy(*key).agg(side.alias("s")).where(F.size("s") == 1)
    return found.select(*key, F.get("s", 0).alias("change"))


def pruned(baseline: DataFrame, findings: DataFrame, *key: str) -> DataFrame:
    """What of the baseline still occurs."""
    return baseline.alias("b").join(findings.select(*key).distinct().alias("f"), _keys_met("b", "f", key), "left_semi")


def dual_state(baseline: DataFrame, directives: DataFrame) -> DataFrame:
    """Entries of a baseline (file, check_id, ...) that a directive in the same file silences as well,
    by its id or for all checks: once each."""
    named = directives.where("check_id IS NOT NULL").select("file", "check_id").distinct()
    whole = directives.where("check_id IS NULL").select("file").distinct()
    keyed = written(baseline.withColumn("__key", F.monotonically_increasing_id()), "baseline")
    hit = keyed.join(named, ["file", "check_id"], "left_semi").select("__key").union(keyed.join(whole, "file", "left_semi").select("__key")).distinct()
    return keyed.join(hit, "__key", "left_semi").drop("__key")


def rollup(findings: DataFrame, category: Column) -> DataFrame:
    """Counts by check and by category in one pass; the other key is null."""
    rows = findings.select("check_id", category.alias("category"))
    return rows.groupingSets([["check_id"], ["category"]], "check_id", "category").agg(F.count("*").alias("n"))


def over_budget(counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (name, budget) against counts (check_id, category, n): the check's count, else
    the category's, else 0.  One row per budget, also where a name is both."""
    checks = counts.where("check_id IS NOT NULL").groupBy(F.col("check_id").alias("name")).agg(F.sum("n").alias("__c"))
    groups = counts.where("check_id IS NULL AND category IS NOT NULL").groupBy(F.col("category").alias("name")).agg(F.sum("n").alias("__g"))
    met = budgets.join(checks, "name", "left").join(groups, "name", "left")
    return met.select("name", "budget", F.coalesce("__c", "__g", F.lit(0)).alias("actual"))


def override(severity: Column, path: Column, check_id: Column, rules: list[tuple[Column, str | None, str]]) -> Column:
    """The severity after overrides (test of the path, check or None for all, severity): the last
    that applies wins."""
    out = severity
    for test, check, value in rules:
        applies = test if check is None else test & (check_id == check)
        out = F.when(applies, F.lit(value)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """From 0 for the least; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int"), F.lit(0)) - 1


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """Findings at least as severe as ``fail_on``: a run fails if there are any."""
    return findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(fail_on))


def in_scope(findings: DataFrame, only: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Findings of the checks ``only`` and of the files (file) that a report is limited to."""
    out = findings if only is None else findings.where(F.col("check_id").isin(only))
    return out if files is None else out.join(files.select("file").distinct(), "file", "left_semi")


def ranked(findings: DataFrame) -> DataFrame:
    """In the total order: priority falling, check, file, line, key."""
    return findings.orderBy(F.desc("priority"), "check_id", "file", "line", "event_id")


def first_n(findings: DataFrame, n: int) -> DataFrame:
    """The first ``n`` in order (0: all), each with the size of the whole in ``n_all``."""
    held = ranked(findings).limit(n) if n else ranked(findings)
    return held.withColumn("n_all", findings.agg(F.count("*")).scalar())


def round_robin(items: DataFrame, provider: str, score: str, *ties: str) -> DataFrame:
    """Adds ``turn``: the item's place within its provider by falling score."""
    w = Window.partitionBy(provider).orderBy(F.desc(score), *ties)
    return items.withColumn("turn", F.row_number().over(w).cast("long"))


def budgeted(items: DataFrame, budget: int, tokens: str, place: str | list[str], least: int = 20) -> DataFrame:
    """Takes items in the order of ``place`` while they fit, passing over those that are too large.
    ``place`` must tell items apart.

    An item costs ``least`` at least, so no more than ``budget / least`` are ever taken, and the
    driver holds no more than that: it asks for the next items that could still fit, again and
    again until none could."""
    taken, left = [], budget
    place = [place] if isinstance(place, str) else place
    rest = items.withColumn("__cost", F.greatest(F.col(tokens), F.lit(least))).withColumn("__at", F.struct(*[F.col(p).isNull().alias(f"null_{p}") for p in place], *place))
    while left >= least:
        rows = rest.where(F.col("__cost") <= left).orderBy("__at").limit(left // least).collect()
        fits = []
        for r in rows:
            if r["__cost"] > left:
                break  # larger than what is left now: those after it are asked for again
            fits.append(r)
            left -= r["__cost"]
        if not fits:
            break
        taken += fits
        last = F.struct(*[F.lit(fits[-1]["__at"][f"null_{p}"]).alias(f"null_{p}") for p in place], *[F.lit(fits[-1][p]).cast(items.schema[p].dataType).alias(p) for p in place])
        rest = rest.where(F.col("__at") > last)
    return items.sparkSession.createDataFrame([tuple(r)[:-2] for r in taken], items.schema)


def digest(items: DataFrame, budget: int, tokens: str = "tokens", least: int = 20) -> DataFrame:
    """Items (check_id, title, body, score, pinned, tokens) of a digest: all pinned ones, which are
    paid first whatever they cost, then the others in turns, one of each check by its best score,
    skipping those that do not fit.

    Turn order: the item's place within its check, then score falling, check, title, body.  Adds
    ``turn`` (0: pinned)."""
    pinned = items.where("pinned").withColumn("turn", F.lit(0).cast("long"))
    spent = pinned.agg(F.coalesce(F.sum(F.greatest(tokens, F.lit(least))), F.lit(0)).alias("s")).first()["s"]  # one row
    w = Window.partitionBy("check_id").orderBy(F.desc("score"), "title", "body")
    rest = items.where("NOT pinned").withColumn("turn", F.row_number().over(w).cast("long"))
    placed = written(rest.withColumn("__low", -F.col("score")), "digest")
    return pinned.unionByName(budgeted(placed, budget - spent, tokens, ["turn", "__low", "check_id", "title", "body"], least).drop("__low"))
