"""Rules on Typst packages, over one row per package (``sources.packages``).

Defined results: a package without a manifest that can be read has no findings but a parse error; a
null field is missing; messages are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.rules.base import FINDING, quoted, said, whole_file

#: Names that say too little, and known license ids.
TOO_GENERAL = "calendar slides pdf book cv resume letter report thesis template table chart graph theme style poster invoice diagram presentation notes".split()
LICENSES = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-3.0-only AGPL-3.0-only ISC Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EUPL-1.2 Zlib 0BSD".split()

#: Priorities by severity.
PRIORITIES = {"critical": 20, "high": 15, "medium": 5, "low": -5, "info": -15}

CHECKS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def check(check_id: str, severity: str) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        CHECKS[check_id] = (severity, f)
        return f

    return add


def _at(field: str | None) -> Column:
    return F.coalesce(F.col(f"spans.{field}"), whole_file()) if field else whole_file()


def _manifest(packages: DataFrame, when: Column, message: Column, field: str | None = None) -> DataFrame:
    file = F.concat("root", F.lit("/typst.toml"))
    return packages.where(when).select(file.alias("file"), _at(field).alias("span"), message.alias("message"))


def _joined(tests: list[tuple[Column, Column]], sep: str) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(t, m) for t, m in tests])), sep)


@check("Typst.ManifestRequiredFields", "high")
def required_fields(p: DataFrame) -> DataFrame:
    missing = _joined([(F.coalesce(F.size(c), F.lit(0)) <= 0 if c == "authors" else F.col(c).isNull(), F.lit(c)) for c in ("name", "version", "entrypoint", "authors", "license", "description")], ", ")
    return _manifest(p, missing != "", said("typst.toml [package] is missing required field(s): {}", missing))


@check("Typst.PackageNameNotCanonical", "high")
def too_general(p: DataFrame) -> DataFrame:
    return _manifest(p, F.lower("name").isin(TOO_GENERAL), said("package name {} is too generic — pick something more specific", quoted("name")), "name")


@check("Typst.PackageNameKebabCase", "high")
def kebab_case(p: DataFrame) -> DataFrame:
    faults = _joined([(~F.col("name").rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z"), F.lit("must be lowercase kebab-case (letters, digits, single hyphens)")), (F.contains(F.lower("name"), F.lit("typst")), F.lit("must not contain `typst`"))], "; ")
    return _manifest(p, F.col("name").isNotNull() & (faults != ""), said("package name {} {}", quoted("name"), faults), "name")


@check("Typst.DescriptionStyle", "low")
def description_style(p: DataFrame) -> DataFrame:
    d, n = F.col("description"), F.char_length("description")
    tests = [(~d.endswith("."), F.lit("should end with a period")), (d.startswith("A ") | d.startswith("An "), F.lit("should not start with `A `/`An `"))]
    tests += [(F.contains(d, F.lit(w)), F.lit(f"should not contain `{w}`")) for w in ("package", "template", "Typst")]
    faults = _joined([*tests, (~n.between(40, 60), said("ideally 40-60 characters (got {})", n))], "; ")
    return _manifest(p, d.isNotNull() & (faults != ""), said("description style: {}", faults), "description")


@check("Typst.ManifestVersionMatchesDir", "high")
def version_of_folder(p: DataFrame) -> DataFrame:
    return _manifest(p, F.col("version") != F.col("version_dir"), said("manifest version {} does not match version directory {}", quoted("version"), quoted("version_dir")), "version")


def _places(p: DataFrame, found: Column) -> DataFrame:
    """Places (start, size) of the README, in bytes, with line and column."""
    rows = p.select("root", "readme", "name", "version", F.explode(found).alias("x"))
    before = F.substr("readme", F.lit(1), F.col("x.at"))
    start = F.octet_length(before).cast("int")
    line = (F.regexp_count(before, F.lit("\n")) + 1).cast("int")
    column = (F.octet_length(F.element_at(F.split(before, "\n"), -1)) + 1).cast("int")
    span = F.struct(start.alias("start_byte"), (start + F.octet_length("x.text")).cast("int").alias("end_byte"), line.alias("line"), column.alias("column"))
    return rows.select(F.concat("root", F.lit("/README.md")).alias("file"), span.alias("span"), "name", "version", F.col("x.text").alias("text"))


def _occurrences(text: Column, pattern: Column) -> Column:
    """Matches with the number of characters before each: texts between matches are summed up."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern) if isinstance(pattern, str) else F.expr("split(readme, __pattern)")
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.char_length(x["gap"]) + F.char_length(x["text"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(x["gap"])).alias("at"), x["text"].alias("text")))).alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


@check("Typst.ReadmeVersionMatchesManifest", "medium")
def readme_version(p: DataFrame) -> DataFrame:
    held = p.where("readme IS NOT NULL AND name IS NOT NULL AND version IS NOT NULL")
    quotable = F.regexp_replace("name", r"([^A-Za-z0-9])", r"\\$1")
    held = held.withColumn("__pattern", F.concat(F.lit("(?<=@preview/"), quotable, F.lit(":)[0-9.]+")))
    found = _places(held, _occurrences(F.col("readme"), F.col("__pattern"))).where(F.col("text") != F.col("version"))
    return found.select("file", "span", said("README import uses version {}, manifest declares {}", quoted("text"), quoted("version")).alias("message"))


@check("Typst.LicenseFileMatchesSPDX", "medium")
def license_known(p: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("license").isin(LICENSES), F.lit(False))
    message = F.when(F.col("license").isNull(), F.lit("manifest `license` field is missing")).when(~F.col("has_license"), said("LICENSE file is missing (manifest declares {})", quoted("license"))).otherwise(said("{} is not a recognised SPDX identifier", quoted("license")))
    return _manifest(p, ~(known & F.col("has_license")), message, "license")


@check("Typst.RelativeImportInPublishedReadme", "medium")
def readme_imports(p: DataFrame) -> DataFrame:
    held = p.where("readme IS NOT NULL").withColumn("__pattern", F.lit(r'#import "\.\.?/[^"]*'))
    found = _places(held, _occurrences(F.col("readme"), F.col("__pattern")))
    return found.select("file", "span", F.lit("README example imports via a relative path — use `@preview/<name>:<version>` instead").alias("message"))


@check("Typst.BundleIncludesPdf", "medium")
def pdf_in_bundle(p: DataFrame) -> DataFrame:
    rows = p.select("root", "exclude", F.explode("pdfs").alias("pdf"))
    left_out = F.exists(F.coalesce("exclude", F.array().cast("array<string>")), lambda e: F.regexp_replace(e, r"\A(\./)+", "") == F.col("pdf"))
    return rows.where(~left_out).select(F.concat_ws("/", "root", "pdf").alias("file"), whole_file().alias("span"), said("{} ships in the bundle but is not listed in [package].exclude", quoted("pdf")).alias("message"))


def _absent(p: DataFrame, column: str, name: str, message: str) -> DataFrame:
    return p.where(~F.col(column)).select(F.concat("root", F.lit(f"/{name}")).alias("file"), whole_file().alias("span"), F.lit(message).alias("message"))


@check("Typst.LicenseMissing", "high")
def license_missing(p: DataFrame) -> DataFrame:
    return _absent(p, "has_license", "LICENSE", "package directory has no LICENSE file")


@check("Typst.ChangelogMissing", "low")
def changelog_missing(p: DataFrame) -> DataFrame:
    return _absent(p, "has_changelog", "CHANGELOG.md", "package directory has no CHANGELOG.md")


def run(packages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Findings of all checks, or of ``only``."""
    out = None
    for check_id, (severity, f) in CHECKS.items():
        if only is not None and check_id not in only:
            continue
        priority = PRIORITIES[severity]
        rows = f(packages).select(F.lit(check_id).alias("check_id"), "message", "file", "span", F.lit(priority).alias("priority"), F.lit(severity).alias("severity"), F.expr(f"CAST(array() AS {FINDING.rpartition('related ')[2]})").alias("related"))
        out = rows if out is None else out.unionByName(rows)
    return out
