"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the row's own text, so the scan, the
measures and the verdict are one stage without a shuffle and without user functions.

Defined results: a null text counts as empty; an empty or blank text has no words and
fails the base rule; all columns of the input are kept unless one bears a measure's
name, which the measure replaces; repeated rows are judged alike; an empty table gives
an empty table with the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, words_of

STOP_WORDS = tuple(
    (
        "a an and are as at be by for from has he in is it its of on or that the this to was were will with not but have had you which their "
        "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous est "
        "der die das den dem des ein eine einer einem einen und oder aber ist sind war im mit von zu zum zur auf für als auch an aus bei nach nicht sich sie er es wir ihr ich so wie "
        "el los las lo al del y o pero es son fue con por para sin sobre su sus una unos unas como más ya se le les nos no si"
    ).split()
)


@dataclass(frozen=True)
class Limit:
    """A document fails if the measure lies outside [least, most]; measures are per document."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Lengths, symbol, stop-word and line ratios; a document is kept if all hold.
LIMITS = (
    Limit("n_words", least=50, most=100_000),
    Limit("mean_word_chars", least=2.0, most=12.0),
    Limit("symbol_ratio", most=0.10),
    Limit("mark_ratio", most=0.50),
    Limit("upper_ratio", most=0.50),
    Limit("stop_ratio", least=0.02),
    Limit("dup_line_ratio", most=0.40),
    Limit("repeat_word_ratio", most=0.50),
)

#: What a document needs to stay in a corpus: the same without the bound on length, which is no fault.
KEEP_LIMITS = tuple(replace(x, most=None) if x.measure == "n_words" else x for x in LIMITS)


def _n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array.

    Windows are sorted by (hash, place); equal neighbours repeat.  Of the sorted places
    of repeated windows each covers min(3, gap to the next) words: n log n per text."""
    n = F.size(words)
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def places(a: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            before, after = F.get(a, k - 1)["h"], F.get(a, k + 1)["h"]
            return F.when(before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"]), x["i"])

        return F.sort_array(F.array_compact(F.transform(a, repeated)))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    return F.when(n < 4, F.lit(0)).otherwise(let(let(F.sort_array(hashed), places), covered))


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text by name; ``words`` is evaluated once."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _n_repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        )

    without = lambda pattern: F.char_length(whole) - F.char_length(F.regexp_replace(whole, pattern, ""))
    return {
        "of_words": let(words_of(text), of_words),
        "of_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "n_symbols": without(r"[#*$%&|<>]+").cast("long"),
        "n_marks": without(r"[!?;:]+").cast("long"),
        "n_upper": without(r"\p{Lu}+").cast("long"),
    }


def judge(docs: DataFrame, limits: tuple[Limit, ...] = LIMITS, text_col: str = "text") -> DataFrame:
    """Adds the counts, the ratios, ``base_failed``, ``failed_rules`` and ``kept``.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word
    windows.  kept: not base_failed, and every limit of the table holds."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules", "ratios"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    m = measures(F.col(f"`{text_col}`"))
    counted = docs.select(*rest, F.struct(*[v.alias(k) for k, v in m.items()]).alias("__m"))
    w = {k: F.col(f"__m.of_words.{k}") for k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
    w |= {k: F.col(f"__m.of_lines.{k}") for k in ("n_lines", "n_dup_lines")}
    w |= {k: F.col(f"__m.{k}") for k in ("n_symbols", "n_marks", "n_upper")}
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    value = {
        "n_words": w["n_words"].cast("double"),
        "mean_word_chars": share(w["word_chars"], w["n_words"]),
        "symbol_ratio": share(w["n_symbols"], w["n_words"]),
        "mark_ratio": share(w["n_marks"], w["n_words"]),
        "upper_ratio": share(w["n_upper"], w["word_chars"]),
        "stop_ratio": share(w["n_stop_words"], w["n_words"]),
        "dup_line_ratio": share(w["n_dup_lines"], w["n_lines"]),
        "repeat_word_ratio": share(w["n_repeat_words"], w["n_words"]),
    }
    fails = []
    for x in limits:
        out = F.lit(False)
        if x.least is not None:
            out = out | (value[x.measure] < x.least)
        if x.most is not None:
            out = out | (value[x.measure] > x.most)
        fails.append((x.measure, out))
    base = (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"])
    return counted.select(
        *[F.col(f"`{c}`") for c in counted.columns if c != "__m"],
        *[w[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in fails])).alias("failed_rules"),
        F.struct(*[v.alias(k) for k, v in value.items()]).alias("ratios"),
        (~base & ~_any([x for _, x in fails])).alias("kept"),
    )


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def keep_good(docs: DataFrame, limits: tuple[Limit, ...] = KEEP_LIMITS) -> DataFrame:
    """The documents that pass, however long, with the columns of the input."""
    own = [f"`{c}`" for c in docs.columns]
    judged = judge(docs.select(F.struct(*own).alias("__row"), F.col("text")), limits)
    return judged.where("kept").select(*[F.col(f"__row.`{c}`") for c in docs.columns])
