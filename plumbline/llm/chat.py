"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; the rest of each
conversation is a completion, with a mask that is 1 on the characters of assistant turns
and 0 elsewhere, as runs.  Only built-in expressions: conversations are gathered by id,
which is the one shuffle, and compared turn by turn in place.

Defined results: a null role reads "user", a null text "" (both count as equal to those);
turns order by number (null first), then role, then text; a conversation without partner
is kept with status "unpaired"; equal conversations have empty completions and status
"equal"; if one is a prefix of the other, its last common turn stays in the completions, so
that no completion is empty ("prefix"); an empty table gives an empty one; repeated turns
count each; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"
TRAINED_ROLES = ("assistant",)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, in order, as an array of (role, text)."""
    one = F.struct(F.col("turn").alias("n"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def mask(turns: Column) -> Column:
    """Runs (length, trained) over the rendered turns, in characters: a turn's head is not
    trained, its text and end are if an assistant speaks."""

    def runs(t: Column) -> Column:
        trained = F.when(t["role"].isin(*TRAINED_ROLES), F.lit(1)).otherwise(F.lit(0))
        head = F.char_length(t["role"]) + len(OPEN + CLOSE)
        body = F.char_length(t["text"]) + len(END)
        return F.array(F.struct(head.alias("length"), F.lit(0).alias("trained")), F.struct(body.alias("length"), trained.alias("trained")))

    return F.flatten(F.transform(turns, runs))


def common_turns(a: Column, b: Column) -> Column:
    """The number of equal turns at the start of both."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: ~(F.get(a, i - 1).eqNullSafe(F.get(b, i - 1))))
    return F.when(n < 1, F.lit(0)).otherwise(F.coalesce(F.get(differ, 0) - 1, n))


def preferences(pairs: DataFrame) -> DataFrame:
    """From pair_id, chosen and rejected (arrays of turns): the prompt, both completions with
    their masks, the number of common turns and the status."""

    def build(c: Column, r: Column) -> Column:
        def cut(n: Column) -> Column:
            shorter = F.least(F.size(c), F.size(r))
            equal = (F.size(c) == F.size(r)) & (n == F.size(c))
            at = F.when(~equal & (n == shorter) & (n > 0), n - 1).otherwise(n)

            def parts(k: Column) -> Column:
                rest = lambda x: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
                return F.struct(
                    k.cast("long").alias("prompt_turns"),
                    render(F.slice(c, 1, k)).alias("prompt"),
                    render(rest(c)).alias("chosen"),
                    mask(rest(c)).alias("chosen_mask"),
                    render(rest(r)).alias("rejected"),
                    mask(rest(r)).alias("rejected_mask"),
                    F.when(equal, F.lit("equal")).when(n == shorter, F.lit("prefix")).otherwise(F.lit("paired")).alias("status"),
                )

            return let(at, parts)

        return let(common_turns(c, r), cut)

    both = let(F.col("chosen"), lambda c: let(F.col("rejected"), lambda r: build(c, r)))
    alone = F.struct(
        F.lit(0).cast("long").alias("prompt_turns"),
        F.lit("").alias("prompt"),
        F.when(F.col("chosen").isNotNull(), render("chosen")).alias("chosen"),
        F.when(F.col("chosen").isNotNull(), mask("chosen")).alias("chosen_mask"),
        F.when(F.col("rejected").isNotNull(), render("rejected")).alias("rejected"),
        F.when(F.col("rejected").isNotNull(), mask("rejected")).alias("rejected_mask"),
        F.lit("unpaired").alias("status"),
    )
    paired = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    return pairs.select("pair_id", F.when(paired, both).otherwise(alone).alias("x")).select("pair_id", "x.*")


def branch_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a table without preferences, each from one conversation: chosen is the
    conversation up to the assistant's last turn, rejected the same with, in that turn's place,
    what the assistant had said the time before (nothing, if it spoke once).  A conversation in
    which no assistant speaks is unpaired.  A turn without conv_id is a conversation of its own."""
    whole = conversations(turns.where("conv_id IS NOT NULL")).withColumnRenamed("conv_id", "pair_id")
    t = F.col("turns")
    spoken = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.get(t, i - 1)["role"].isin(*TRAINED_ROLES))

    def pair(at: Column) -> Column:
        last, before = F.get(at, F.size(at) - 1), F.get(at, F.size(at) - 2)
        instead = F.struct(F.get(t, last - 1)["role"].alias("role"), F.coalesce(F.get(t, before - 1)["text"], F.lit("")).alias("text"))
        rejected = F.concat(F.slice(t, 1, last - 1), F.array(instead))
        spoke = F.size(at) > 0
        return F.struct(F.when(spoke, F.slice(t, 1, last)).otherwise(t).alias("chosen"), F.when(spoke, rejected).alias("rejected"))

    paired = whole.select("pair_id", let(spoken, pair).alias("x")).select("pair_id", "x.chosen", "x.rejected")
    one = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    loose = turns.where("conv_id IS NULL").select(F.col("conv_id").alias("pair_id"), F.array(one).alias("chosen"))
    return paired.unionByName(loose.withColumn("rejected", F.lit(None).cast(paired.schema["rejected"].dataType)))


def mask_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda x: F.concat_ws(":", x["length"].cast("string"), x["trained"].cast("string"))), ",")
