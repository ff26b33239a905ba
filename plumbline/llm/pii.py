"""Personal data: patterns propose spans, checksums confirm, context words adjust the score.

Only built-in expressions.  The text between matches comes from ``split`` and the matches
from ``regexp_extract_all`` with the same pattern, so that the spans' places are running
sums of the lengths; both walk the text once.  Patterns are possessive and anchored at the
start of a run, which keeps them linear on texts without blanks.

Defined results: a null text counts as empty and has no spans; an empty table gives an
empty table; repeated rows get equal results; columns of the input that bear the name of
an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let

_WORD = r"[A-Za-z0-9._%+-]"
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def luhn_ok(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: let(
            F.substring(digits, n - i + 1, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2),
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 mod 97-10 of an upper-case IBAN without blanks: the first four characters
    go to the end, letters count 10 to 35, and the number leaves 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), (acc * 10 + ch.cast("int")) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A pattern, what must be in a text for it to match at all, the check that confirms a
    match, the score of a confirmed match, and words nearby that raise it."""

    name: str
    pattern: str
    hint: str
    confirm: Callable[[Column], Column]
    score: float
    context: tuple[str, ...]
    least: float = 0.0


KINDS = (
    Kind("email", rf"(?:(?<!{_WORD})|\G){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True), 0.9, ("mail", "contact", "kontakt", "correo", "courriel")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", lambda v: v.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"), 0.6, ("ip", "address", "host", "server", "adresse")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", lambda v: let(_only_digits(v), lambda d: F.when(F.length(d).between(13, 19), luhn_ok(d)).otherwise(F.lit(False))), 0.8, ("card", "visa", "credit", "karte", "tarjeta", "carte")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]", lambda v: F.length(_only_digits(v)).between(9, 15), 0.6, ("phone", "call", "tel", "mobile", "fax", "telefon")),
    # added by the method: confirmed by mod 97, or by the shape of a credential
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        lambda v: let(F.replace(v, F.lit(" "), F.lit("")), lambda x: F.when(F.length(x).between(15, 34), mod97_ok(x)).otherwise(F.lit(False))),
        0.9,
        ("iban", "account", "bank", "konto", "cuenta", "compte"),
    ),
    Kind("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_])(?:password|passwd|api_key|secret)=[^\x20\x09-\x0D]++", "AKIA|=", lambda v: F.lit(True), 0.9, ("key", "token", "secret", "login")),
)

#: Code points on each side of a span in which a context word raises the score by 0.1.
CONTEXT = 40


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each one.  Blocks of about the square root of the size
    keep the copying of growing arrays at n to the power 1.5."""

    def fold(a: Column, start: Column) -> Column:
        """[start, start + a0, start + a0 + a1, ...], one longer than ``a``."""
        return F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def by_blocks(a: Column) -> Column:
        n = F.size(a)

        def cut(step: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: F.slice(a, b * step + 1, step))

            def join(bs: Column) -> Column:
                sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
                return let(fold(sums, F.lit(0).cast("long")), lambda starts: F.flatten(F.transform(bs, lambda b, k: F.slice(fold(b, F.get(starts, k)), 1, F.size(b)))))

            return let(blocks, join)

        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(let(F.ceil(F.sqrt(n)).cast("int"), cut))

    return let(lengths, by_blocks)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in order; ends are exclusive, in code points."""

    def place(gaps: Column, found: Column) -> Column:
        # gap 0, match 0, gap 1, match 1, ...: the match's start is the sum of all before it
        lengths = F.transform(found, lambda v, k: (F.char_length(F.get(gaps, k)) + F.char_length(v)).cast("long"))

        def build(before: Column) -> Column:
            def one(v: Column, k: Column) -> Column:
                start = F.get(before, k) + F.char_length(F.get(gaps, k))
                near = F.lower(F.concat_ws(" ", F.right(F.get(gaps, k), F.lit(CONTEXT)), F.left(F.get(gaps, k + 1), F.lit(CONTEXT))))
                hit = near.rlike(r"(?<![a-z])(?:" + "|".join(kind.context) + r")(?![a-z])")
                return F.struct(
                    F.lit(kind.name).alias("kind"),
                    start.alias("start"),
                    (start + F.char_length(v)).alias("end"),
                    v.alias("value"),
                    F.when(hit, F.lit(min(1.0, kind.score + 0.1))).otherwise(F.lit(kind.score)).alias("score"),
                )

            return F.filter(F.transform(found, one), lambda s: kind.confirm(s["value"]) & (s["score"] >= kind.least))

        return let(running_sums(lengths), build)

    both = F.struct(F.split(text, kind.pattern).alias("g"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))
    some = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(some, let(both, lambda x: let(x["g"], lambda g: let(x["m"], lambda m: place(g, m))))).otherwise(F.array()).cast(_SPAN)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text", into: str = "pii_spans") -> DataFrame:
    """Adds the column ``into``: all confirmed spans, by kind in the order of ``kinds``, then start.
    Spans of different kinds may overlap; those of one kind do not."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()]
    return docs.select(*rest, F.concat(*[_spans(text, k) for k in kinds]).alias(into))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The same rows and columns; each confirmed span of the text reads <KIND>.

    Spans that overlap are replaced together under the kind of the first of them."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    found = find(held, kinds, into="__spans")

    def build(s: Column) -> Column:
        # a span is laid over what came before it if it starts before the largest end so far
        first = F.struct(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("done"))

        def step(acc: Column, x: Column) -> Column:
            meets = (F.size(acc["done"]) > 0) & (x["start"] < F.try_element_at(acc["done"], F.lit(-1))["end"])
            new = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
            grown = F.struct(
                F.try_element_at(acc["done"], F.lit(-1))["kind"].alias("kind"),
                F.try_element_at(acc["done"], F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(acc["done"], F.lit(-1))["end"], x["end"]).alias("end"),
            )
            return F.struct(F.when(meets, F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(grown))).otherwise(F.concat(acc["done"], F.array(new))).alias("done"))

        in_order = F.array_sort(s, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
        return F.aggregate(in_order, first, step, lambda acc: acc["done"])

    def rewrite(spans: Column) -> Column:
        text = F.col("text")
        parts = F.transform(
            spans,
            lambda x, k: F.concat(
                F.substring(text, F.coalesce(F.get(spans, k - 1)["end"], F.lit(0)).cast("int") + 1, (x["start"] - F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))).cast("int")),
                F.lit("<"),
                F.upper(x["kind"]),
                F.lit(">"),
            ),
        )
        tail = F.substring(text, F.element_at(spans, -1)["end"].cast("int") + 1, F.char_length(text))
        return F.concat(F.array_join(parts, ""), tail)

    clean = F.when(F.size("__spans") > 0, let(let(F.col("__spans"), build), rewrite)).otherwise(F.col("text"))
    out = found.select("__row", clean.alias("__clean"))
    return out.select(*[F.col("__clean").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
