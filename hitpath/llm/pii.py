"""Personal data in texts, by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans, checks of numbers confirm or drop them, and words near
a span raise its score. Spans of the four base kinds that pass their check are
always reported; those of further kinds need a score. An account number has it
by its strong check alone; a routing number, whose check every tenth number of
nine digits passes, only with a word near it that says what it is.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitpath.llm.common import free_name

NEAR = 40
LEAST_SCORE = 0.7
SPAN = "array<struct<start:int,end:int,value:string,score:double>>"


class Kind(NamedTuple):
    """``guard`` is a cheap test that every text with a match passes; ``words`` are those that raise the score.

    ``check`` is what passing the check adds to the score of the pattern.
    """

    name: str
    pattern: str
    guard: str
    words: str
    check: float
    base: bool


#: Score of a match, and what a word near it adds.
PATTERN_SCORE, WORD_SCORE = 0.5, 0.2

# The lengths of international bank account numbers, and the countries that have them.
ACCOUNT_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _account_pattern() -> str:
    """Numbers of the length of their country, so that a word behind one is never taken for its end."""
    kinds = (f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in ACCOUNT_LENGTHS.items())
    return f"(?<![A-Za-z0-9])(?:{'|'.join(kinds)})(?![A-Za-z0-9])"


#: The patterns are the plain ones, made linear: possessive repetition where what follows cannot be part of
#: it, and matches that begin where a run begins or the match before has ended, as leftmost ones do.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", "mail|contact|write to|courriel|correo|kontakt", 0.2, True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]", r"\bip\b|address|host|server|adresse|direcci", 0.3, True,
    ),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "[0-9](?:[ -]?[0-9]){15}", "card|visa|credit|carte|karte|tarjeta", 0.3, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax|anruf|llam", 0.2, True),
    Kind(
        "iban", _account_pattern(), "[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "iban|account|bank|konto|compte|cuenta", 0.3, False,
    ),
    Kind(
        "routing",
        "(?<![0-9A-Za-z+.-])[0-9]{9}(?![0-9A-Za-z]|[.-][0-9])",
        "[0-9]{9}", r"routing|\baba\b|bank|account|transfer|konto|compte|virement|cuenta", 0.1, False,
    ),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{small}(?:\.{small}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "routing":
        digit = lambda i: F.substring(value, i + 1, 1).cast("int")
        return (sum((3, 7, 1)[i % 3] * digit(i) for i in range(9)) % 10 == 0) & (value != "0" * 9)
    return F.lit(True)


def _found(text: Column, kind: Kind) -> Column:
    """The confirmed matches with their places in code points, from the pieces between matches."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), hits.alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        more = F.when(_confirmed(kind.name, pair["hit"]), F.concat(acc["found"], F.array(one)))
        return F.struct(end.alias("at"), F.coalesce(more, acc["found"]).alias("found"))

    return F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), empty, step, lambda acc: acc["found"])


def spans(text: Column, kind: Kind, least: float = LEAST_SCORE, near: int = NEAR) -> Column:
    """The confirmed spans of a kind, ``start`` and exclusive ``end`` in code points, with value and score."""

    def scored(s: Column) -> Column:
        around = F.lower(
            F.concat_ws(" ", F.substring(text, F.greatest(s["start"] - near, F.lit(0)) + 1, F.least(s["start"], F.lit(near))),
                        F.substring(text, s["end"] + 1, F.lit(near)))
        )
        score = F.round(F.lit(PATTERN_SCORE + kind.check) + F.when(around.rlike(kind.words), WORD_SCORE).otherwise(0.0), 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    found = F.transform(_found(text, kind), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= least)
    there = F.contains(text, F.lit(kind.guard)) if kind.guard == "@" else text.rlike(kind.guard)
    return F.when(there, found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def detect(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with an array of spans per kind, called ``pii_<kind>``. A null text has none."""
    kept = [c for c in docs.columns if c not in {f"pii_{k.name}" for k in KINDS}]
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*kept, *(spans(text, k, least).alias(f"pii_{k.name}") for k in KINDS))


def _listed(kinds: list[Kind]) -> Column:
    def texts(name: str) -> Column:
        place = lambda s: F.concat_ws(":", F.lit(name), s["start"].cast("string"), s["end"].cast("string"))
        return F.transform(f"pii_{name}", place)

    return F.array_join(F.concat(*(texts(k.name) for k in kinds)), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document, with the scores of the spans in the same order.

    Rows are independent of each other: rows that repeat an id, or have none,
    are reported one by one, an empty table gives an empty one, and a null or
    empty text has no spans. Texts are searched whole; the places found in one are gathered in
    an array that grows span by span. Columns other than id and text are not
    read.
    """
    base = [k for k in KINDS if k.base]
    return detect(docs.select("doc_id", "text")).select(
        "doc_id",
        *(F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(list(KINDS)).alias("spans"),
        F.array_join(F.concat(*(F.transform(f"pii_{k.name}", lambda s: s["score"].cast("string")) for k in KINDS)), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, the longest of spans that begin together.

    A span that begins inside one already replaced is merged into it. A null
    text stays null. Other columns and the rows stay as they are.
    """
    all_ = free_name(docs.columns, "_pii")

    def named(name: str) -> Column:
        place = lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{name}]").alias("tag")
        )
        return F.transform(F.col(all_)[name], place)

    every = F.array_sort(F.concat(*(named(k.name) for k in KINDS)))
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(
            F.greatest(acc["at"], -s["back"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    whole = F.coalesce(text, F.lit(""))
    found = docs.withColumn(all_, F.struct(*(spans(whole, k).alias(k.name) for k in KINDS)))
    any_ = reduce(lambda a, b: a | b, (F.size(F.col(all_)[k.name]) > 0 for k in KINDS))
    clean = F.when(any_, F.aggregate(every, begin, step, rest)).otherwise(text)
    return found.withColumn("text", clean).select(*docs.columns)
