"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Everything is built from SQL functions. A pattern's matches are put between two private marks, the marked text is
split at them, and lengths of the parts give positions in code points; texts without a cheap sign of a kind (an
at-sign, a plus, twelve digits) skip that kind. No row needs another row, so nothing is shuffled and no document
meets another in a task.

Cases: a null text counts as empty and has no spans; texts holding the private marks themselves are searched with
the marks replaced by another character of the same length; extra columns are kept by `find_spans` and `redact`,
and one whose name is that of a new column is replaced; repeated rows are treated one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.words import text_of

OPEN, CLOSE = "\ue000", "\ue001"
SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>"
# A span outside the four base kinds is reported from this score on.
LEAST_SCORE = 0.5
CONTEXT_CHARS = 48


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn checksum."""
    back = F.reverse(digits)

    def weighed(i: Column) -> Column:
        v = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weighed(i))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number in international form leaves the remainder 1."""
    code = F.upper(F.regexp_replace(account, " ", ""))
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def add(a: Column, i: Column) -> Column:
        v = F.ascii(F.substring(turned, i, F.lit(1))).cast("long")
        return F.when(v >= 65, (a * 100 + (v - 55)) % 97).otherwise((a * 10 + (v - 48)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0).cast("long"), add) == 1


def _small_parts(m: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3
    return F.forall(F.split(m, r"\."), lambda p: part(p) & (F.substring(p, -3, 3).cast("int") <= 255))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. Repetitions are possessive where nothing follows them, so long runs need no stack."""

    name: str
    pattern: str
    sign: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    base: bool
    score: float
    context: str


# The base patterns and what their matches must satisfy are given by the contract of the operator.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), True, 0.9, r"mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
         lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _small_parts, True, 0.6, r"\bip\b|address|host|server|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
         lambda m: F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False), True, 0.7,
         r"card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), True, 0.6,
         r"phone|call|\btel|mobile|fax|anruf|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
         lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), mod97, False, 0.8, r"iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
         lambda m: ~m.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$"), False, 0.3, r"social|security|\bssn\b|taxpayer"),
]
BASE = [k.name for k in KINDS if k.base]


def _matches(text: Column, kind: Kind, number: int) -> Column:
    """The valid matches of one kind as an array of spans in the order of the text."""
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, "\ufffd\ufffd"), kind.pattern, OPEN + "$0" + CLOSE)
    parts = F.split(marked, f"[{OPEN}{CLOSE}]")
    state = "struct<at:bigint,inside:boolean,found:array<struct<start:bigint,end:bigint,hit:string>>>"
    start = F.from_json(F.lit('{"at":0,"inside":false,"found":[]}'), state)

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        hit = F.struct(a["at"].alias("start"), end.alias("end"), p.alias("hit"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"),
                        F.when(a["inside"], F.concat(a["found"], F.array(hit))).otherwise(a["found"]).alias("found"))

    found = F.filter(F.aggregate(parts, start, step)["found"], lambda h: kind.valid(h["hit"]))

    def scored(h: Column) -> Column:
        first = F.greatest(h["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, (first + 1).cast("int"), (h["start"] - first).cast("int")))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0))
        return F.struct(h["start"].alias("start"), F.lit(number).alias("kind_no"), h["end"].alias("end"),
                        F.lit(kind.name).alias("kind"), score.alias("score"))

    spans = F.transform(found, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(kind.sign(text), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(df: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add the spans of all kinds, ordered by start, then kind: start and end in code points, kind, score from 0 to 1."""
    text = text_of(F.col(f"`{text_col}`"))
    return df.withColumn(out, F.array_sort(F.concat(*[_matches(text, k, i) for i, k in enumerate(KINDS)])))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Replace every span by its kind in angle brackets; spans that overlap become one. A null text stays null."""
    text = F.col(f"`{text_col}`")

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"))
        longer = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(longer)

    def finish(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))

    start = F.from_json(F.lit('{"at":0,"out":[]}'), "struct<at:bigint,out:array<string>>")
    clean = F.aggregate(F.col(f"`{spans_col}`"), start, step, finish)
    return df.withColumn(text_col, F.when(F.size(F.col(f"`{spans_col}`")) > 0, clean).otherwise(text))


def digest(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans, all spans as text, the best score."""
    spans = F.col("pii_spans")
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind_no"] < len(BASE))
    return find_spans(df.select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, written), ",").alias("spans"),
        F.array_max(F.transform(spans, lambda s: s["score"])).alias("best_score"))
