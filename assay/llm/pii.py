"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Only SQL functions are used, so everything stays in the JVM. Positions are code points. They
follow from the lengths of the matches and of the gaps between them, which ``split`` gives with
the same pattern.

Four base kinds (``email ip card phone``) are kept whenever their own test holds. Two more
kinds are kept from a score of ``THRESHOLD`` on: ``iban`` (mod-97 confirms) and ``secret`` (a
long run of letters and digits, confirmed by a word such as "token" in front of it).

Null and empty texts have no spans. Repeated rows are repeated in the result. Columns other
than the key and the text are not read, so their names can not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in front of a span in which context words count.
CONTEXT = 40
THRESHOLD = 0.6
#: Matches in a block of the running sums.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """``pattern`` never goes back over what it has read: runs are possessive and begin where
    the match before ended or where no character of the run stands in front."""

    name: str
    guard: str  # a text without it has no match
    pattern: str
    context: str
    score: float
    base: bool


KINDS = (
    Kind(
        "email", "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"e-?mail|contact|write|reply|correo|courriel", 0.8, True,
    ),
    Kind("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"\bip\b|addr|host|server|login", 0.5, True),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", r"card|visa|credit|karte|carte|tarjeta|pay", 0.7, True),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", r"phone|tel|call|mobile|fax", 0.6, True),
    Kind(
        "iban", "",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        r"iban|account|konto|compte|cuenta|bank", 0.7, False,
    ),
    Kind(
        "secret", "",
        r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+",
        r"token|secret|passw|api.?key|access.?key|bearer", 0.3, False,
    ),
)


def _fold(numbers: Column, first: Column) -> Column:
    """Running sums that begin at ``first``."""
    return F.aggregate(
        numbers,
        F.struct(first.alias("sum"), F.array().cast("array<long>").alias("sums")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + x)).alias("sums")),
        lambda a: a["sums"],
    )


def _blocks(numbers: Column) -> Column:
    """The numbers in blocks, so that the arrays that grow in a fold stay short."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)),
    )


def _running(blocks: Column) -> Column:
    """Sums of all numbers up to and including each one."""
    zero = F.lit(0).cast("long")
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, zero, lambda a, x: a + x))
    before = F.slice(F.concat(F.array(zero), _fold(sums, zero)), F.lit(1), F.size(blocks))
    return F.flatten(F.zip_with(blocks, before, _fold))


def _confirmed(kind: str, match: Column) -> Column:
    """The checksum or range that a match of the kind has to pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        # luhn_check works on the digits as text; longer numbers are left out first
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))
        step = lambda a, c: F.when(
            c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97
        ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
        return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.length(match) <= 128)
    return F.lit(True)


def _score(kind: Kind, text: Column, start: Column) -> Column:
    begin = F.greatest(start - CONTEXT, F.lit(0).cast("long"))
    near = F.substr(text, (begin + 1).cast("int"), (start - begin).cast("int"))
    return F.round(F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), 0.3).otherwise(0.0), 2)


def _alone(text: Column, start: Column, end: Column) -> Column:
    """No letter or digit touches the span."""
    before = F.when(start > 0, F.substr(text, start.cast("int"), F.lit(1))).otherwise("")
    after = F.substr(text, (end + 1).cast("int"), F.lit(1))
    return ~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]")


def _spans(kind: Kind, matches: Column, ends: Column, text: Column) -> Column:
    """The confirmed spans of one kind, from its matches and where they end."""
    placed = F.zip_with(
        matches,
        ends,
        lambda m, e: F.struct(m.alias("match"), (e - F.length(m)).alias("start"), e.alias("end")),
    )

    def keep(s: Column) -> Column:
        sound = _confirmed(kind.name, s["match"])
        return sound & _alone(text, s["start"], s["end"]) if kind.name == "iban" else sound

    scored = F.transform(
        F.filter(placed, keep),
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            _score(kind, text, s["start"]).alias("score"),
        ),
    )
    return scored if kind.base else F.filter(scored, lambda s: s["score"] >= THRESHOLD)


def with_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``spans``, an array of ``(kind, start, end, score)`` by kind and start.

    Every step is a column of its own: nested in one expression, the inner arrays would be
    made again for each use.
    """

    def matches(kind: Kind) -> Column:
        there = F.instr(text, kind.guard) > 0 if kind.guard else F.col(text).rlike("[0-9]")
        found = F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0))
        return F.when(there, found).otherwise(F.array().cast("array<string>"))

    def lengths(kind: Kind, found: Column) -> Column:
        gaps = F.slice(F.split(F.col(text), kind.pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(found, gaps, lambda m, g: (F.length(m) + F.length(g)).cast("long"))

    def step(out: DataFrame, to: str, of: str, make, kind_of: str) -> DataFrame:
        none = F.array().cast(kind_of)
        some = lambda k: F.size(f"_{of}_{k.name}") > 0
        return out.withColumns({f"_{to}_{k.name}": F.when(some(k), make(k)).otherwise(none) for k in KINDS})

    col = lambda name, k: F.col(f"_{name}_{k.name}")
    out = rows.withColumns({f"_m_{k.name}": matches(k) for k in KINDS})
    out = step(out, "n", "m", lambda k: lengths(k, col("m", k)), "array<long>")
    out = step(out, "b", "n", lambda k: _blocks(col("n", k)), "array<array<long>>")
    out = step(out, "e", "b", lambda k: _running(col("b", k)), "array<long>")
    spans = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    out = step(out, "s", "e", lambda k: _spans(k, col("m", k), col("e", k), F.col(text)), spans)
    out = out.withColumn("spans", F.concat(*[col("s", k) for k in KINDS]))
    return out.drop(*[f"_{x}_{k.name}" for x in "mnbes" for k in KINDS])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, spans)`` of every row; ``text`` is the empty text where it was null."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_spans(rows)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``<KIND>``; of overlapping spans the first to begin
    (then the longest) gives the name, and all their characters go."""
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.upper(s["kind"]).alias("kind")),
        )
    )
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")
    )

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        more = F.when(fresh, F.concat(a["parts"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">"))))).otherwise(a["parts"])
        return F.struct(F.greatest(a["at"], -s["back"]).alias("at"), more.alias("parts"))

    done = lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int")))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, done)).otherwise(text)
