"""Personal data in texts: patterns propose, checksums confirm, context scores.

DataFrame functions only.  Per kind, ``regexp_extract_all`` gives the matches
and ``split`` the text between them, so positions are running sums of lengths
(in blocks of ``SUM_BLOCK``, never one growing array per match).  A match that
its validator refuses is dropped without a second try.  The words around a
match, up to ``BEFORE`` code points before and ``AFTER`` behind and not past
the next match of its kind, raise or lower its score.

Base kinds (email, ip, card, phone) keep every valid match whatever its score.
The other kinds keep those that reach ``THRESHOLD``: iban by its country's
length and the mod-97 sum, ssn by its number ranges, birth (a date) by context
alone.  Spans of different kinds may overlap.

Patterns are written so that a text is read once: an address starts where its
run of letters starts (or where the last match ended), and what cannot give
way is possessive, so neither a megabyte of letters nor a match of a megabyte
costs more than its length.

Defined results: null and empty texts have no span; positions are code points
from 0, ends exclusive; repeated rows each get their own spans; equal starts
are in the order of kinds.  There is no shuffle; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import pick

BEFORE, AFTER, THRESHOLD = 40, 20, 50
SUM_BLOCK = 32

# fixed values: length of an IBAN by country
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}


def _length_between(digits: Column, low: int, high: int) -> Column:
    return F.length(digits).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(digits)

    def add(total, k):  # k-th digit from the right
        v = F.ascii(F.substring(digits, n - k + 1, F.lit(1))) - 48
        v = F.when(k % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
        return total + v

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: country and check digits last,
    letters as 10 to 35."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(rest, k):
        c = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(c > 57, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return F.when(_length_between(digits, 12, 19), luhn(digits)).otherwise(False)


def _ip(m: Column) -> Column:
    return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def _phone(m: Column) -> Column:
    return _length_between(F.regexp_replace(m, "[^0-9]", ""), 9, 15)


def _iban(m: Column) -> Column:
    return mod97(F.replace(m, F.lit(" "), F.lit("")))


def _ssn(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """``needs`` is a text without which nothing can match; ``near`` and
    ``against`` are context words as a pattern over lower-cased letters."""

    name: str
    pattern: str
    score: int
    near: str
    valid: Callable[[Column], Column] | None = None
    needs: str | None = None
    against: str = "version|release|invoice|isbn|sku"
    base: bool = False


_EDGE, _TAIL = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_IBAN = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90,
         "e-?mail|contact|write|mailto", needs="@", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 60, "ip|address|host|server|login", _ip, needs=".", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 80, "card|visa|credit|payment|pan", _card, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 60, "phone|tel|call|mobile|fax|cell", _phone, needs="+", base=True),
    Kind("iban", f"{_EDGE}(?:{_IBAN}){_TAIL}", 80, "iban|account|bank|transfer", _iban),
    Kind("ssn", f"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_TAIL}", 30, "ssn|social security|taxpayer", _ssn, needs="-"),
    Kind("birth", f"{_EDGE}(?:19|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]){_TAIL}", 30,
         "born|birth|birthday|dob", needs="-"),
)
BOOST = 30


def context_pattern(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """id and ``spans``: array of (start, kind number, kind, end, score, base),
    ordered by start, then kind."""
    rows = pick(df, id=id_col, t=text_col)
    none, whole = F.array().cast("array<string>"), F.array().cast("array<int>")
    names = range(len(kinds))

    def has(k):
        test = F.col("t").isNotNull()
        return test & F.contains("t", F.lit(kinds[k].needs)) if kinds[k].needs else test

    # each column is used more than once by the next step, so the optimizer
    # leaves the steps apart and nothing is computed again per match
    rows = rows.select("id", "t", *[
        F.when(has(k), F.regexp_extract_all("t", F.lit(f"({kinds[k].pattern})"), F.lit(1))).otherwise(none).alias(f"hits{k}")
        for k in names])
    rows = rows.select("id", *[f"hits{k}" for k in names], *[
        F.when(F.size(f"hits{k}") > 0, F.split("t", kinds[k].pattern, -1)).otherwise(none).alias(f"gaps{k}") for k in names])

    def total(column, first, count):
        return F.aggregate(F.slice(column, first, count), F.lit(0), lambda a, x: a + x)

    def steps(k):  # from the end of one match to the end of the gap behind it
        return F.transform(f"hits{k}", lambda m, i: F.length(F.get(f"gaps{k}", i)) + F.when(
            i > 0, F.length(F.get(f"hits{k}", i - 1))).otherwise(0))

    def blocks(k):  # sums of SUM_BLOCK steps
        return F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(steps{k}) - 1) div {SUM_BLOCK} as int)")),
                           lambda b: total(f"steps{k}", b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))

    def ahead(k):  # sums of all blocks before
        return F.transform(f"blocks{k}", lambda x, b: total(f"blocks{k}", F.lit(1), b))

    rows = rows.select("*", *[F.when(F.size(f"gaps{k}") > 0, steps(k)).otherwise(whole).alias(f"steps{k}") for k in names])
    rows = rows.select("*", *[F.when(F.size(f"steps{k}") > 0, blocks(k)).alias(f"blocks{k}") for k in names])
    rows = rows.select("id", *[f"{c}{k}" for c in ("hits", "gaps", "steps") for k in names], *[
        F.when(F.size(f"blocks{k}") > 0, ahead(k)).alias(f"ahead{k}") for k in names])

    def spans(k):
        kind = kinds[k]

        def span(m, i):
            inner = i % SUM_BLOCK
            start = F.get(f"ahead{k}", F.floor(i / SUM_BLOCK).cast("int")) + total(f"steps{k}", i - inner + 1, inner + 1)
            around = F.translate(F.concat(
                F.substring(F.get(f"gaps{k}", i), F.lit(-BEFORE), F.lit(BEFORE)), F.lit(" "),
                F.substring(F.get(f"gaps{k}", i + 1), F.lit(1), F.lit(AFTER))),
                "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            return F.struct(start.alias("start"), F.lit(k).alias("number"), (start + F.length(m)).alias("end"),
                            around.alias("around"))

        def scored(s):
            score = (F.lit(kind.score) + F.when(s["around"].rlike(context_pattern(kind.near)), BOOST).otherwise(0)
                     - F.when(s["around"].rlike(context_pattern(kind.against)), BOOST).otherwise(0))
            return F.struct(s["start"], s["number"], F.lit(kind.name).alias("kind"), s["end"],
                            F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"), F.lit(kind.base).alias("base"))

        valid = F.transform(f"hits{k}", lambda m, i: F.when(
            kind.valid(m) if kind.valid else F.lit(True), span(m, i)))
        good = F.transform(F.filter(valid, lambda s: s.isNotNull()), scored)
        if not kind.base:
            good = F.filter(good, lambda s: s["score"] >= THRESHOLD)
        return F.when(F.size(f"ahead{k}") > 0, good).otherwise(F.array())

    found = F.array_sort(F.concat(*[spans(k) for k in names]))
    return rows.select(F.col("id").alias(id_col), found.alias("spans"))
