"""Quality rules as a bitmask ledger.

``evaluate`` measures every text once and stores the measurements and one
failure bit per rule.  Policies are versioned sets of rules: applying one is a
bitwise AND on the stored ledger, and ``ablations`` shows with bitwise
aggregates what each rule of a policy changes, both without touching a text
again.

Measuring is one Arrow pass without a shuffle; temporary arrays are bounded
by the slice size (or the longest text).  Null and empty texts have no words
and all measurements 0; they fail ``few_words``.  Ties and repeated rows each
get their own row.  Extra input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import pick
from finlens.llm.textops import U64, Words, mix, ngram_hashes, slices

REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
            "n_shout_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UP = np.zeros(256, bool)
_UP[65:91] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule(5, "shouting", "n_letters > 0 and 2 * n_upper > n_letters"),
    Rule(6, "exclamations", "5 * n_shout_words > n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        by_name = {r.name: r.bit for r in rules}
        return reduce(lambda m, name: m | 1 << by_name[name], self.rules, 0)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", ("few_words", "repeated_windows", "symbols")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeat_words(w: Words) -> np.ndarray:
    """Words of each text inside a 5-word window found twice or more in it."""
    grams, first = ngram_hashes(w.hashes(), w.doc_off, REPEAT_WINDOW)
    cover = np.zeros(len(w) + 1, np.int64)
    if len(grams):
        doc = np.searchsorted(w.doc_off, first, "right") - 1
        with np.errstate(over="ignore"):
            key = grams ^ mix(doc.astype(U64), 7)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        begin = first[again]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + REPEAT_WINDOW, -1)
    return _per_text(np.cumsum(cover[:-1]) > 0, w.doc_off)


def _lines(text: str | None) -> tuple[int, int]:
    lines = [x for x in (text or "").split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a slice of texts."""
    w = Words(col)
    raw, off = w.raw, w.off
    lead = (raw & 0xC0) != 0x80
    up, low = _UP[raw], _LOW[raw]
    lines = np.array([_lines(t) for t in col.to_pylist()], np.int64).reshape(-1, 2)
    shout = np.zeros(len(w), bool)
    if len(w):
        tail = np.maximum(w.end - 2, w.start)
        shout = (raw[w.end - 1] == 33) & (raw[tail] == 33)
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": _per_text(lead & w.word, off),
        "n_symbols": _per_text(_SYMBOL[raw], off),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _repeat_words(w),
        "n_lines": lines[:, 0],
        "n_upper": _per_text(up, off),
        "n_letters": _per_text(up | low, off),
        "n_shout_words": _per_text(shout, w.doc_off),
    }


def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    fields = [pa.field(m, pa.int64()) for m in MEASURES]
    for col in batches:
        parts = [measure(s.column(0)) for s in slices(pa.record_batch([col], ["t"]), "t")]
        arrays = [pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64()) for m in MEASURES]
        yield pa.StructArray.from_arrays(arrays, fields=fields)


def evaluate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger: id, measurements, ``fail_mask`` (bit r set: rule r failed)."""
    measures = F.arrow_udf(_measures, "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    ledger = pick(df, _id=id_col, _t=text_col).select(F.col("_id").alias(id_col), measures("_t").alias("_m"))
    ledger = ledger.select(id_col, *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    mask = reduce(
        lambda acc, r: acc.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0))),
        rules, F.lit(0),
    )
    return ledger.withColumn("fail_mask", mask.cast("bigint"))


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(ledger: DataFrame, policies: Sequence[Policy] = POLICIES,
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: rows kept by the policy, rows the rule fails, rows
    only this rule rejects (what dropping it would let in), and the bitwise OR
    of the other failures among the rows it fails.  Bounded: one row per
    (policy, rule)."""
    picks = [(p, r) for p in policies for r in rules if r.name in p.rules]
    aggs = []
    for i, (p, r) in enumerate(picks):
        hit = F.col("fail_mask").bitwiseAND(F.lit(p.mask(rules)))
        mine = hit.bitwiseAND(F.lit(1 << r.bit)) != 0
        aggs += [
            F.count_if(hit == 0).alias(f"kept_{i}"),
            F.count_if(mine).alias(f"failed_{i}"),
            F.count_if(hit == (1 << r.bit)).alias(f"only_{i}"),
            F.coalesce(F.bit_or(F.when(mine, hit.bitwiseAND(F.lit(~(1 << r.bit))))), F.lit(0)).alias(f"with_{i}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"),
                 F.col(f"kept_{i}").alias("n_kept"), F.col(f"failed_{i}").alias("n_failed"),
                 F.col(f"only_{i}").alias("n_only"), F.col(f"with_{i}").cast("bigint").alias("other_mask"))
        for i, (p, r) in enumerate(picks)
    ])
    return ledger.agg(*aggs).select(F.inline(rows))
