"""URL filter: weighted vocabulary counted by Aho-Corasick, under host rules.

One automaton finds every vocabulary term in the lower-cased URL in a single
pass; a hit counts only when the characters on both sides are not ASCII
letters or digits.  One strict term, or ``soft_limit`` distinct soft terms,
block the URL.  A host/path rule that fits takes precedence over the
vocabulary; of several, the longest wins.

Hosts, paths and rules are JVM expressions; only the term counts run in
Python (Arrow batches).  There is no shuffle: every row is judged alone.  The
terms may come from a table of up to ``MAX_TERMS`` rows (``vocabulary``); the
automaton is built once and broadcast.  ``STRICT_TERMS`` and ``SOFT_TERMS``
are a small example vocabulary.

Defined results: a null URL, or one without ``://``, has empty host and path,
no rule, and (as nothing is counted in a null URL) the verdict ``allow`` when
no term is found.  Repeated rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import pick

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STRICT_TERMS = ("adult", "casino", "escort", "hentai", "porn", "porno", "sex", "viagra", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "cialis", "click", "farm", "free", "jackpot", "loan",
    "loans", "lottery", "pharma", "pills", "poker", "slots", "spam", "track", "tracker", "win",
)
SOFT_LIMIT = 2
MAX_TERMS = 1_000_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, lower-cased.
    Path: from there up to ``? #`` or the end."""
    rest = F.when(url.contains("://"), F.expr("substring(_u, locate('://', _u) + 3)")).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_column(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule ``(verdict, host, path)`` that
    fits; both null when none does."""
    name = verdict = F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def vocabulary(terms: DataFrame, term_col: str = "term", strict_col: str = "strict") -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table, lower-cased (A-Z), each once; a term
    listed as both is strict, null and empty terms are passed over.  More than
    ``MAX_TERMS`` distinct terms are an error."""
    rows = terms.select(ascii_lower(F.col(term_col)).alias("term"), F.coalesce(F.col(strict_col), F.lit(False)).alias("strict"))
    rows = rows.where("term <> ''").groupBy("term").agg(F.max("strict").alias("strict")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return tuple(sorted(r["term"] for r in rows if r["strict"] == kind) for kind in (True, False))


def _term_counter(sc, strict: Sequence[str], soft: Sequence[str]):
    terms = [*strict, *soft]
    machine = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        if term not in machine:  # of equal terms the first, so strict before soft
            machine.add_word(term, (i, len(term)))
    if terms:
        machine.make_automaton()
    shared = sc.broadcast(machine if terms else None)

    n_strict = len(strict)
    result = pa.struct([("n_strict", pa.int32()), ("n_soft", pa.int32())])

    @F.arrow_udf("struct<n_strict:int,n_soft:int>")
    def count_terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = shared.value
        for urls in batches:
            hard, mild = [], []
            for url in urls.to_pylist():
                found = set()
                if url and machine is not None:
                    last = len(url) - 1
                    for end, (i, size) in machine.iter(url):
                        at = end - size
                        left = at < 0 or not (url[at].isascii() and url[at].isalnum())
                        right = end == last or not (url[end + 1].isascii() and url[end + 1].isalnum())
                        if left and right:
                            found.add(i)
                n = sum(i < n_strict for i in found)
                hard.append(n)
                mild.append(len(found) - n)
            yield pa.StructArray.from_arrays(
                [pa.array(hard, pa.int32()), pa.array(mild, pa.int32())], fields=list(result))

    return count_terms


def judge_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = (),
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, n_strict, n_soft
    (distinct terms found).  Other input columns are left out."""
    rows = pick(df, **{id_col: id_col, "_u": url_col})
    host, path = host_and_path(F.col("_u"))
    counts = _term_counter(df.sparkSession.sparkContext, list(strict), list(soft))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"),
                       counts(ascii_lower(F.col("_u"))).alias("_n"))
    rule, ruled = rule_column(rules, F.col("host"), F.col("path"))
    bad = (F.col("_n.n_strict") >= 1) | (F.col("_n.n_soft") >= soft_limit)
    return rows.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_n.n_strict").alias("n_strict"), F.col("_n.n_soft").alias("n_soft"),
    )
