"""The thin ``opN_<name>`` queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlens.llm import decontaminate, hmm_score, html_text, language_id, mixing, near_dedup, periodic_runs, pii, prefix_trie, quality_ledger, substring_dedup, token_counts, url_filter
from finlens.llm.store import crc_bucket, save
from finlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the fixed host and path rules of the URL query
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def _term_hits(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in terms)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

URL_SQL = f"""
WITH p AS (
  SELECT page_id, translate(url, {_AZ}) AS u,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         coalesce({_term_hits(url_filter.STRICT_TERMS)}, 0) AS n_strict,
         coalesce({_term_hits(url_filter.SOFT_TERMS)}, 0) AS n_soft
  FROM p),
r AS (
  SELECT *, '.' || host AS dotted FROM q)
SELECT page_id, host, path,
       CASE WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
       CASE WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'allow'
            WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'block'
            WHEN dotted LIKE '%.net' AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
            WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'allow'
            WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS INT) AS n_strict, CAST(n_soft AS INT) AS n_soft
FROM r
"""


@query("op5_url_filter", URL_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page URL: host rules, else the weighted vocabulary."""
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules=URL_RULES)


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(list_filter(w, lambda x: ends_with(x, '!!') OR x = '!')) AS BIGINT) AS n_shout_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
f AS (
  SELECT *, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM m),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END
       + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
       + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
       + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
       + CASE WHEN n_letters > 0 AND 2 * n_upper > n_letters THEN 32 ELSE 0 END
       + CASE WHEN 5 * n_shout_words > n_words THEN 64 ELSE 0 END AS BIGINT) AS fail_mask FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       fail_mask = 0 AS kept, fail_mask, n_lines, n_upper, n_letters, n_shout_words
FROM b
"""


@query("op6_quality_ledger", QUALITY_SQL)
def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document, with the verdicts of the base policy and of
    the current one (v2)."""
    ledger = quality_ledger.evaluate(read_table(spark, sf_dir, "documents"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_ledger.passes(quality_ledger.BASE)).alias("base_failed"),
        quality_ledger.passes(quality_ledger.POLICIES[-1]).alias("kept"),
        "fail_mask", "n_lines", "n_upper", "n_letters", "n_shout_words",
    )


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    content = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs, content)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every document under the public 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), path)


REPEAT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS p FROM win)
  WHERE p > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 20)) AS k)),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x
  ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i
  GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op10_substring_dedup", REPEAT_SQL)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat an earlier 20-word window."""
    return substring_dedup.dedup_digest(read_table(spark, sf_dir, "documents"))


@query("op9_source_mix")
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, by source weights 1, 2, 3."""
    mix = mixing.plan_mix(read_table(spark, sf_dir, "documents"))
    return mixing.taken(mix).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS x
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * x >= 80 * (n - x)),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT l2.b, r.c FROM r JOIN l2 ON l2.a = r.doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


@query("op2_minhash_near_dedup", NEAR_SQL)
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), n=2)


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: one row per (doc_id, item_id)."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contaminated_pairs(docs, items)


@query("op4_hmm_score")
def op4_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and hidden Markov scores of every document."""
    return hmm_score.scores(read_table(spark, sf_dir, "documents"), crc_bucket(F.col("id"), 10) != 0)


@query("op1_html_main_text")
def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; one row in ten has its words from number ``a`` on
    repeat with period ``p``: with h the crc32 of the decimal id (null id: 0)
    and g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, h div 10 % n, 0) as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + h div 10 % 8) as int)"))
    text = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one text in ten made periodic."""
    found = periodic_runs.periodic_runs(looped(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumns({"lines": lines, "best": best})
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


TRIE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS ds, list(size ORDER BY turn NULLS FIRST, digest) AS ss,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 6 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.ds[1:c.h], []), c.ds[c.h + 1:]) AS ds,
         list_concat(coalesce(b.ss[1:c.h], []), c.ss[c.h + 1:]) AS ss
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (
  SELECT conv_id, d, array_to_string(ds[1:d], '') AS k, CASE WHEN d > 0 THEN ss[d] ELSE 0 END AS size, d = len(ds) AS ends
  FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM r)),
n AS (
  SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM p GROUP BY k),
kids AS (
  SELECT left(k, 32 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.k = n.k),
s AS (
  SELECT left(k, 32 * j) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM m) GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN n u ON m.depth > 0 AND u.k = left(m.k, 32 * (m.depth - 1))
"""


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % 100
    (none if absent) and goes on with its own after its first h; h is the
    crc32 of the decimal id modulo 6."""
    base = seqs.where("conv_id % 100 = 0").select(
        F.col("conv_id").alias("base"), F.expr("substring(seq, 1, 80)").alias("base_seq"),
        F.slice("sizes", 1, 5).alias("base_sizes"))
    rows = seqs.withColumns({"base": F.expr("conv_id - conv_id % 100"), "h": crc_bucket(F.col("conv_id"), 6)})
    rows = rows.join(base, "base", "left")
    return rows.select(
        "conv_id",
        F.expr("concat(coalesce(substring(base_seq, 1, 16 * h), x''), substring(seq, 16 * h + 1))").alias("seq"),
        F.expr("concat(coalesce(slice(base_sizes, 1, h), cast(array() as array<int>)), slice(sizes, h + 1, size(sizes)))"
               ).alias("sizes"))


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt to share first turns."""
    own = save(prefix_trie.sequences(read_table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie.prefix_trie(rebuilt(own))


def _private_sql() -> str:
    """The spans of every kind as lists of one row, and their digests."""
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda j: "
            f"CASE WHEN j % 2 = 1 THEN CAST({digits}[-j] AS INT) WHEN CAST({digits}[-j] AS INT) > 4 "
            f"THEN 2 * CAST({digits}[-j] AS INT) - 9 ELSE 2 * CAST({digits}[-j] AS INT) END)) % 10 = 0")
    turned = "replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4]"
    mod97 = (f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) > 57 "
             "THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 "
             "ELSE (a * 10 + x) % 97 END) = 1")
    valid = {"ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 "
                   "AND CAST('0' || right(ltrim(x, '0'), 3) AS INT) <= 255))",
             "card": luhn, "phone": f"length({digits}) BETWEEN 9 AND 15", "iban": mod97,
             "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')"}
    found, spans = [], []
    for k, kind in enumerate(pii.KINDS):
        pattern = base.get(kind.name, kind.pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b"))
        found.append(f"regexp_extract_all(t, '{pattern}') AS hits{k}, string_split_regex(t, '{pattern}') AS gaps{k}")
        near, against = pii.context_pattern(kind.near), pii.context_pattern(kind.against)
        around = f"translate(right(gaps{k}[i], {pii.BEFORE}) || ' ' || left(gaps{k}[i + 1], {pii.AFTER}), {_AZ})"
        score = (f"greatest(0, least(100, {kind.score} + CASE WHEN regexp_matches({around}, '{near}') THEN {pii.BOOST} ELSE 0 END "
                 f"- CASE WHEN regexp_matches({around}, '{against}') THEN {pii.BOOST} ELSE 0 END))")
        start = (f"coalesce(list_sum(list_transform(gaps{k}[1:i], lambda g: length(g))), 0) "
                 f"+ coalesce(list_sum(list_transform(hits{k}[1:i - 1], lambda g: length(g))), 0)")
        ok = f"list_transform([hits{k}[i]], lambda m: {valid.get(kind.name, 'true')})[1]"
        keep = "s.ok" if kind.base else f"s.ok AND s.score >= {pii.THRESHOLD}"
        spans.append(
            f"list_filter(list_transform(range(1, len(hits{k}) + 1), lambda i: {{'start': CAST({start} AS BIGINT), 'number': {k}, "
            f"'kind': '{kind.name}', 'size': length(hits{k}[i]), 'score': {score}, 'base': {str(kind.base).lower()}, 'ok': {ok}}}), "
            f"lambda s: {keep})")
    joined = "list_transform({0}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.size)).array_to_string(',')"
    counts = ", ".join(f"CAST(len(list_filter(b, lambda s: s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, {', '.join(found)} FROM d),
s AS (SELECT doc_id, list_sort(flatten([{', '.join(spans)}])) AS p FROM h),
b AS (SELECT doc_id, p, list_filter(p, lambda s: s.base) AS b FROM s)
SELECT doc_id, {counts}, sha256(coalesce({joined.format('b')}, '')) AS base_sha256, coalesce({joined.format('p')}, '') AS spans,
       CAST(coalesce(list_max(list_transform(p, lambda s: s.score)), 0) AS INT) AS top_score
FROM b
"""


@query("op13_pii", _private_sql())
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    found = found.select("doc_id", "spans", base.alias("b"))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined("b"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0)).alias("top_score"))
