"""Token counts by rank-synchronous array merging.

Texts are cut at white space; the token count of a piece depends on the piece
alone, so each distinct piece of a batch is encoded once.  Encoding holds the
batch's distinct pre-tokens as one ragged array of symbol ids.  A round finds
every adjacent pair's merge rank, takes the lowest rank of each sequence with
one segmented minimum, and applies that pair everywhere it occurs in its
sequence at once; sequences without a mergeable pair leave with their symbol
count.  As each merged symbol has one producing pair, and merges that use it
rank later, this equals merging one pair at a time.

The vocabulary file (a byte-level BPE in the ``tokenizers`` JSON layout) is a
parameter; the parsed merge table (bounded by the vocabulary) ships with the
function.  Normalisation, splitting and special strings follow the file's
declared settings: NFC, white space, lower case, the pattern, and added tokens
matched in the raw text, one token each.

One Arrow pass, no shuffle.  Null and empty texts have 0 bytes and 0 tokens.
Repeated rows each get their own row; extra input columns are left out.  The
piece cache is emptied when it passes ``CACHE_PIECES``, which bounds memory
and changes no result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import pick

CACHE_PIECES = 400_000
CACHE_PIECE_CHARS = 200
# separators that str.split() and the tokenizer's \s do not treat alike
_ODD_SPACE = regex.compile("[\x1c-\x1f\x85]")
_NONE = np.int32(2**31 - 1)


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class MergeTable:
    """The parts of a vocabulary file that counting needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = len(vocab)
        names = _byte_symbols()
        self.inner = np.array([vocab[s] for s in names], np.int32)
        self.last = np.array([vocab[s + suffix] for s in names], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")


def merged_lengths(symbols: np.ndarray, sizes: np.ndarray, table: MergeTable) -> np.ndarray:
    """Symbols left in each of the ragged sequences after all merges."""
    out = sizes.astype(np.int64)
    alive = np.flatnonzero(sizes > 1)
    if not len(alive):
        return out
    keep = np.repeat(sizes > 1, sizes)
    sym, seq = symbols[keep].astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)[keep]
    while len(sym):
        key = sym[:-1] * table.size + sym[1:]
        at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
        rank = np.where((table.keys[at] == key) & (seq[:-1] == seq[1:]), table.rank[at], _NONE)
        rank = np.append(rank, _NONE)
        heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        sizes_now = np.diff(np.append(heads, len(seq)))
        low = np.repeat(np.minimum.reduceat(rank, heads), sizes_now)
        hit = (rank == low) & (low != _NONE)
        if not hit.any():
            break
        # in a run of overlapping hits (aaa) every second one merges, leftmost first
        idx = np.arange(len(hit))
        before = np.append(False, hit[:-1])
        begin = np.maximum.accumulate(np.where(hit & ~before, idx, 0))
        hit &= (idx - begin) % 2 == 0
        where = np.flatnonzero(hit)
        sym[where] = table.made[rank[where]]
        np.subtract.at(out, seq[where], 1)
        stay = np.ones(len(sym), bool)
        stay[where + 1] = False
        stay &= low != _NONE  # finished sequences leave
        sym, seq = sym[stay], seq[stay]
    return out


class Counter:
    """Counts tokens of texts, caching the counts of short pieces."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.find = regex.compile(table.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        self.cache: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> None:
        """Put the counts of ``pieces`` into the cache."""
        tokens: dict[str, int] = {}
        owner, token_no = [], []
        for i, piece in enumerate(pieces):
            text = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            for token in self.find(text):
                owner.append(i)
                token_no.append(tokens.setdefault(token, len(tokens)))
        counts = np.zeros(len(pieces), np.int64)
        if tokens:
            encoded = [t.encode("utf-8") for t in tokens]
            sizes = np.array([len(b) for b in encoded], np.int64)
            raw = np.frombuffer(b"".join(encoded), np.uint8)
            symbols = self.table.inner[raw]
            tail = np.cumsum(sizes) - 1
            symbols[tail] = self.table.last[raw[tail]]
            left = merged_lengths(symbols, sizes, self.table)
            np.add.at(counts, np.array(owner), left[np.array(token_no)])
        self.cache.update(zip(pieces, counts.tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache, rows, fresh, extra = self.cache, [], set(), []
        for text in texts:
            n, parts = 0, [text or ""]
            if self.special is not None and self.special.search(parts[0]):
                n = len(self.special.findall(parts[0]))
                parts = self.special.split(parts[0])
            pieces = []
            for part in parts:
                pieces += [part] if _ODD_SPACE.search(part) else part.split()
            rows.append(pieces)
            extra.append(n)
            fresh.update(p for p in pieces if p not in cache)
        self._encode(list(fresh))
        out = [n + sum(map(cache.__getitem__, pieces)) for n, pieces in zip(extra, rows, strict=True)]
        for p in fresh:
            if len(p) > CACHE_PIECE_CHARS:
                del cache[p]
        return out


def token_counter(path: str):
    """Column function: text -> number of tokens (bigint)."""
    table = MergeTable(path)

    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(table)
        for col in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
            counts, at = [], 0
            while at < len(col):  # about 1 MB of text at a time
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right")))
                counts += counter.count(col.slice(at, stop - at).to_pylist())
                at = stop
            yield pa.array(counts, pa.int64())

    return F.arrow_udf(count_tokens, "bigint")


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``)."""
    rows = pick(df, **{"_id": id_col, "_t": text_col})
    return rows.select(
        F.col("_id").alias(id_col),
        F.coalesce(F.octet_length("_t"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_counter(path)("_t").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
