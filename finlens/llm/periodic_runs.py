"""Periodic runs in word sequences, by a dictionary of basic factors.

A run is a stretch of consecutive words whose smallest period is q, at least
``max(min_length, min_exponent * q)`` words long, that no neighbouring word
extends with that period.

Dictionary.  Level k names the factors of 2**k words: level 0 numbers the
words of each text, level k + 1 numbers the pairs (name at i, name at i + 2**k).
A factor that occurs once in its text leaves the dictionary, and so do all
that contain it; ordinary prose empties after a few levels.

Proposals.  At level k a factor's occurrences are in order; three with two
equal successor distances d <= 2 * 2**k form an arithmetic progression and
propose period d.  Places side by side that propose the same d are one
proposal.  Inside a run with period q take the level with q <= 2**k < 2q:
conjugates of a primitive word differ, so the successor of a place is the
place q on, and 2q + 2**k <= 4q words hold the progression.  Every run of
exponent four or more is proposed from its first word, therefore; smaller
exponents are not offered.

Extension and removal of repeats.  A proposal is extended to both sides with
the names of its own and the lower levels, cut to the lengths asked for, and
one of each (start, end) stays, that with the smallest period: a stretch of
period d whose smallest period q is less is, at these lengths, the run of q
itself.

All texts of a slice share one dictionary (words are numbered per text, so no
factor spans two), in arrays of a fixed multiple of the slice, or of the
longest text.  There is no shuffle.

Defined results: null and empty texts have no words, no run and collapse to
"".  Repeated rows each get their own result; equal lengths are settled by
the caller, as runs come in order of start, then period.  Columns of the
operator's own that clash with extra ones: the extra ones stay behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import pick
from finlens.llm.textops import Words, slices

MIN_EXPONENT, MIN_LENGTH = 4, 6
_RUN = pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())])
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Level:
    """Names of the factors of ``size`` words that occur more than once in
    their text: ``place`` (ascending) and the name there."""

    def __init__(self, size: int, place: np.ndarray, key: np.ndarray):
        self.size = size
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        same = key[1:] == key[:-1]
        often = np.append(False, same) | np.append(same, False)
        #: grouped by name, places ascending inside a name
        self.grouped = place[often]
        new = np.append(True, ~same)[often]
        self.group = np.cumsum(new) - 1
        back = np.argsort(self.grouped, kind="stable")
        self.place, self.name = self.grouped[back], self.group[back]

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of the progressions of three occurrences."""
        gap = np.diff(self.grouped)
        inside = self.group[1:] == self.group[:-1]
        at = np.flatnonzero(inside[:-1] & inside[1:] & (gap[:-1] == gap[1:]) & (gap[:-1] <= 2 * self.size))
        return self.grouped[at], gap[at]

    def next_keys(self, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of the factors of twice the size."""
        second = np.searchsorted(self.place, self.place + self.size)
        second[second == len(self.place)] = 0
        whole = (self.place[second] == self.place + self.size) & (
            self.place + 2 * self.size <= text_end[self.place])
        n = len(self.place) + 1
        return self.place[whole], self.name[whole] * n + self.name[second[whole]]

    def names_at(self, place: np.ndarray) -> np.ndarray:
        """Names at ``place``; -1 where the factor occurs once or not at all."""
        at = np.searchsorted(self.place, place)
        at[at == len(self.place)] = 0
        return np.where(self.place[at] == place, self.name[at], -1)


def _extend(levels: list[Level], top: np.ndarray, here: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How far word j equals word j + period from ``here`` on (``step`` 1: j =
    here, here + 1, ...; -1: j = here - 1, here - 2, ...), by factors of the
    levels from ``top`` down."""
    length = np.zeros(len(here), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        active = np.flatnonzero(top >= k)
        while len(active):
            at = here[active] + length[active] if step > 0 else here[active] - length[active] - level.size
            name = level.names_at(at)
            active = active[(name >= 0) & (name == level.names_at(at + period[active]))]
            length[active] += level.size
            # below its own level a factor can only fit once
            active = active[top[active] == k]
    return length


def find_runs(word: np.ndarray, off: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in texts ``word[off[i]:off[i + 1]]``
    of numbered words, by start, then period; starts count from ``word[0]``."""
    if min_exponent < 4:
        raise ValueError("runs are proposed from exponent 4 on")
    none = np.empty(0, np.int64)
    if not len(word):
        return none, none, none
    counts = np.diff(off)
    text = np.repeat(np.arange(len(counts)), counts)
    text_end = off[1:][text]
    levels: list[Level] = []
    place, key = np.arange(len(word)), text * (int(word.max()) + 1) + word
    size, most = 1, 2 * int(counts.max()) // min_exponent
    first, last, period, top = [none], [none], [none], [none]
    while len(place) and size <= max(most, 1):
        level = Level(size, place, key)
        if not len(level.place):
            break
        levels.append(level)
        at, d = level.proposals()
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else none
        first.append(at[head])
        last.append(at[np.append(head[1:], len(at)) - 1] if len(at) else none)
        period.append(d[head])
        top.append(np.full(len(head), len(levels) - 1))
        place, key = level.next_keys(text_end)
        size *= 2
    i, j, d, k = (np.concatenate(x) for x in (first, last, period, top))
    if not len(i):
        return none, none, none
    done = j + (1 << k)  # words up to here equal those one period on
    begin = i - _extend(levels, k, i, d, -1)
    end = done + _extend(levels, k, done, d, 1) + d
    keep = end - begin >= np.maximum(min_length, min_exponent * d)
    begin, end, d = begin[keep], end[keep], d[keep]
    order = np.lexsort((d, end, begin))
    begin, end, d = begin[order], end[order], d[order]
    if len(begin):
        one = np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))
        begin, end, d = begin[one], end[one], d[one]
    order = np.lexsort((d, begin))
    return begin[order], (end - begin)[order], d[order]


def collapsed(w: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """Per text: the words left when every run keeps its first period only,
    joined by one space."""
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    own = np.flatnonzero(keep)
    text = w.doc_of()[own]
    size = (w.end - w.start)[own]
    gap = np.append(False, text[1:] == text[:-1]).astype(np.int64) if len(own) else size
    stop = np.cumsum(size + gap)
    out = np.full(int(stop[-1]) if len(own) else 0, 0x20, np.uint8)
    letter = np.ones(len(out), bool)
    letter[(stop - size - gap)[gap > 0]] = False
    word_of = np.zeros(len(w.raw), np.int64)
    word_of[w.start[1:]] = 1
    out[letter] = w.raw[w.word & keep[np.cumsum(word_of)]] if len(w) else out[letter]
    ends = np.append(0, stop)[np.searchsorted(text, np.arange(len(w.doc_off)))]
    return pa.Array.from_buffers(
        pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.tobytes())]
    ).cast(pa.string())


def _finder(min_exponent: int, min_length: int):
    fields = [pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(_RUN)), pa.field("collapsed", pa.string())]

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            for piece in slices(pa.record_batch([col], ["t"]), "t"):
                w = Words(piece.column(0))
                number = w.strings().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, length, period = find_runs(number, w.doc_off, min_exponent, min_length)
                in_text = np.searchsorted(w.doc_off, start, "right") - 1
                yield pa.StructArray.from_arrays([
                    pa.array(w.counts),
                    pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(start, w.doc_off).astype(np.int32)),
                        pa.StructArray.from_arrays(
                            [pa.array(start - w.doc_off[in_text]), pa.array(length), pa.array(period)],
                            fields=list(_RUN))),
                    collapsed(w, start, length, period),
                ], fields=fields)

    return find


def runs_column(text: str | Column, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> Column:
    """Column of n_words, runs (by start, then period) and the collapsed text."""
    return F.arrow_udf(_finder(min_exponent, min_length), RESULT)(text)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = MIN_EXPONENT,
                  min_length: int = MIN_LENGTH) -> DataFrame:
    """id, n_words, runs and collapsed text of every row."""
    rows = pick(df, **{id_col: id_col, text_col: text_col})
    found = runs_column(F.col(text_col), min_exponent, min_length).alias("_r")
    return rows.select(id_col, found).select(id_col, "_r.*")
