"""Runs: maximal periodic stretches of words, in time proportional to the text and a logarithm.

A batch of documents is one array of word numbers.  Numbers are given per document and
every document ends in a number of its own, so nothing equals anything of another text:

1. the suffix array by prefix doubling, each round sorting only what is still tied; the
   ranks of every round are kept, so the longest common extension of two places, forwards
   or backwards, is a few lookups;
2. the LCP array from those ranks, and from both the longest previous factor (LPF) of
   every place, with one stack;
3. LZ blocks: each as long as the LPF of its first place, or one word;
4. Main's extensions: a run that is not strictly inside a block touches the edge of one,
   and is found from that edge for periods no longer than the two blocks beside it;
5. a run strictly inside a block is a copy of one inside the block's source: runs lie in
   buckets by their start, and blocks copy bucket after bucket.

Documents are independent, so nothing is shuffled and a lost executor costs its batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_WORDS = 1 << 18  # words of a batch, unless one text has more
SHORTEST = 6  # words of a run at least
EXPONENT = 4  # periods of a run at least; no less than two
_WORDS = re.compile(WORD)
_RUN = "runs array<struct<start:long,length:long,period:long>>"


class _Ranks:
    """Ranks of all stretches of 1, 2, 4, ... words, and the suffix array that they end in."""

    def __init__(self, numbers: np.ndarray):
        size = len(numbers)
        order = np.argsort(numbers, kind="stable")
        rank, tied = self._refined(np.zeros(size, np.int64), numbers[order], order, np.zeros(size, np.int32))
        self.levels, span = [rank], 1
        while len(tied):
            key = rank[tied].astype(np.int64) * size + rank[tied + span]  # a tied stretch never holds the last word
            place = np.argsort(key)
            rank, tied = self._refined(rank[tied[place]], key[place], tied[place], rank)
            self.levels.append(rank)
            span *= 2
        self.suffixes = np.empty(size, np.int32)
        self.suffixes[rank] = np.arange(size, dtype=np.int32)

    @staticmethod
    def _refined(group: np.ndarray, key: np.ndarray, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks in which equal keys share the number of their first place, and what is tied."""
        at = np.arange(len(key))
        new = np.r_[True, key[1:] != key[:-1]]
        old = np.r_[True, group[1:] != group[:-1]]
        first = np.maximum.accumulate(np.where(new, at, 0))
        base = np.maximum.accumulate(np.where(old, at, 0))
        after = rank.copy()
        after[place] = group + first - base
        tied = ~(new & np.r_[new[1:], True])
        return after, np.sort(place[tied])

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places ``i`` and ``j`` on are equal."""
        far = np.zeros(len(i), np.int64)
        last = len(self.suffixes) - 1
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            same = rank[np.minimum(i + far, last)] == rank[np.minimum(j + far, last)]
            far += same.astype(np.int64) << level
        return far

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before places ``i`` < ``j`` are equal."""
        far = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, start = self.levels[level], i - far - (1 << level)
            same = (start >= 0) & (rank[np.maximum(start, 0)] == rank[np.maximum(start + j - i, 0)])
            far += same.astype(np.int64) << level
        return far


def previous_factors(ranks: _Ranks) -> tuple[list[int], dict[int, int]]:
    """The LPF of every place, and an earlier place where a factor longer than one begins."""
    size, first = len(ranks.suffixes), ranks.levels[0]
    again = np.r_[first[ranks.suffixes[1:]] == first[ranks.suffixes[:-1]], False]
    again |= np.r_[False, again[:-1]]  # words that their text holds more than once
    places = ranks.suffixes[again]
    lcp = np.r_[0, ranks.forwards(places[:-1].astype(np.int64), places[1:].astype(np.int64))] if len(places) else []
    lpf, source = [0] * size, {}
    held: list[int] = []  # places in rising order, and how far each agrees with the one below
    agree: list[int] = []
    for place, common in zip(places.tolist() + [-1], [*map(int, lcp), 0], strict=True):
        while held and held[-1] > place:
            top, below = held.pop(), agree.pop()
            if below >= common:
                lpf[top] = below
                if below > 1:
                    source[top] = held[-1]
            else:
                lpf[top] = common
                if common > 1:
                    source[top] = place
            common = min(common, below)
        held.append(place)
        agree.append(common)
    return lpf, source


def _ramp(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row numbers repeated ``counts`` times each, and 1, 2, ... within each."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(1, len(row) + 1) - np.repeat(np.cumsum(counts) - counts, counts)


def find_runs(numbers: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``numbers``, by start and period.

    Each text in ``numbers`` ends in a number that occurs nowhere else.  A run has its
    smallest period, is as long as it can be with it, at least ``shortest`` and at least
    ``exponent`` periods; ``exponent`` is two or more.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    size = len(numbers)
    if size < 3:
        return []
    ranks = _Ranks(numbers)
    lpf, source = previous_factors(ranks)
    edges, at = [], 0
    while at < size:
        edges.append(at)
        at += lpf[at] or 1
    edge = np.array(edges, np.int64)
    block = np.diff(np.r_[edge, size])

    row, right = _ramp(block)
    from_right = (edge[row], edge[row] + right, right)
    row, left = _ramp(np.minimum(np.r_[0, block[:-1]] + block, edge))
    from_left = (edge[row] - left, edge[row], left)
    word, found = ranks.levels[0], {}
    for i, j, period in (from_right, from_left):
        fits = j < size
        i, j, period = i[fits], j[fits], period[fits]
        near = (word[i] == word[j]) | ((i > 0) & (word[i - 1] == word[j - 1]))
        i, j, period = i[near], j[near], period[near]
        back, forth = ranks.backwards(i, j), ranks.forwards(i, j)
        length = back + forth + period
        long = (length >= shortest) & (length >= exponent * period)
        for s, n, p in zip((i - back)[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True):
            if found.get((s, n), p) >= p:  # of one stretch, the smallest period
                found[s, n] = p
    if not found:
        return []

    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, n), p in found.items():
        buckets.setdefault(s, []).append((n, p))
    starts = sorted(buckets)
    for b in np.nonzero(block > shortest + 1)[0].tolist():
        begin, end = int(edge[b]), int(edge[b] + block[b])
        shift = begin - source[begin]
        at = bisect_right(starts, begin - shift)
        while at < len(starts) and starts[at] + shift < end:
            s = starts[at]
            inside = [(n, p) for n, p in buckets[s] if s + shift + n < end]
            if inside:
                known = buckets.get(s + shift)
                if known is None:
                    insort(starts, s + shift)
                    buckets[s + shift] = inside
                else:
                    known.extend(r for r in inside if r not in known)
            at += 1
    return [(s, n, p) for s in starts for n, p in sorted(buckets[s], key=lambda r: (r[1], r[0]))]


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(drop), strict=False) if not n]


def runs_of(texts: list[str | None], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, list, str]]:
    """For each text its number of words, its runs, and its kept words joined by spaces."""
    split = [_WORDS.findall(t or "") for t in texts]
    numbers, used, begins = [], 0, []
    for words in split:
        known: dict[str, int] = {}
        begins.append(len(numbers))
        numbers.extend(used + known.setdefault(w, len(known)) for w in words)
        used += len(known) + 1
        numbers.append(used - 1)  # ends the text
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(np.array(numbers, np.int64), shortest, exponent):
        text = bisect_right(begins, start) - 1
        own[text].append((start - begins[text], length, period))
    return [(len(w), r, " ".join(kept_words(w, r))) for w, r in zip(split, own, strict=True)]


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` as one struct ``doc``, with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are ``(start, length, period)`` in words, by start and period; ``collapsed``
    is the text without the repeats, its words joined by one space.

    Null and empty texts have no words and no runs, and collapse to the empty text.  Rows
    are independent: repeated rows, ties and null ids change nothing, an empty table
    gives no rows, and the other columns, whatever their names, stay inside ``doc``.
    Texts are read whole; a task holds a batch of them, about ``BATCH_WORDS`` words or
    one text, at some 20 bytes a word and 4 more for each doubling of the longest repeat.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).cast("string").alias("body"))

    @F.pandas_udf(f"n_words long, {_RUN}, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            out, held, words = [], [], 0
            for body in bodies:
                held.append(body if isinstance(body, str) else None)
                words += len(held[-1] or "") // 4  # at most about one word in four characters
                if words >= BATCH_WORDS:
                    out += runs_of(held, shortest, exponent)
                    held, words = [], 0
            out += runs_of(held, shortest, exponent)
            named = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in out]
            yield pd.DataFrame({"n_words": [n for n, _, _ in out], "runs": named, "collapsed": [c for _, _, c in out]})

    return rows.select("doc", found("body").alias("x")).select("doc", "x.n_words", "x.runs", "x.collapsed")
