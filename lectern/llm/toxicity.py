"""Toxicity of obfuscated text: a noisy channel, and a linear model over what it restores.

Writers hide words by look-alike characters, by spacing letters out and by repeating
them.  Each suspicious token becomes a lattice of the letters it may stand for; a Viterbi
search finds the likeliest letters under a character bigram model learned from the
corpus, and the restored words are scored by a sparse logistic model of words and word
beginnings.  Ordinary tokens pass through, and what a token gives is remembered.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import materialize

# The letters that look-alike characters stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
# Letters of other scripts that look like Latin ones.
TWINS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ı": "i"}
READ, DROP, ONCE, TWICE = 0.7, 3.0, 0.4, 1.2  # costs: look-alike, dropped sign, repeat read once, read as two
BREAK, JOIN = 1.0, 1.5  # costs: word break between spaced letters, space taken out
BUCKETS = 1 << 18
STEMS = (4, 5, 6, 7)
FIT_TOXIC, FIT_CLEAN = 6_000, 14_000  # labelled documents to learn from at most, chosen by a hash
FIT_ENTRIES = 4_000_000  # counts of features in those documents that the driver gets at most
FEATURES = 4_000  # of the model
MEMORY = 200_000  # tokens remembered at a time
SHORT = 4  # letters of the longest pieces that a space may part
TYPICAL = 300  # words a document's counts are scaled to
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[-'’._/~]+")
_TRIPLE = re.compile(r"(.)\1\1")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_TWIN = re.compile(f"[{''.join(TWINS)}]")
_EDGE = ".,;:?\"'()[]{}<>*#%&"
_SIGNS = "".join(c for c in LOOKALIKES if not c.isalnum())
_AMOUNT = re.compile(r"[$€£#]?\d[\d.,:]*")


def _repeats(word: str) -> bool:
    """Whether a letter stands three times in a row, or three pairs of letters are equal."""
    pairs = sum(map(eq, word, word[1:]))
    return pairs > 2 or (pairs == 2 and _TRIPLE.search(word) is not None)


@dataclass
class Letters:
    """A character bigram model over lower-case words; ``^`` and ``$`` are their ends."""

    counts: dict[str, int]
    cost: dict[str, float] = field(default_factory=dict)
    first: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        for pair, n in self.counts.items():
            self.first[pair[0]] += n

    def __call__(self, a: str, b: str) -> float:
        """-log P(b | a), smoothed over 64 letters."""
        pair = a + b
        if pair not in self.cost:
            self.cost[pair] = -math.log((self.counts.get(pair, 0) + 0.1) / (self.first[a] + 6.4))
        return self.cost[pair]

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest words behind ``token``, by Viterbi over its character lattice.

        With ``spaced`` the characters stood apart, and a word may end between any two.
        """
        steps: list[dict[str, tuple[float, str, str]]] = [{"^": (0.0, "", "")}]  # by last letter: cost, letter before, letters read
        at = 0
        while at < len(token):
            sign, run = token[at], 1
            while at + run < len(token) and token[at + run] == sign:
                run += 1
            at += run
            if sign.isalpha():
                choices = [(sign * 1, 0.0 if run == 1 else TWICE if run == 2 else ONCE)]
                choices += [(sign * 2, 0.0 if run == 2 else TWICE)] if run > 1 else []
            else:
                read = LOOKALIKES.get(sign, "")
                choices = [(c * k, READ + (0.0 if k == run else ONCE)) for c in read for k in {1, min(run, 2)}]
                choices += [("", DROP if read else 0.1)]
            step: dict[str, tuple[float, str, str]] = {}
            for last, (cost, _, _) in steps[-1].items():
                for letters, own in choices:
                    for gap in (False, True) if spaced and letters and last != "^" else (False,):
                        total, before = cost + own, last
                        if gap:
                            total, before = total + BREAK + self(last, "$"), "^"
                        for letter in letters:
                            total += self(before, letter)
                            before = letter
                        if before not in step or total < step[before][0]:
                            step[before] = (total, last, " " + letters if gap else letters)
            steps.append(step)
        last, out = min(steps[-1], key=lambda c: (steps[-1][c][0] + self(c, "$"), c)), []
        for step in reversed(steps[1:]):
            _, before, letters = step[last]
            out.append(letters)
            last = before
        return "".join(reversed(out))

    def parted(self, a: str, b: str) -> bool:
        """Whether two pieces are likelier one word with a space put in than two words."""
        return self(a[-1], b[0]) + JOIN < self(a[-1], "$") + self("^", b[0])

    def restore(self, token: str) -> list[str]:
        """The words in a lower-case token without white space; where signs surround it
        that may be letters, with and without them."""
        if not token.isascii():
            token = _HIDDEN.sub("", token)
            if not unicodedata.is_normalized("NFKC", token):
                token = unicodedata.normalize("NFKC", token).lower()
            if _TWIN.search(token) and any("a" <= c <= "z" for c in token):
                token = "".join(TWINS.get(c, c) for c in token)
        core = token.strip(_EDGE)
        if core.isalpha() and not _repeats(core):
            return [core]
        words = []
        parts = [p for p in _SPLIT.split(core) if p]
        if len(parts) >= 3 and max(map(len, parts)) <= 2:
            parts = ["".join(parts)]
        for part in parts:
            if part.isalpha() and not _repeats(part):
                words.append(part)
            elif any(c.isalpha() for c in part) or (len(LOOKALIKES.keys() & set(part)) > 1 and not _AMOUNT.fullmatch(part)):
                bare = part.strip(_SIGNS)
                readings = {} if not bare else {bare: None} if bare.isalpha() and not _repeats(bare) else {self.decode(bare): None}
                readings[self.decode(part)] = None
                words += [w for r in readings for w in _WORD.findall(r)]
        return words


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and how it begins."""
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass"), 1) % BUCKETS]
    for k in STEMS:
        if len(word) < k:
            break
        out.append(zlib.crc32(word[:k].encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


class Reader:
    """Feature numbers of texts.  ``keep`` maps buckets to the model's features, if any."""

    def __init__(self, letters: Letters, keep: dict[int, int] | None = None) -> None:
        self.letters, self.keep, self.known, self.pairs, self.joins = letters, keep, {}, {}, {}

    def _of(self, token: str) -> tuple[int, ...]:
        return self._of_words(token, self.letters.restore(token))

    def _features(self, words: list[str]) -> tuple[int, ...]:
        own = [f for w in words for f in features(w)]
        return tuple(own if self.keep is None else [self.keep[f] for f in own if f in self.keep])

    def _of_words(self, key: object, words: list[str]) -> tuple[int, ...]:
        if len(self.known) >= MEMORY:
            self.known.clear()
        found = self.known[key] = self._features(words)
        return found

    def _pair(self, a: str, b: str) -> tuple[int, ...]:
        """Features of the word that two short tokens may be pieces of; whether they may be
        depends on the letters at the space alone."""
        joins = self.joins.get(a[-1] + b[0])
        if joins is None:
            joins = self.joins[a[-1] + b[0]] = self.letters.parted(a, b)
        if not joins:
            return ()
        found = self.pairs.get((a, b))
        if found is None:
            rest = b.strip(_EDGE)
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self._features([a + rest] if a.isalpha() and rest.isalpha() else [])
        return found

    def read(self, text: str | None) -> tuple[Counter, int]:
        """How often each feature occurs in a whole text, and the number of its words."""
        hits: list[int] = []
        spaced: list[str] = []
        get, tokens, before = self.known.get, (text or "").lower().split(), ""
        for token in tokens:
            found = get(token)
            if found is None:
                found = self._of(token)
            if found:
                hits += found
            size = len(token)
            if size == 1:
                spaced.append(token)
            elif spaced:
                if len(spaced) >= 3:
                    hits += self._spaced("".join(spaced))
                spaced = []
            if 1 < size <= SHORT:
                if before:
                    hits += self._pair(before, token)
                before = token
            else:
                before = ""
        if len(spaced) >= 3:
            hits += self._spaced("".join(spaced))
        return Counter(hits), len(tokens)

    def _spaced(self, letters: str) -> tuple[int, ...]:
        """Features of the words that characters standing apart spell."""
        found = self.known.get((letters,))
        return self._of_words((letters,), _WORD.findall(self.letters.decode(letters, True))) if found is None else found


def _scaled(count: np.ndarray, words: int) -> np.ndarray:
    return np.log1p(count * TYPICAL / (words + 100))


@dataclass
class Model:
    letters: Letters
    keep: dict[int, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for row, text in enumerate(texts):
            hits, words = reader.read(text)
            if hits:
                at = np.fromiter(hits.keys(), np.int64, len(hits))
                out[row] += float(self.weights[at] @ _scaled(np.fromiter(hits.values(), float, len(hits)), words))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _learn(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, penalty = len(y), 2e-4
    importance = np.where(y == 1, 1.5, 1.0)
    dot = lambda w: np.bincount(rows, values * w[cols], n)
    back = lambda r: np.bincount(cols, values * r[rows], size)
    v = np.ones(size)
    for _ in range(20):
        v = back(dot(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.375 * np.linalg.norm(dot(v)) ** 2 / n + 1e-3)
    w, z, bias, t = np.zeros(size), np.zeros(size), 0.0, 1.0
    for _ in range(400):
        residue = (1 / (1 + np.exp(-np.clip(dot(z) + bias, -30, 30))) - y) * importance / n
        moved = z - step * back(residue)
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = fresh + (t - 1) / after * (fresh - w), fresh, after
        bias -= 2 * residue.sum()
    return w, bias


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_entries: int = FIT_ENTRIES,
) -> Model:
    """Learn from the documents that ``labels`` (``doc_id``, ``label``) marks.

    At most about ``fit_toxic`` and ``fit_clean`` documents are used, those whose hashed id
    is below the share that gives so many, and of their vectors a hashed share with about
    ``fit_entries`` counts: these bound what is broadcast and collected.
    Letters are counted first, over all texts, labelled or not, then features by label,
    and the ``FEATURES`` that lean most to toxic documents make the model.  Null labels are no labels; a document that is
    marked twice is toxic if any mark says so.  With one label or none, every text scores
    by the share of toxic labels, or 0 without any.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().where("y in (0, 1)").collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = F.when(F.col("y") == 1, min(1.0, fit_toxic / max(toxic, 1))).otherwise(min(1.0, fit_clean / max(clean, 1)))
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * float(1 << 30))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    sample = materialize(own.join(F.broadcast(chosen), "id").select("text", "y").repartition(24), "labelled")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        words: Counter = Counter()

        def spell() -> None:
            for word, n in words.items():
                word = "^" + "".join(c if c < "ɐ" else "?" for c in word) + "$"
                for a, b in zip(word, word[1:], strict=False):
                    count[a + b] += n
            words.clear()

        for batch in batches:
            for t in batch.column(0):
                words.update(_WORD.findall(t.as_py().lower()))
                if len(words) >= MEMORY:
                    spell()
        spell()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["pair", "n"])

    counted = own.select("text").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    letters = Letters({r["pair"]: r["n"] for r in counted.collect()})  # at most 0x250 squared rows
    base = toxic / (toxic + clean) if toxic + clean else 0.0
    if not toxic or not clean:
        return Model(letters, {}, np.zeros(0), 30.0 * (2 * base - 1))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(letters), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.fromiter(reader.read(t.as_py())[0], np.int64)
                total[min(max(y, 0), 1), found] += 1
        seen = np.nonzero(total.sum(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["f", "clean", "toxic"])

    by_label = sample.mapInArrow(lean, "f long, clean long, toxic long").groupBy("f").agg(
        (F.sum("clean") + 0.5).alias("clean"), (F.sum("toxic") + 0.5).alias("toxic")
    )
    used = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not used.get(1) or not used.get(0):
        return Model(letters, {}, np.zeros(0), 30.0 * (2 * base - 1))
    odds = F.log((F.col("toxic") / (used.get(1, 0) + 1)) / (F.col("clean") / (used.get(0, 0) + 1)))
    leaning = (
        by_label.select("f", (odds * F.sqrt(F.col("toxic") + F.col("clean"))).alias("lean"))
        .where("lean > 0").orderBy(F.desc("lean"), "f").limit(FEATURES)
    )
    keep = {r["f"]: i for i, r in enumerate(leaning.collect())}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(letters, keep)
        for batch in batches:
            out: list = []
            for t in batch.column(0):
                hits, words = reader.read(t.as_py())
                at = sorted(hits)
                out.append((zlib.crc32(t.as_py().encode("utf-8", "surrogatepass")), at, _scaled(np.array([hits[f] for f in at], float), words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))))],
                ["y", "h", "at", "value"],
            )

    stored = materialize(sample.mapInArrow(vectors, "y int, h long, at array<int>, value array<float>"), "vectors")
    entries = stored.agg(F.sum(F.size("at"))).first()[0] or 0
    table = stored.where(F.pmod("h", F.lit(1 << 20)) < min(1.0, fit_entries / max(entries, 1)) * (1 << 20)).toArrow().combine_chunks()
    column = lambda c: table.column(c).combine_chunks()
    place = np.empty(len(table), np.int64)  # rows in an order that does not depend on the tasks'
    place[np.argsort(column("h").to_numpy(), kind="stable")] = np.arange(len(table))
    sizes_of = column("at").value_lengths().to_numpy()
    rows, cols, values = np.repeat(place, sizes_of), column("at").flatten().to_numpy().astype(np.int64), column("value").flatten().to_numpy().astype(float)
    order = np.lexsort((cols, rows))
    y = np.empty(len(table))
    y[place] = column("y").to_numpy() == 1
    del table
    weights, bias = _learn(rows[order], cols[order], values[order], y, len(keep))
    useful = np.nonzero(weights)[0]
    place = {int(f): i for i, f in enumerate(useful)}
    return Model(letters, {b: place[i] for b, i in keep.items() if i in place}, weights[useful], float(bias))


def toxicity(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score, 0 to 1, of each whole text; null and empty texts score the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        reader = Reader(own.letters, own.keep)
        for texts in batches:
            yield pd.Series(own.scores([t if isinstance(t, str) else None for t in texts], reader))

    return run(text.cast("string"))
