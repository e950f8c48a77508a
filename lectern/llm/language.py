"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language are summed within each task and then over tasks.  The model is one
matrix of log-probabilities, languages by ``BUCKETS``, which every task gets as a
broadcast: its size is 128 KB a language, and the ``MAX_LANGUAGES`` most frequent are learned.
Texts are scored whole, in batches of about ``BATCH_CHARS`` characters: the batch's
n-grams are rows of a sparse matrix whose product with the model is a gather and a sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
BATCH_CHARS = 1 << 18
FIT_DOCS = 20_000  # training documents of each language at most, chosen by a hash
MAX_LANGUAGES = 512
CERTAIN_GRAMS = 48  # evidence counts as that of so many n-grams at most
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text begins, and the bucket of the n-gram at every character, by order.

    Each text follows two spaces, so that no n-gram has letters of two texts.
    """
    joined = "".join("  " + t.lower() for t in texts) + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = [len(t.lower()) + 2 for t in texts]
    starts = np.cumsum([0, *lengths[:-1]]) if texts else np.zeros(0, np.int64)
    found = []
    for n in ORDERS:
        mixed = np.full(len(codes) - 2, n, np.uint32)
        for i in range(n):
            mixed = (mixed ^ codes[i : len(codes) - 2 + i]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        found.append((mixed & np.uint32(BUCKETS - 1)).astype(np.int32))
    return starts, found


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of text pieces with the number of the text each is of."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), BATCH_CHARS):
            part = text[at : at + BATCH_CHARS]
            rows.append(row)
            parts.append(part)
            held += len(part)
            if held >= BATCH_CHARS:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS, float32 log-probabilities
    priors: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most likely language of each text, and its tempered posterior."""
        sums, grams = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for rows, parts in _pieces(texts):
            starts, orders = ngram_buckets(parts)
            grams += np.bincount(rows, np.diff([*starts, len(orders[0])]) * len(orders), len(texts))
            for k, own in enumerate(self.weights):
                value = own[orders[0]].astype(np.float64)
                for buckets in orders[1:]:
                    value += own[buckets]
                sums[k] += np.bincount(rows, np.add.reduceat(value, starts), len(texts))
        named = [bool(self.languages) and t is not None and _LETTER.search(t) is not None for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits = sums * np.minimum(1, CERTAIN_GRAMS / np.maximum(grams, 1)) + self.priors[:, None]
        odds = np.exp(logits - logits.max(axis=0))
        odds /= odds.sum(axis=0)
        best = logits.argmax(axis=0)
        pred = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, named, strict=True)]
        return pred, np.where(named, odds.max(axis=0), 0.0)


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = FIT_DOCS, most: int = MAX_LANGUAGES
) -> Model:
    """Learn from the rows of ``docs`` with a text and a language.

    At most about ``per_language`` documents of a language are used: those whose hashed
    ``key`` is below the share that gives so many.  Of more than ``most`` languages those
    with the most rows are learned, of equal ones the first by name: both bound what is
    broadcast.  No rows: a model without languages.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("h"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    shares = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))))
    below = F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * float(1 << 30)  # null, so false, for other languages
    chosen = rows.where(below).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for rows, parts in _pieces(batch.column(0).to_pylist()):
                for own in {langs[r] for r in rows}:
                    kept = [p for r, p in zip(rows, parts, strict=True) if langs[r] == own]
                    total = totals.setdefault(own, np.zeros(BUCKETS, np.int64))
                    for buckets in ngram_buckets(kept)[1]:
                        total += np.bincount(buckets, minlength=BUCKETS)
        for own, total in totals.items():
            seen = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["lang", "bucket", "n"]
            )

    counted = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.full(BUCKETS, 0.5)
        total[rows["bucket"].to_numpy(int)] += rows["n"]
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "own": [np.log(total / total.sum()).astype("<f4").tobytes()]})

    # one row of 128 KB a language comes to the driver
    rows_of = {r["lang"]: r["own"] for r in counted.groupBy("lang").applyInPandas(dense, "lang string, own binary").collect()}
    even = np.full(BUCKETS, -np.log(BUCKETS), "<f4").tobytes()  # of a language whose texts have no character
    weights = np.stack([np.frombuffer(rows_of.get(k, even), "<f4") for k in languages])
    docs_of = np.array([sizes[k] for k in languages], float)
    return Model(languages, weights, np.log(docs_of / docs_of.sum()))


def identify(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct ``(lang, score)`` for a text column.

    ``und`` with score 0 for null texts and texts without a letter, and whenever the model
    has no languages.  Very long texts are read in pieces and scored whole.  The column is
    marked as not to be computed twice: a filter on it and its readers share one pass.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, score = shared.value.scores([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang": pred, "score": score})

    return run.asNondeterministic()(text.cast("string"))
