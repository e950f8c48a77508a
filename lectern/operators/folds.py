"""Folds over a key's rows in order, where a row is compared with the last one kept.

``lag`` compares with the row before; these operators need the last row that stayed.  Rows
are dealt by key and sorted within their partition, and a fold reads them as a stream that
runs on across Arrow batches: it holds its state and never a key's rows, so a key may have
as many rows as it likes.  Rows of one key have one task, as each depends on the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 4096  # rows of a batch that a fold gives back


def folded(rows: DataFrame, key: str, order: list[str], schema: StructType, fold: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """What ``fold`` yields for each key's rows in ``order``, in columns of ``schema``.

    ``fold`` gets a key's rows as an iterator and yields rows without the key.  A null key is
    a key; nulls in ``order`` come first; rows equal in ``order`` have no order of their own.
    An empty table gives none.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        out = ({key: value, **kept} for value, own in groupby(stream, itemgetter(key)) for kept in fold(own))
        while part := list(islice(out, BATCH)):
            yield pa.RecordBatch.from_pylist(part, schema=target)

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def key_frames(rows: DataFrame, key: str, at: str, value: str, change: float, gap: float, most: int = 200) -> DataFrame:
    """Rows of each key kept as key frames: the first, and each whose value differs from the
    last kept by over ``change`` at least ``gap`` later; at most ``most``.  Rows without a time
    or value are no frames."""

    def frames(own: Iterator[dict]) -> Iterator[dict]:
        last, kept = None, 0
        for row in own:
            if kept < most and (last is None or abs(row[value] - last[value]) > change and row[at] - last[at] >= gap):
                last, kept = row, kept + 1
                yield {at: row[at], value: row[value]}

    usable = rows.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(key, at, value)
    return folded(usable, key, [at, value], usable.schema, frames)


def collapse_captions(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Captions with rolling repeats merged: one that equals or ends the last kept text is
    dropped, one that begins with it replaces it.  Null texts are no captions."""

    def captions(own: Iterator[dict]) -> Iterator[dict]:
        last = None
        for row in own:
            if last is None:
                last = {order: row[order], text: row[text]}
            elif last[text].endswith(row[text]):
                continue
            elif row[text].startswith(last[text]):
                last[text] = row[text]
            else:
                yield last
                last = {order: row[order], text: row[text]}
        if last is not None:
            yield last

    usable = rows.where(F.col(text).isNotNull()).select(key, order, text)
    return folded(usable, key, [order, text], usable.schema, captions)
