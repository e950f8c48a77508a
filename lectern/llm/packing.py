"""Packing documents into sequences along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to ``DIMS``
dimensions, and the cell it falls into has a place on the Hilbert curve.  Documents are
range-sorted by that place and cut into sequences of ``length`` tokens as they follow
each other, so neighbours on the curve share sequences and every sequence but those of
the end is full; the end is cut into powers of two, so nothing is padded at all.

Only narrow rows are sorted.  The ids are written once, and join their place by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.hilbert import hilbert_keys
from lectern.llm.offsets import running_offsets
from lectern.storage import materialize

LENGTH = 2048
HASH_DIMS, DIMS, BITS, SPAN = 256, 3, 16, 5.0  # vector, projection, bits per dimension, its clipped range
OUT_BYTES = 4 << 20  # ids given back to Spark at a time
SEED = 20240601


def hashed_vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Unit vectors of ``HASH_DIMS``: signed feature hashing of damped token counts."""
    out = np.zeros((len(ids), HASH_DIMS))
    for row, own in zip(out, ids, strict=True):
        token, count = np.unique(own, return_counts=True)
        mixed = token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        sign = np.where(mixed & np.uint64(1 << 20), 1.0, -1.0)
        np.add.at(row, (mixed % np.uint64(HASH_DIMS)).astype(np.int64), sign * np.log1p(count))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as their token ids."""
    plane = np.random.default_rng(SEED).standard_normal((HASH_DIMS, DIMS))
    place = np.clip(hashed_vectors(ids) @ plane / SPAN, -1, 1)
    return hilbert_keys(((place + 1) / 2 * ((1 << BITS) - 1)).round(), BITS)


def _sliced(batch: pa.RecordBatch, column: int, size: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, at least a row each."""
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        held += n
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def tokenized(docs: DataFrame, doc_id: str, text: str, path: str, keys: bool = True) -> DataFrame:
    """``(row_no, doc_id, n, key, ids binary)`` per row, written to the shared folder."""
    kind = tokens.id_type(path)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, 2):
                ids = [tokens.token_ids(t.as_py(), path) for t in part.column(2)]
                where = curve_keys(ids) if keys else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array(where),
                     pa.array([i.astype(kind).tobytes() for i in ids], pa.binary())],
                    ["row_no", "doc_id", "n", "key", "ids"],
                )

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(
        rows.mapInArrow(run, f"row_no long, doc_id {id_kind}, n long, key long, ids binary"), "tokens"
    )


def sequence_bounds(total: int, length: int) -> list[int]:
    """Sizes of the sequences of the last ``total % length`` tokens: powers of two."""
    rest = total % length
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_along_curve(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_length, ids`` (binary, little-endian unsigned 32-bit).

    Null and empty texts are documents of one id, the end.  Null ids of documents stay
    null.  Repeated rows are packed once each; rows equal in place are ordered by a hash
    of their id and then by row.  Very long texts run over as many sequences as they
    need.  Other columns are not read.  An empty table gives no rows.
    """
    path = vocabulary or tokens.vocabulary()
    stored = tokenized(docs, doc_id, text, path)
    narrow = stored.select("row_no", "n", "key", F.xxhash64("doc_id").alias("mixed"))
    starts = running_offsets(narrow, ["key", "mixed", "row_no"], "n", "begin").select("row_no", "begin")
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole, kind = total // length, tokens.id_type(path)
    edges = np.concatenate([[0], np.cumsum(sequence_bounds(total, length))]).astype(np.int64) + whole * length
    size = length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, 2):
                column: dict[str, list] = {k: [] for k in ("row", "start", "length", "n", "sequence", "offset", "size", "ids")}
                for row, (n, ids, begin) in enumerate(zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                    own = np.frombuffer(ids, kind).astype("<u4")
                    cuts = np.arange((begin // size + 1) * size, min(begin + n, whole * size), size)
                    inner = edges[(edges > begin) & (edges < begin + n)]
                    at = np.unique(np.concatenate([[begin], cuts, inner, [begin + n]]))
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        late = int(np.searchsorted(edges, a, "right")) - 1  # -1: in a full sequence
                        first = a // size * size if late < 0 else int(edges[late])
                        column["row"].append(row)
                        column["start"].append(a - begin)
                        column["length"].append(b - a)
                        column["n"].append(n)
                        column["sequence"].append(a // size if late < 0 else whole + late)
                        column["offset"].append(a - first)
                        column["size"].append(size if late < 0 else int(edges[late + 1]) - first)
                        column["ids"].append(own[a - begin : b - begin].tobytes())
                row = column.pop("row")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64()))]
                    + [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in column.items()],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"],
                )

    placed = stored.select("row_no", "doc_id", "n", "ids").join(starts, "row_no").select("doc_id", "n", "ids", "begin")
    id_kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        run,
        f"doc_id {id_kind}, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "sequence_length long, ids binary",
    )
