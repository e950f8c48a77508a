"""PCA whitening of vectors whose entries become whole numbers, centred without rounding.

Sums over the fit list, each distinct vector once, are exact; a row's difference from the
mean is ``(n*x - S) / n`` with ``n*x - S`` a whole number, so nothing is lost where a
large mean would swallow it.  ``RowMatrix.computeGramianMatrix`` adds the outer products
on the executors and hands the driver one matrix of dimensions by dimensions; ``eigh``
runs there, and the components go to all tasks as a broadcast of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK = 4096  # vectors that a task centres at once
LEAST = 1e-13  # of the greatest eigenvalue: what rounding alone can leave
_SAFE = 1 << 62


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n*x - S`` as whole numbers: longs where they fit, else Python's."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach < _SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, centred: np.ndarray) -> list[int]:
        """The sum of squares of each row, exact."""
        if centred.dtype != object and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < _SAFE:
            return (centred * centred).sum(axis=1).tolist()
        return [sum(int(d) * int(d) for d in row) for row in centred]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def whole_entries(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors`` as one struct ``row``, with ``x``: each entry ``c`` as ``floor(scale*c) + shift``.

    Rows go whose vector is null, empty, of fewer entries than the longest, or holds an
    entry that is null, not finite, or beyond a long when scaled.
    """
    entries = F.col(vector).cast("array<double>")
    bound = float(1 << 62) / scale
    good = F.forall(entries, lambda c: F.coalesce(F.abs(c) < bound, F.lit(False)) & ~F.isnan(c))
    x = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("long"))
    rows = vectors.select(F.struct("*").alias("row"), entries.alias("entries"), good.alias("good"), x.alias("x"))
    longest = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    return rows.where(F.col("good") & (F.size("entries") == longest) & (F.size("entries") > 0)).select("row", "x")


def _as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _exact_sums(listed: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their sum in each dimension: a row a task and dimension, then one a dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                x = _as_matrix(batch.column(0))
                low, high = x & 0xFFFFFFFF, x >> 32  # halves, so that no long overflows
                own = [int(h) * (1 << 32) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
                sums, n = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)], n + len(batch)
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))],
                ["dim", "n", "total"],
            )

    found = listed.select("x").mapInArrow(partial, "dim int, n long, total decimal(38,0)")
    totals = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (int(totals[0]["n"]), [int(r["total"]) for r in totals]) if totals else (0, [])


def _gramian(rows: DataFrame) -> np.ndarray:
    """Of rows with one column, an array of doubles."""
    column = rows.columns[0]
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _mapped(rows: DataFrame, model: Whitening, keep: str | None) -> DataFrame:
    """Centred and whitened rows, with the exact deviation, beside column ``keep``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    columns = ["x", keep] if keep else ["x"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in batches:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                centred = own.centred(np.array(part["x"].tolist(), np.int64))
                out = part[[keep]].copy() if keep else part[[]].copy()
                out["centred"] = list((centred / own.n).astype(np.float64))
                if keep:
                    out["deviation"] = [Decimal(d) for d in own.deviation(centred)]
                    out = out.drop(columns="centred")
                if own.vectors.size:
                    out["whitened"] = list(own.whitened(centred))
                else:
                    out["whitened"] = [np.zeros(0)] * len(part)
                yield out

    if keep:
        kind = rows.schema[keep].dataType.simpleString()
        return rows.select(*columns).mapInPandas(run, f"`{keep}` {kind}, deviation decimal(38,0), whitened array<double>")
    return rows.select(*columns).mapInPandas(run, "centred array<double>, whitened array<double>")


def fit(listed: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learn from column ``x`` of ``listed``, whose rows are taken as they are.

    Components whose eigenvalue is nothing but rounding are not kept: along them the rows
    do not differ, and nothing whitens them.  No rows: a model without components.
    """
    n, sums = _exact_sums(listed)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    bare = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    covariance = _gramian(_mapped(listed, bare, None).select("centred")) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int(np.sum(values[:components] > max(values[0], 0.0) * LEAST))
    model = Whitening(n, sums, np.ascontiguousarray(vectors[:, :kept]), values[:kept].copy(), float(np.trace(covariance)))
    if kept:
        again = _gramian(_mapped(listed, model, None).select("whitened")) / n
        model.identity_error = float(np.abs(again - np.eye(kept)).max())
    return model


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``key, component, n, deviation, whitened,
    explained, identity_error``.

    ``deviation`` is decimal(38, 0).  Vectors that ``whole_entries`` leaves out have no
    row.  Repeated vectors are fitted once and each has its rows, as has each repeated or
    null ``key``.  If all vectors are equal, or there is one or none, no component
    separates them and there are no rows.  Other columns are not read.
    """
    rows = whole_entries(vectors.select(key, vector), vector).select(F.col(f"row.{key}").alias(key), "x")
    listed = materialize(rows.select("x").distinct(), "fit_list")
    model = fit(listed, components)
    found = _mapped(rows, model, key) if model.n else rows.selectExpr(f"`{key}`", "cast(null as decimal(38,0)) deviation", "array(0D) whitened").limit(0)
    shares = F.array(*map(F.lit, (model.values / model.trace).tolist())) if model.values.size else F.array().cast("array<double>")
    spread = found.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
