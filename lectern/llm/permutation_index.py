"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``prefix`` nearest pivots.  The index is
dealt into segments of about ``SEGMENT`` vectors and written once: a row per segment holds
its vectors and, for every pivot, an inverted list of (vector, place of the pivot in its
order).  A query walks the lists of its own nearest pivots and adds up the footrule
distance of what it meets there; the nearest ``share`` of the segment by footrule are
compared exactly, in double precision.  With a share of 1 the search is exact.

Equal vectors are one entry of the index with their smallest ids, so many copies of a
vector neither fill a segment nor multiply the pairs.  Searching shuffles no vectors: the
task of a segment reads the written queries block by block and gives back the best few
of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import fresh_path, materialize

PIVOTS = 512  # at most: 256 KB of 64 dimensions
PREFIX = 64
SHARE, LEAST = 0.45, 512  # of a segment to compare exactly, and how many at least
SEGMENT, QUERY_BLOCK = 8192, 2048


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each vector, nearest first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


def posted(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted files of a segment: where each pivot's list begins, and the lists'
    rows and places."""
    order = nearest_pivots(vectors, pivots, prefix).ravel()
    by_pivot = np.argsort(order, kind="stable")
    begin = np.searchsorted(order[by_pivot], np.arange(len(pivots) + 1))
    return begin.astype(np.int32), (by_pivot // prefix).astype(np.int32), (by_pivot % prefix).astype(np.int32)


def search_segment(
    queries: np.ndarray, vectors: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], pivots: np.ndarray, k: int, share: float, least: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``k`` best rows of a segment, by cosine, and their cosines."""
    prefix, n, (begin, row, place) = min(PREFIX, len(pivots)), len(vectors), lists
    norms, compared = np.linalg.norm(vectors, axis=1), min(n, max(least, int(np.ceil(share * n))))
    found = []
    for query, own in zip(queries, nearest_pivots(queries, pivots, prefix), strict=True):
        some = np.arange(n)
        if compared < n:
            near = np.zeros(n, np.int32)  # what is met lowers the footrule of an all-missing order
            for j, pivot in enumerate(own):
                a, b = begin[pivot], begin[pivot + 1]
                near[row[a:b]] += (prefix - j) - np.abs(place[a:b] - j)
            some = np.sort(np.argpartition(-near, compared - 1)[:compared])
        cosine = vectors[some] @ query / (norms[some] * np.linalg.norm(query))
        best = np.argsort(-cosine, kind="stable")[:k]
        found.append((some[best], cosine[best]))
    return found


def distinct_vectors(table: DataFrame, key: str, vector: str, members: int) -> DataFrame:
    """``(class_id, vector array<double>, members array<long>)``: equal vectors, with
    their ``members`` smallest ids in order.  Only usable vectors of the table's usual
    dimension count."""
    vec = F.col(vector).cast("array<double>")
    usable = table.select(F.col(key).cast("long").alias("vec_id"), vec.alias("vector")).where(
        "vec_id is not null and vector is not null and size(vector) > 0 "
        "and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(vector, x -> x <> 0)"
    )
    usual = usable.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    same = usable.where(F.size("vector") == (usual["d"] if usual else 0))
    few = same.withColumn("rank", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("rank") <= members)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(
        F.col("members")[0].alias("class_id"), "vector", "members"
    )


def build_index(entries: DataFrame, pivots: np.ndarray, segment: int) -> DataFrame:
    """A row per segment: its ids, vectors and inverted files.  Every entry is in one."""
    shared = entries.sparkSession.sparkContext.broadcast(pivots)
    segments = max(1, -(-entries.count() // segment))
    number = F.pmod(F.xxhash64(F.lit(7), "class_id"), F.lit(segments))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("class_id")
        vectors = np.stack(own["vector"])
        lists = posted(vectors, shared.value, min(PREFIX, len(shared.value)))
        parts = (own["class_id"].to_numpy(np.int64), vectors, *lists)
        return pd.DataFrame({c: [p.tobytes()] for c, p in zip(("ids", "vectors", "begin", "row", "place"), parts, strict=True)})

    rows = entries.select(number.cast("int").alias("segment"), "class_id", "vector").repartitionById(segments, "segment")  # a file each
    return materialize(rows.groupBy("segment").applyInPandas(build, "ids binary, vectors binary, begin binary, row binary, place binary"), "index")


def search_index(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int, share: float, least: int, block: int) -> DataFrame:
    """``(query, class_id, score)``: the best ``k`` of each segment for each of ``queries``
    (``query, asked``), which are written to a folder that pyarrow can read."""
    folder = fresh_path(index.sparkSession, "asked")
    queries.write.parquet(folder)
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
        for batch in batches:
            for ids, vectors, begin, row, place in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own, lists = np.frombuffer(ids, np.int64), tuple(np.frombuffer(x, np.int32) for x in (begin, row, place))
                data = np.frombuffer(vectors).reshape(len(own), -1)
                for file in files:
                    with system.open_input_file(file) as opened:
                        for part in pq.ParquetFile(opened).iter_batches(block):
                            asked = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                            hits = search_segment(asked, data, lists, shared.value, k, share, least)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.repeat(part.column(0).to_numpy(), [len(h[0]) for h in hits])),
                                    pa.array(own[np.concatenate([h[0] for h in hits])]),
                                    pa.array(np.concatenate([h[1] for h in hits])),
                                ],
                                ["query", "class_id", "score"],
                            )

    return index.mapInArrow(run, "query long, class_id long, score double")


def nearest_neighbours(
    table: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding",
    share: float = SHARE, least: int = LEAST, segment: int = SEGMENT, block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found of every row whose
    id is divisible by ``every``, the row itself not included; ties to the smaller id.

    ``share`` of each segment, and ``least`` vectors at least, are compared exactly; a share
    of 1 compares all of them, which is the exact way.  Recall grows with the share: on
    vectors without structure, as in these tables, the default finds over 0.95.

    Vectors that are null, empty, zero, of another dimension than most, or hold a null or
    non-finite component take no part, neither do rows whose id is null or no whole number.
    Equal vectors find each other with score 1 (to rounding).  Of rows repeated with one
    id, a query leaves one out.  With fewer than ``k`` other rows all are found; an empty
    table gives no rows.  Other columns are not read.  The pivots are ``PIVOTS`` vectors
    chosen by a hash of their id; every vector is indexed.
    """
    entries = materialize(distinct_vectors(table, key, vector, k + 1), "vectors")
    chosen = entries.orderBy(F.xxhash64("class_id"), "class_id").select("vector").limit(PIVOTS).collect()
    pivots = np.array([r["vector"] for r in chosen], float)
    if len(pivots):
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)

    asked = table.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("query_id") % every == 0)
    asking = materialize(asked.join(entries.select("class_id", "vector"), "vector").select("query_id", "class_id"), "queries")
    wanted = asking.select("class_id").distinct()
    classes = entries.join(wanted, "class_id", "left_semi").select(F.col("class_id").alias("query"), F.col("vector").alias("asked"))
    hits = search_index(build_index(entries, pivots, segment), classes, pivots, k + 1, share, least, block)
    order = W.partitionBy("query").orderBy(F.desc("score"), "class_id")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    listed = best.join(entries.select("class_id", "members"), "class_id").groupBy("query").agg(
        F.collect_list(F.struct("score", "members")).alias("near")
    )  # at most k + 1 classes of k + 1 members
    flat = F.flatten(F.transform("near", lambda c: F.transform(c["members"], lambda m: F.struct((-c["score"]).alias("far"), m.alias("vec_id")))))
    mine = asking.join(listed.select(F.col("query").alias("class_id"), F.array_sort(flat).alias("near")), "class_id")
    at = F.array_position(F.transform("near", lambda x: x["vec_id"]), F.col("query_id"))  # 0: not among them
    others = F.filter("near", lambda x, i: (i + 1) != at)
    return mine.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("i", "x")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )
