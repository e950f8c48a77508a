"""Training-order materialisation: token shards in a keyed random order, ready to stream.

Token ids are cut into sequences of ``length`` as they come.  A keyed Feistel network
over the next power of four, walked until it falls below the count, permutes the
sequences' numbers: every sequence gets a slot of the training order and every slot a
sequence, with no sort by random keys and nothing to remember but the key.  Slots are
dealt to shards by range; a shard is a file of records of one stride, so any slot is one
seek, and a reader that stopped at a slot goes on from it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.packing import _sliced
from lectern.storage import fresh_path, materialize

LENGTH = 2048
SHARD = 4096  # records: 16 MB of 2-byte ids
KEY = 20240601
ROUNDS = 6
HELD = 32 << 20  # bytes of sequences a task holds back to send them on by shard
HEAD = "<8sIIQQ"  # magic, bytes of an id, ids of a record, first slot, records
MAGIC = b"SEQSHARD"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers below ``count``: a permutation of ``0..count-1``."""
    half = np.uint64(max(1, -(-max(1, count - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, ROUNDS)]
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walking] = (left << half) | right
        walking = out >= np.uint64(count)
    return out.astype(np.int64)


def sequences(docs: DataFrame, doc_id: str, text: str, path: str, length: int) -> DataFrame:
    """``(lane, local, n, pieces, ids)``: the sequences of each task, numbered in it.

    ``pieces`` lists ``(doc_id, start, length)``, the documents' ids in the sequence.
    """
    kind = tokens.id_type(path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, local = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        pieces: list[dict] = []
        held = 0
        out: list[tuple] = []
        id_type: pa.DataType | None = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            piece = pa.list_(pa.struct([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64())]))
            kinds = (pa.int32(), pa.int64(), pa.int32(), piece, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["lane", "local", "n", "pieces", "ids"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in _sliced(batch, 1):
                for own, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids, start = tokens.token_ids(value.as_py(), path).astype(kind), 0
                    while start < len(ids):
                        taken = min(length - held, len(ids) - start)
                        parts.append(ids[start : start + taken])
                        pieces.append({"doc_id": own, "start": start, "length": taken})
                        start, held = start + taken, held + taken
                        if held == length:
                            out.append((lane, local, held, pieces, np.concatenate(parts).tobytes()))
                            parts, pieces, held, local = [], [], 0, local + 1
                if out:
                    yield batch_of(out)
                    out = []
        if held:
            yield batch_of([(lane, local, held, pieces, np.concatenate(parts).tobytes())])

    schema = f"lane int, local long, n int, pieces array<struct<doc_id:{id_kind},start:bigint,length:bigint>>, ids binary"
    return materialize(rows.mapInArrow(run, schema), "sequences")


def placed(stored: DataFrame) -> tuple[DataFrame, int]:
    """``stored`` with its global number ``index``, and the number of sequences."""
    lanes = stored.groupBy("lane").count()  # a row for each task of the scan
    base = lanes.select("lane", F.coalesce(F.sum("count").over(W.orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    count = stored.count()
    return stored.join(F.broadcast(base), "lane").withColumn("index", F.col("base") + F.col("local")), count


def slots(numbered: DataFrame, count: int, key: int) -> DataFrame:
    """``(slot, n, pieces)``: where each sequence stands in the training order."""
    fields = numbered.select("index", "n", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = pa.array(permuted(batch.column(0).to_numpy(), count, key))
            yield pa.RecordBatch.from_arrays([slot, batch.column(1), batch.column(2)], ["slot", "n", "pieces"])

    pieces = fields.schema["pieces"].dataType.simpleString()
    return fields.mapInArrow(run, f"slot long, n int, pieces {pieces}")


def write_shards(numbered: DataFrame, count: int, folder: str, length: int, id_bytes: int, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Write the shards below ``folder``; their manifest ``(shard, path, first, records)``.

    A task sends sequences of one shard on together, compressed; a shard's file is made
    by one task in a buffer of its size and has a name that no other attempt uses.
    """
    stride = length * id_bytes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        waiting: dict[int, list[tuple[int, bytes]]] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            own = list(waiting.items())
            places = [np.array([s for s, _ in v], np.int64).tobytes() for _, v in own]
            blocks = [packer.compress(b"".join(b.ljust(stride, b"\0") for _, b in v)) for _, v in own]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in own], pa.int64()), pa.array(places, pa.binary()), pa.array(blocks, pa.binary())], ["shard", "slots", "block"]
            )

        for batch in batches:
            for slot, ids in zip(permuted(batch.column(0).to_numpy(), count, key).tolist(), batch.column(1), strict=True):
                waiting.setdefault(slot // shard, []).append((slot, ids.as_py()))
                held += stride
            if held >= HELD:
                yield sent()
                waiting, held = {}, 0
        if waiting:
            yield sent()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, done, now, buffer = zstandard.ZstdDecompressor(), [], None, bytearray()

        def put() -> None:
            first = now * shard
            records = min(shard, count - first)
            target = f"{folder}/shard-{now:08d}-{uuid.uuid4().hex}.bin"
            system, path = fs.FileSystem.from_uri(target)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write(struct.pack(HEAD, MAGIC, id_bytes, length, first, records))
                out.write(bytes(buffer[: records * stride]))
            done.append((now, target, first, records))

        for batch in batches:
            for own, places, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if own != now:
                    if now is not None:
                        put()
                    now, buffer = own, bytearray(shard * stride)
                data = unpacker.decompress(block.as_py())
                for i, slot in enumerate(np.frombuffer(places.as_py(), np.int64).tolist()):
                    at = (slot - own * shard) * stride
                    buffer[at : at + stride] = data[i * stride : (i + 1) * stride]
        if now is not None:
            put()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["shard", "path", "first", "records"])

    blocks = numbered.select("index", "ids").mapInArrow(send, "shard long, slots binary, block binary")
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-count // shard))
    span = max(1, -(-shards // parts))  # shards of a partition: their ranges are known, nothing is sampled
    ranged = blocks.repartitionById(min(parts, shards), F.floor(F.col("shard") / span).cast("int")).sortWithinPartitions("shard")
    return materialize(ranged.mapInArrow(write, "shard long, path string, first long, records long"), "manifest")


def read_shards(manifest: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """``(slot, ids binary)`` from slot ``start`` on, in order within a shard; ids are
    padded with zeros to the stride.  Shards outside the range are not opened."""
    end = (1 << 62) if stop is None else stop
    wanted = manifest.where((F.col("first") + F.col("records") > start) & (F.col("first") < end)).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(target)
                with system.open_input_file(path) as file:
                    magic, id_bytes, length, first, records = struct.unpack(HEAD, file.read(struct.calcsize(HEAD)))
                    if magic != MAGIC:
                        raise ValueError(f"{target} is no shard")
                    stride, slot = id_bytes * length, max(first, start)
                    file.seek(struct.calcsize(HEAD) + (slot - first) * stride)
                    last = min(first + records, end)
                    while slot < last:
                        n = min(1024, last - slot)
                        data = file.read(n * stride)
                        rows = [data[i * stride : (i + 1) * stride] for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(range(slot, slot + n), pa.int64()), pa.array(rows, pa.binary())], ["slot", "ids"])
                        slot += n

    return wanted.repartition(F.col("path")).mapInArrow(run, "slot long, ids binary")


def materialise_order(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, key: int = KEY, shard: int = SHARD, vocabulary: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as shards in training order: their manifest, and the index
    ``(slot, n, pieces)`` that tells which documents' ids a slot holds.

    Null and empty texts are documents of one id, the end.  Null document ids stay null.
    Repeated rows are written once each.  Long texts run over as many sequences as they
    need; a task's last sequence is padded.  Other columns are not read.  An empty table
    gives no shards.
    """
    path = vocabulary or tokens.vocabulary()
    numbered, count = placed(sequences(docs, doc_id, text, path, length))
    folder = fresh_path(docs.sparkSession, "shards")
    manifest = write_shards(numbered, count, folder, length, np.dtype(tokens.id_type(path)).itemsize, shard, key)
    return manifest, slots(numbered, count, key)
