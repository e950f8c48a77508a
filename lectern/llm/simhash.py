"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within half the radius of both.
Each distinct fingerprint emits all such variants, rows meet on the variant, and a
bucket holds at most the fingerprints of one such ball (65 for radius 2), however many
documents there are: copies were folded into one fingerprint before.  For an even
radius every pair of a bucket is within the radius, so linking each member to the least
one of its bucket keeps every component; the distance of each link is verified anyway.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import sieve
from lectern.llm.components import components, extended
from lectern.storage import materialize

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
NEAR_WORDS, NEAR_SIMILARITY, PIECE = 5, 0.8, 28  # of near duplicates by similarity
LANES, CUT_LANES = 16, 9  # of 64 bits: those that tell how far two texts are apart, and those cut into pieces
CHECK, CHECK_FAR = 16, 6  # bits of other lanes that travel with a piece, and how many may differ
SPREAD = 3  # standard deviations of differing bits up to which a pair is worth a look at its shingles
SLOT_BITS, SLOT_PARTS = 22, 64  # of the counts that tell rare shingles from common ones
SLOTS = 1 << SLOT_BITS
PARITIES = 8  # longs of bits that tell how far two sets of shingles are apart at least
TURNS = 2  # times that texts of a bucket are held against a neighbour, before all against all
BLOCK = 65_536  # shingles hashed at a time: bounds memory for very long texts


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits of the same shingles; lane 0 is the hash itself."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the shingles' hashes."""
    return int(wide_fingerprint(text, words, 1)[0])


def _grams(found: list[bytes], words: int) -> np.ndarray:
    """Hashes of the shingles of a text's words, one of them all if they are too few."""
    grams = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # both ASCII only


def _ones(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """How many of the hashes have each bit set, by lane."""
    out = np.empty((lanes, 64), np.int64)
    for lane in range(lanes):
        bits = np.unpackbits(_mixed(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[lane] = bits.sum(axis=0, dtype=np.int32)
    return out


def wide_fingerprint(text: str | None, words: int, lanes: int) -> np.ndarray:
    """``lanes`` SimHashes of 64 bits each, from independent bits of each shingle."""
    found = _words(text)
    total = max(1, len(found) - words + 1) if found else 0
    ones = np.zeros((lanes, 64), np.int64)
    for start in range(0, total, BLOCK):
        ones += _ones(_grams(found[start : min(start + BLOCK, total) + words - 1], words), lanes)
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none for a text without words."""
    found = _words(text)
    total = max(1, len(found) - words + 1) if found else 0
    parts = [np.unique(_grams(found[i : min(i + BLOCK, total) + words - 1], words)) for i in range(0, total, BLOCK)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))


def set_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """As ``wide_fingerprint``, of a set: a shingle that a text repeats counts once, as in Jaccard."""
    ones = np.zeros((lanes, 64), np.int64)
    for start in range(0, len(hashes), BLOCK):
        ones += _ones(hashes[start : start + BLOCK], lanes)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp long)`` per row; the fingerprint's 64 bits are the long's bits."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def ball(radius: int) -> list[int]:
    """Masks, as signed longs, of all changes of at most ``radius`` of 64 bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints that give the components of all
    pairs within ``radius`` bits.  ``radius`` is even and at most 4."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as asked: each row becomes many
    own = fps.select("fp").repartition(parts, "fp").distinct()
    variants = own.select("fp", F.explode(F.lit(ball(radius // 2))).alias("mask"))
    met = variants.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    hub = met.withColumn("hub", F.min("fp").over(W.partitionBy("variant")))
    near = hub.where("hub <> fp").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fp long, component_id)`` per row: component_id is the least doc_id that
    links of at most ``radius`` bits reach.

    Null and empty texts, and those of white space only, have fingerprint zero and are
    linked like any other.  Null ids take no part in the least id, and stand alone only
    if their component has no other.  Repeated rows stay.  Very long texts are hashed in
    blocks.  Other columns are not read.  An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least, radius))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = materialize(rooted.join(materialize(named, "named"), "root").select("fp", "component_id"), "labels")
    return marked.join(label, "fp").select("doc_id", "fp", "component_id")


def farthest(similarity: float, bits: int) -> int:
    """Differing bits, of ``bits``, up to which a pair may be similar: those that a Jaccard
    similarity of shingles gives on average, and ``SPREAD`` standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def pieces(lanes: list[str], piece: int = PIECE) -> list[Column]:
    """Two pieces of ``piece`` bits of each lane, and those that the lanes' last bits make."""
    mask, rest = F.lit((1 << piece) - 1), 64 - 2 * piece
    out = [p for n in lanes for p in (F.col(n).bitwiseAND(mask), F.shiftrightunsigned(n, piece).bitwiseAND(mask))]
    if not rest:
        return out
    last = [F.shiftrightunsigned(n, 2 * piece) for n in lanes]
    each = -(-piece // rest)
    for i in range(0, len(last) - each + 1, each):
        joined = F.lit(0).cast("long")
        for k, own in enumerate(last[i : i + each]):
            joined = joined.bitwiseOR(F.shiftleft(own, k * rest))
        out.append(joined.bitwiseAND(mask))
    return out


def _levels(narrow: DataFrame, words: int) -> np.ndarray:
    """How common the shingles of each of ``SLOTS`` slots are, in quarters of a power of two.
    Counts of fixed size are summed in Spark, so that the driver gets ``SLOTS`` bytes."""
    width = SLOTS // SLOT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, waiting = np.zeros(SLOTS, np.int32), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append((shingle_set(text.as_py(), words) >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
                waiting += len(held[-1])
                if waiting >= 1_000_000:
                    np.add.at(seen, np.concatenate(held), 1)  # in place: counts of all slots are made once a task
                    held, waiting = [], 0
        if held:
            np.add.at(seen, np.concatenate(held), 1)
        for i in range(SLOT_PARTS):
            packed = zlib.compress(seen[i * width : (i + 1) * width].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
                sums[part] = sums.get(part, 0) + own.astype(np.int64)
        for part, own in sums.items():
            level = np.minimum(255, np.round(4 * np.log2(own + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "counts"])

    summed = narrow.select("text").mapInArrow(count, "part int, counts binary").repartition(SLOT_PARTS, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(SLOTS, np.uint8)
    for part, own in summed.collect():
        out[part * width : (part + 1) * width] = np.frombuffer(own, np.uint8)
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits that tell in which of ``PARITIES`` times 64 classes a set has an odd number of shingles:
    two sets differ in as many shingles as bits, at least."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differing(a: str, b: str) -> Column:
    """Bits in which two arrays of longs differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)


def _within(similarity: float, odd: tuple[str, str], sizes: tuple[str, str]) -> Column:
    """Whether the parities of two sets leave them a chance to be alike."""
    return _differing(*odd) <= (F.col(sizes[0]) + F.col(sizes[1])) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _needed(similarity: float, a: Column | str, b: Column | str) -> Column:
    """Shingles that sets of ``a`` and ``b`` must share to be alike."""
    return F.ceil((F.col(a) + F.col(b)) * (similarity / (1 + similarity)) - 1e-6)


def _shared(nodes: DataFrame, words: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """``(token, node, size, room, first)``: of each text's shingles, rarest first, those of which
    two texts that are alike share one, if any other text has it among its own; ``room`` is how
    many shingles of the text follow, itself included, and ``first`` the least text's row."""
    kind = nodes.schema["doc_id"].dataType.simpleString()
    names = ["token", "node", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tokens, shapes, sizes = [], [], []
                for text in part.column(1):
                    own = shingle_set(text.as_py(), words)
                    first = len(own) - math.ceil(similarity * len(own) - 1e-6) + 1 if len(own) else 0
                    order = np.lexsort((own, levels[own >> np.uint64(64 - SLOT_BITS)]))[:first]
                    tokens.append(own[order].view(np.int64))
                    shapes.append(np.int64(len(own) << 32) | (len(own) - np.arange(len(order), dtype=np.int64)))
                    sizes.append(len(order))
                node = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), node, pa.array(np.concatenate(shapes))], names)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as asked: each row becomes many
    rows = nodes.mapInArrow(run, f"token long, node {kind}, shape long").repartition(parts, "token")
    bucket = W.partitionBy("token")
    least = F.min(F.struct("node", "shape")).over(bucket)
    met = rows.withColumn("many", F.count("*").over(bucket)).where("many > 1").withColumn("first", least)
    size, room = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    return met.select(
        "token", "node", size("shape").alias("size"), room("shape").alias("room"), F.col("first.node").alias("first"),
        size("first.shape").alias("first_size"), room("first.shape").alias("first_room"),
    )


def _mixed_buckets(shared: DataFrame, odd: DataFrame, roots: DataFrame) -> DataFrame:
    """``(token, root, node, size, room, odd)`` of the shingles whose texts have several roots."""
    known = odd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = shared.select("token", "node", "size", "room").join(known, "node")
    bucket = W.partitionBy("token")
    mixed = told.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).where("low <> high")
    return mixed.select("token", "root", "node", "size", "room", "odd").distinct()


def _beside(mixed: DataFrame, similarity: float, turn: int) -> DataFrame:
    """``(u, v)`` of texts of different roots that follow each other in a shingle's bucket, in an
    order that differs from bucket to bucket: one pair a row at most."""
    order = W.partitionBy("token").orderBy(F.xxhash64("token", "node", F.lit(turn)), "node")
    last = F.lag(F.struct("node", "root", "size", "room", "odd")).over(order)
    met = mixed.withColumn("last", last).select("*", F.col("last.size").alias("last_size"))
    met = met.where(_within(similarity, ("odd", "last.odd"), ("size", "last_size")))
    fits = (F.col("last.root") != F.col("root")) & (F.least("room", "last.room") >= _needed(similarity, "size", "last_size"))
    return met.where(fits).select(F.greatest("node", "last.node").alias("u"), F.least("node", "last.node").alias("v")).distinct()


def _across(mixed: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)`` of all texts of different roots that may be alike: they share one of their rarest
    shingles, with room after it for as many as alike texts share, and parities near enough.  Roots meet before texts do, so
    a group that is linked already makes no pairs, whatever its size."""
    group = mixed.groupBy("token", "root").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("room").alias("room"))
    named = lambda rows, end, *keep: rows.select(*keep, *(F.col(c).alias(f"{c}_{end}") for c in rows.columns if c not in keep))
    g, h = named(group, "u", "token"), named(group, "v", "token")
    fits = (
        (F.col("root_u") > F.col("root_v")) & (F.least("room_u", "room_v") >= _needed(similarity, "least_u", "least_v"))
        & (F.col("most_u") >= similarity * F.col("least_v") - 1e-6) & (F.col("most_v") >= similarity * F.col("least_u") - 1e-6)
    )
    groups = materialize(g.join(h, "token").where(fits).select("token", "root_u", "root_v"), "groups")
    a = mixed.select("token", F.col("root").alias("root_u"), F.col("node").alias("u"), F.col("size").alias("size_u"), F.col("room").alias("room_u"), F.col("odd").alias("odd_u"))
    b = mixed.select("token", F.col("root").alias("root_v"), F.col("node").alias("v"), F.col("size").alias("size_v"), F.col("room").alias("room_v"), F.col("odd").alias("odd_v"))
    alike = (F.least("room_u", "room_v") >= _needed(similarity, "size_u", "size_v")) & _within(similarity, ("odd_u", "odd_v"), ("size_u", "size_v"))
    met = groups.join(a, ["token", "root_u"]).join(b, ["token", "root_v"]).where(alike)
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, narrow: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of written ``(u, v)``, those whose texts are alike in ``similarity`` of their shingles.
    Shingles are made for the texts that the pairs name, and for no others."""
    asked = materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "asked")
    named = sieve.mark(narrow, sieve.build(asked, F.col("doc_id")), F.col("doc_id"), "maybe").where("maybe").drop("maybe")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                own = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "own"])

    # dealt by id here, so that one exchange serves both ends and no table of sets is written
    sets = named.join(asked, "doc_id").mapInArrow(run, f"doc_id {kind}, own array<long>").repartition("doc_id")
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("own").alias("a")), "u").join(
        sets.select(F.col("doc_id").alias("v"), F.col("own").alias("b")), "v"
    )
    shared = F.size(F.array_intersect("a", "b"))
    alike = both.where(shared / (F.size("a") + F.size("b") - shared) >= similarity).select("u", "v").distinct()
    return materialize(alike.hint("rebalance"), "alike")  # few rows, so few files


def _linked(fresh: DataFrame, tested: DataFrame, roots: DataFrame, narrow: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``tested`` and ``roots`` after written ``fresh`` pairs are verified, as they were if there are none."""
    if fresh.isEmpty():
        return tested, roots
    found = _verified(fresh, narrow, words, similarity)
    return tested.unionByName(fresh), roots if found.isEmpty() else materialize(extended(roots, found), "roots")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (``u``, ``v``) whose ends no links join."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("u", "v"))
    joined = pairs.join(a, "u", "left").join(b, "v", "left")
    return joined.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).drop("root_u", "root_v")


def similar_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY,
    piece: int = PIECE, check_far: int = CHECK_FAR, along: int | None = None, exact: bool = True,
) -> DataFrame:
    """``(doc_id, component_id)`` per row, linked at a Jaccard similarity of shingle sets.

    Texts with equal sets are one node.  Fingerprints of ``CUT_LANES`` times 64 bits find most
    links: texts with an equal piece are held against the least of them, if ``CHECK`` other bits
    of both differ in ``check_far`` at most and all ``LANES`` together are not farther apart
    than ``farthest``.  A candidate counts if the shingles themselves say so.

    With ``exact`` no link between two components is missed: two texts that are alike share one
    of the shingles that come first in each, rarest first, with room after it for all that they
    must share.  A text is held against the least one that shares such a shingle, ``TURNS`` times
    against one of another component in each shingle's bucket, and then all texts that share
    such a shingle and are not joined by links yet are held against each other.  The number of
    these pairs grows with the square of texts that are nearly alike and not linked, and with
    nothing else: what is linked already makes no pairs, a passage that many texts share comes
    last, and the parities of the shingles rule out most pairs that are not quite alike.  ``along`` has no effect any more.

    Null, empty and blank texts have one shingle set and are linked.  Rows with a null id
    have a null component.  Repeated rows stay.  Very long texts are hashed in blocks.
    Other columns are not read.  An empty table gives no rows.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = [f"f{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, same, odd = np.empty((batch.num_rows, LANES), np.uint64), [], []
            for i, t in enumerate(batch.column(1)):
                own = shingle_set(t.as_py(), words)
                fps[i] = set_fingerprint(own, LANES)
                same.append(xxhash.xxh3_128_digest(own.tobytes()))
                odd.append(parities(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), pa.array(odd, pa.list_(pa.int64())), *(pa.array(fps[:, i].view(np.int64)) for i in range(LANES))],
                ["doc_id", "same", "odd", *names],
            )

    marked = materialize(narrow.mapInArrow(run, f"doc_id {kind}, same binary, odd array<long>, " + ", ".join(f"{n} long" for n in names)), "wide")
    least = materialize(
        marked.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"), *(F.first(n).alias(n) for n in ("odd", *names))), "distinct"
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as asked: each row becomes many
    per_lane = 64 // CHECK
    check = lambda i: F.shiftrightunsigned(names[CUT_LANES + i // per_lane], CHECK * (i % per_lane)).bitwiseAND(F.lit((1 << CHECK) - 1))
    tables = F.array(*(
        F.struct(F.lit(i << piece).bitwiseOR(p).alias("part"), check(i).alias("check")) for i, p in enumerate(pieces(names[:CUT_LANES], piece))
    ))
    cut = least.select("node", F.explode(tables).alias("t")).select("node", "t.*").repartition(parts, "part")
    hub = cut.withColumn("first", F.min(F.struct("node", "check")).over(W.partitionBy("part"))).where("first.node <> node")
    near = F.bit_count(F.col("check").bitwiseXOR(F.col("first.check"))) <= check_far
    pairs = hub.where(near).groupBy(F.col("node").alias("u")).agg(F.min("first.node").alias("v"))
    prints, limit = least.select("node", F.array(*names).alias("mine")), farthest(similarity, 64 * LANES)
    left, right = (prints.select(F.col("node").alias(c), F.col("mine").alias(f"of_{c}")) for c in ("u", "v"))
    tested = materialize(materialize(pairs, "hubs").join(left, "u").join(right, "v").where(_differing("of_u", "of_v") <= limit).select("u", "v"), "close")
    roots = materialize(components(_verified(tested, narrow, words, similarity)), "roots")
    if exact:
        copies = materialize(marked.where("doc_id is not null").join(least.select("same", "node"), "same").where("doc_id <> node").select("doc_id"), "copies")
        nodes = sieve.without(narrow.where("doc_id is not null"), copies, {"doc_id": F.col("doc_id")})
        shared = materialize(_shared(nodes, words, similarity, _levels(narrow, words)), "shared")
        room = F.least("room", "first_room") >= _needed(similarity, "size", "first_size")
        pairs = shared.where((F.col("first") != F.col("node")) & room).groupBy(F.col("node").alias("u")).agg(F.min("first").alias("v"))
        fresh = materialize(_apart(materialize(pairs, "hubs"), roots).join(tested, ["u", "v"], "left_anti"), "fresh")
        tested, roots = _linked(fresh, tested, roots, narrow, words, similarity)
        for turn in range(TURNS + 1):
            mixed = _mixed_buckets(shared, least.select("node", "odd"), roots)  # read once by a turn
            pairs = _beside(mixed, similarity, turn) if turn < TURNS else _across(materialize(mixed, "mixed"), similarity)
            fresh = materialize(pairs.join(tested, ["u", "v"], "left_anti"), "fresh")
            tested, roots = _linked(fresh, tested, roots, narrow, words, similarity)
    rooted = least.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return marked.join(materialize(rooted, "rooted"), "same", "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of ``similar_components``: that with the
    least id."""
    found = similar_components(docs, doc_id, text, **how)
    losers = materialize(found.where("doc_id <> component_id").select("doc_id"), "losers")
    return sieve.without(docs, losers, {"doc_id": F.col(doc_id)})


def as_hex(fp: str | Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
