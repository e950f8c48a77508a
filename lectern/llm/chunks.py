"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes, and a chunk ends where the hash of the last
``WINDOW`` bytes is small, so where chunks end depends on the text around and not on
where it stands: an insertion moves the chunks after it but does not change them.
Chunks with one digest are one passage.

A repeated passage of at least ``LEAST_WORDS`` words is found in two steps.  Chunks of a
row that follow each other and repeat, at one distance, in one other row are a run; a run
of that many words is a repeated passage.  Shorter runs are seeds: where they and the
chunks that they reach into could hold such a passage, windows of exactly that many words
are hashed from the text and count if another row holds them.  Only texts with such seeds
are shuffled.

Texts are chunked twice, once to count digests and once to find those that repeat, which
costs CPU time but writes no table of all chunks.  A passage that a third of all
documents hold is one digest: it is counted with partial sums, and joined to one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import sieve
from lectern.storage import materialize

WINDOW = 16  # a power of two
SHORTEST, MEAN, LONGEST = 12, 32, 256  # bytes: least, expected beyond the least, most
LEAST_WORDS = 51
BLOCK = 1 << 20  # characters encoded at a time
W_BYTES = 24  # bytes of a word, to bound what is read around a short run
REACH, REACH_WORDS = 64, 16  # bytes that a passage may reach beyond the chunks around a run, and words there
_OUT = 100_000  # rows given back to Spark at a time
_SPAN = 4 << 20  # bytes of a text whose windows are hashed at a time
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# bits of the numbers that one long holds for a chunk: its bytes and words, those of the two chunks before, those of the next
_SHAPE = {"length": 9, "words": 9, "lead": 10, "lead_words": 10, "trail": 9, "trail_words": 9}


def gear_table() -> np.ndarray:
    """256 mixed 32-bit values, from the byte's number."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the ``WINDOW`` bytes up to each byte: sums of twice as many bytes
    from sums of half as many."""
    h, span = GEAR[data], 1
    scale = np.uint32(32 // WINDOW)  # spreads the window over all 32 bits
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span * scale))
        span *= 2
    return h


def chunks_of(text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where the chunks of a text's UTF-8 end, the words begun in each, and their digests.

    The text is encoded in blocks of characters; what a block leaves over goes before the
    next one, with the bytes that its first hashes need, so blocks leave no trace.
    """
    ends: list[int] = []
    words: list[np.ndarray] = []
    digests: list[bytes] = []
    held, at, last = b"", 0, 0  # bytes kept, where they begin in the text, where the open chunk begins in them
    for i in range(0, len(text), block):
        data = held + text[i : i + block].encode("utf-8", "surrogatepass")
        size, final = len(data), i + block >= len(text)
        own = np.frombuffer(data, np.uint8)
        marks = np.nonzero(rolling(own) < np.uint32((1 << 32) // MEAN))[0] + 1
        first, cuts = last, []
        for mark in marks[np.searchsorted(marks, last, "right") :].tolist():
            while mark - last > LONGEST:
                last += LONGEST
                cuts.append(last)
            if mark - last >= SHORTEST:
                last = mark
                cuts.append(last)
        while size - last > LONGEST:
            last += LONGEST
            cuts.append(last)
        if final and size > last:
            last = size
            cuts.append(last)
        space = _SPACE[own]
        begun = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
        begins = np.array([first, *cuts[:-1]] if cuts else [], np.int64)
        stops = np.array(cuts, np.int64)
        ends += (stops + at).tolist()
        words.append(begun[stops] - begun[begins])
        view = memoryview(data)
        digests += [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begins.tolist(), cuts, strict=True)]
        keep = max(0, last - WINDOW)
        held, at, last = data[keep:], at + keep, last - keep
    return np.array(ends, np.int64), np.concatenate(words) if words else np.zeros(0, np.int64), digests


def chunk_ends(data: bytes) -> np.ndarray:
    """Where the chunks of ``data`` end (exclusive); none for empty data."""
    return chunks_of(data.decode("utf-8", "surrogatepass"))[0]


def _shapes(lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The numbers of ``_SHAPE`` of each chunk of a text, as one long."""
    two = lambda x: np.concatenate([[0, 0], x])[: len(x)] + np.concatenate([[0], x])[: len(x)]
    following = lambda x: np.concatenate([x[1:], [0]])
    out, shift = np.zeros(len(lengths), np.int64), 0
    for bits, own in zip(_SHAPE.values(), (lengths, words, two(lengths), two(words), following(lengths), following(words)), strict=True):
        out |= own.astype(np.int64) << shift
        shift += bits
    return out


def _shape(name: str) -> Column:
    names = list(_SHAPE)
    shift = sum(_SHAPE[n] for n in names[: names.index(name)])
    return F.shiftright("shape", shift).bitwiseAND(F.lit((1 << _SHAPE[name]) - 1)).alias(name)


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(row_no, doc_id, text)``; a stored table gives the same numbers at each reading."""
    return docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def chunk_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(row_no, doc_id, start, shape, digest)`` per chunk; offsets in bytes."""
    narrow = _numbered(docs, doc_id, text)
    names = ["row_no", "doc_id", "start", "shape", "digest"]
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            parts: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
            held = 0
            for row, text_of in enumerate(batch.column(2)):
                ends, words, digests = chunks_of(text_of.as_py() or "")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                rows.append(np.full(len(ends), row))
                parts.append((starts, _shapes(ends - starts, words), digests))
                held += len(ends)
                if held and (held >= _OUT or row == batch.num_rows - 1):
                    index = pa.array(np.concatenate(rows))
                    whole = pa.RecordBatch.from_arrays(
                        [batch.column(0).take(index), batch.column(1).take(index)]
                        + [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in range(2)]
                        + [pa.array([d for p in parts for d in p[2]], pa.binary())],
                        names,
                    )
                    for i in range(0, held, _OUT):
                        yield whole.slice(i, _OUT)
                    rows, parts, held = [], [], 0

    return narrow.mapInArrow(run, f"row_no long, doc_id {kind}, start long, shape long, digest binary")


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """Every occurrence of a chunk that more than one row holds (with ``within``, that
    occurs more than once), with its first and last place by id, row and offset."""
    rows = chunk_rows(docs, doc_id, text)
    place = F.struct("doc_id", "row_no", "start")
    known = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("last"))
    known = materialize(known.where("copies > 1" if within else "first.row_no <> last.row_no"), "repeated")
    return rows.join(known, "digest")


def _runs(chunks: DataFrame, least_words: int) -> DataFrame:
    """Runs of chunks that repeat at one distance in one other row, and are all first
    occurrences or none; ``stretch`` numbers the unbroken stretches of runs of a row.

    ``sure`` are runs of ``least_words`` words in one other row, and what stands between two
    of them that repeat at the same distance in the same row.
    """
    end = F.col("start") + F.col("length")
    by_place = W.partitionBy("row_no").orderBy("start")
    elsewhere = F.when(F.col("first.row_no") != F.col("row_no"), F.col("first")).otherwise(F.col("last"))
    same = lambda c: F.lag(c).over(by_place) == F.col(c)
    own = (F.col("first.row_no") == F.col("row_no")) & (F.col("first.start") == F.col("start"))
    placed = chunks.select(
        "row_no", "doc_id", "start", *(_shape(n) for n in _SHAPE), "copies", "first", own.alias("own"),
        elsewhere["row_no"].alias("with"), (elsewhere["start"] - F.col("start")).alias("shift"),
    ).withColumn("end", end)
    new = F.coalesce(F.lag("end").over(by_place) != F.col("start"), F.lit(True))
    broken = ~F.coalesce(same("own") & same("with") & same("shift"), F.lit(False))
    marked = placed.withColumn("new", new).withColumn("broken", F.col("new") | broken)
    so_far = by_place.rowsBetween(W.unboundedPreceding, 0)
    numbered = marked.withColumn("stretch", F.sum(F.col("new").cast("long")).over(so_far)).withColumn(
        "run", F.sum(F.col("broken").cast("long")).over(so_far)
    )
    at = lambda pick, c: pick(F.struct("start", c))[c]
    runs = numbered.groupBy("row_no", "doc_id", "stretch", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.max("copies").alias("copies"),
        F.min("first.doc_id").alias("first_doc_id"), F.first("own").alias("own"),
        F.first("with").alias("with"), F.first("shift").alias("shift"),
        *(at(F.min, c).alias(c) for c in ("lead", "lead_words")), *(at(F.max, c).alias(c) for c in ("trail", "trail_words")),
    )
    whole = W.partitionBy("row_no", "stretch")
    first, final = (lambda c: F.min(F.struct("start", c)).over(whole)[c]), (lambda c: F.max(F.struct("start", c)).over(whole)[c])
    around = W_BYTES * least_words
    alone = (F.col("with") != F.col("row_no")) & (F.col("words") > least_words)  # the last word of a run may be cut
    runs = runs.withColumn("sure", alone).withColumn("to", F.when(alone, F.struct("with", "shift")))
    ordered = whole.orderBy("start")
    before = F.last("to", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    backward = whole.orderBy(F.desc("start"))  # a frame that only grows, in either direction
    after = F.last("to", ignorenulls=True).over(backward.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("sure", F.col("sure") | F.coalesce(before == after, F.lit(False))).drop("to")
    return runs.withColumns({
        "low": F.greatest(F.lit(0), F.min("start").over(whole) - first("lead") - REACH, F.col("start") - around),
        "high": F.least(F.max("end").over(whole) + final("trail") + REACH, F.col("end") + around),
        "room": F.sum("words").over(whole) + first("lead_words") + final("trail_words") + REACH_WORDS,
    }).drop("lead", "lead_words", "trail", "trail_words")


def _windows(data: bytes, low: int, high: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the whole words of ``data`` between two places, and a hash of the
    ``count`` words from each on: differences of one running sum of the words' hashes, each
    times a power of an odd number."""
    high = min(high, len(data))
    own = ~_SPACE[np.frombuffer(data, np.uint8, high - low, low)] if high > low else np.zeros(0, bool)
    edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
    begins, ends = np.nonzero(edge == 1)[0] + low, np.nonzero(edge == -1)[0] + low
    if len(begins) and begins[0] > 0 and not _SPACE[data[begins[0] - 1]]:
        begins, ends = begins[1:], ends[1:]
    if len(begins) and ends[-1] < len(data) and not _SPACE[data[ends[-1]]]:
        begins, ends = begins[:-1], ends[:-1]
    view = memoryview(data)
    words = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)), np.uint64, len(begins))
    powers = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(words) - 1), x)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(np.uint64(_BASE))[: len(words)], dtype=np.uint64)])
    hashes = (sums[count:] - sums[:-count]) * powers(np.uint64(pow(_BASE, -1, 1 << 64)))[: max(0, len(words) - count + 1)] if len(words) >= count else sums[:0]
    return begins, ends, hashes.view(np.int64)


def _verified(docs: DataFrame, seeds: DataFrame, doc_id: str, text: str, least_words: int, within: bool) -> DataFrame:
    """``(row_no, run)`` of the seeds that lie in a window of words that repeats.  Windows are
    hashed around the seeds and around the places where the rows they repeat hold them."""
    mine = seeds.select("row_no", "run", "start", "end", "low", "high")
    there = seeds.groupBy(F.col("with").alias("row_no"), *((F.col(c) + F.col("shift")).alias(c) for c in ("start", "end"))).agg(
        F.greatest(F.lit(0), F.min(F.col("low") + F.col("shift"))).alias("low"), F.max(F.col("high") + F.col("shift")).alias("high")
    )
    both = mine.unionByName(there.withColumn("run", F.lit(-1).cast("long")))
    asked = materialize(both.groupBy("row_no").agg(F.collect_list(F.struct("run", "start", "end", "low", "high")).alias("runs")), "seeds")
    narrow = _numbered(docs, doc_id, text)  # all columns of the first reading, so the rows come in the same order
    maybe = sieve.mark(narrow, sieve.build(asked, F.col("row_no")), F.col("row_no"), "maybe").where("maybe").drop("maybe")

    def of_text(row: int, data: bytes, runs: list[dict]) -> Iterator[pa.RecordBatch]:
        """Windows that hold at least half of the words begun in a run."""
        runs = sorted(runs, key=lambda r: r["low"])
        at = 0
        while at < len(runs):
            stop = at + 1
            while stop < len(runs) and runs[stop]["high"] - runs[at]["low"] <= _SPAN:
                stop += 1
            part = runs[at:stop]
            begins, ends, hashes = _windows(data, part[0]["low"], max(r["high"] for r in part), least_words)
            field = lambda c: np.array([r[c] for r in part], np.int64)
            a, b = np.searchsorted(begins, field("start")), np.searchsorted(begins, field("end"))
            need = np.maximum(1, np.minimum(b - a, least_words) // 2)
            first = np.maximum(np.searchsorted(begins, field("low")), a + need - least_words)
            last = np.minimum(np.searchsorted(ends, field("high"), "right") - least_words, b - need)
            size = np.maximum(0, last - first + 1)
            own = np.repeat(np.arange(len(part)), size)
            index = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found, lead = hashes[index], np.zeros(len(own), bool)
            lead[np.lexsort((found, own))[np.flatnonzero(np.diff(own, prepend=-1))]] = True
            for i in range(0, len(own), _OUT):
                some = own[i : i + _OUT]
                columns = (np.full(len(some), row), field("run")[some], found[i : i + _OUT])
                arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array(lead[i : i + _OUT])]
                yield pa.RecordBatch.from_arrays(arrays, ["row_no", "run", "window", "lead"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for row, value, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                held += of_text(row, value.as_py().encode("utf-8", "surrogatepass"), runs.as_py())
                if sum(b.num_rows for b in held) >= _OUT:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    windows = materialize(
        maybe.join(asked, "row_no").select("row_no", "text", "runs", "doc_id").mapInArrow(run, "row_no long, run long, window long, lead boolean"), "windows"
    )
    place = F.struct("row_no", "run") if within else F.struct("row_no")
    counted = windows.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    return _settled(windows.where("run >= 0"), materialize(counted.where("a <> b").select("window"), "shared"))


def _settled(windows: DataFrame, shared: DataFrame) -> DataFrame:
    """``(row_no, run)`` of the runs with a window that is ``shared``.  One window a run, its
    ``lead``, is looked up first, which settles most runs of a passage that many rows hold; the
    other windows are looked up for the runs that are open then."""
    leads, runs = windows.where("lead"), ["row_no", "run"]
    first = materialize(leads.join(shared, "window").select(*runs), "led")
    left = materialize(leads.select(*runs).join(first, runs, "left_anti"), "open")
    # a run that the sieve lets through by chance is looked up again and found again
    maybe = sieve.mark(windows.where("not lead"), sieve.build(left, F.struct(*runs)), F.struct(*runs), "maybe").where("maybe")
    return first.unionByName(maybe.join(shared, "window").select(*runs)).distinct()


def repeated_runs(docs: DataFrame, doc_id: str, text: str, least_words: int, within: bool) -> DataFrame:
    """The runs that are, or lie in, a repeated passage of at least ``least_words`` words."""
    runs = materialize(_runs(repeated_chunks(docs, doc_id, text, within), least_words).where(F.col("room") >= least_words), "runs")
    good = materialize(_verified(docs, runs.where("not sure"), doc_id, text, least_words, within), "verified")
    return runs.where("sure").unionByName(runs.where("not sure").join(good, ["row_no", "run"], "left_semi"))


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, within: bool = False
) -> DataFrame:
    """A row for each run of repeated chunks in a passage of at least ``least_words``
    words that more than one row holds: ``doc_id, start, length`` (bytes of UTF-8),
    ``words, copies, first_doc_id, kept``.

    ``kept`` is true for runs of first occurrences, by document id, row and place: those
    stay, and so every passage stays once.  ``copies`` is the largest number of
    occurrences of one of its chunks.  Passages that only one row repeats count with
    ``within``.  A passage whose chunks all reach beyond it is not found.

    Documents without a repeated passage have no row, so do null, empty and short texts.
    Null ids come first.  Repeated rows are rows of their own and repeat each other.  Very
    long texts are encoded in blocks.  Other columns are not read.  An empty table gives
    no rows.  ``docs`` is read three times and must give its rows in one order, as a
    stored table does.
    """
    found = repeated_runs(docs, doc_id, text, least_words, within)
    return found.select(
        "doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "words", "copies", "first_doc_id", F.col("own").alias("kept")
    )


def cut_repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, within: bool = False
) -> DataFrame:
    """``docs`` with all but the first occurrence of the chunks of repeated passages cut
    from ``text``: what is cut stays in the row where it occurs first."""
    docs = materialize(docs, "uncut")  # its rows are numbered in several readings
    gone = repeated_runs(docs, doc_id, text, least_words, within).where("not own")
    spans = materialize(gone.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "cuts")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, own in zip(texts, spans, strict=True):
            data, kept, at = value.encode("utf-8", "surrogatepass"), [], 0
            for span in own:
                kept.append(data[at : span["start"]])
                at = max(at, span["end"])
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct("*").alias("doc"))
    marked = sieve.mark(rows, sieve.build(spans, F.col("row_no")), F.col("row_no"), "maybe")
    joined = marked.where("maybe").join(spans, "row_no", "left")
    short = cut(F.col("doc")[text].cast("string"), "spans").cast(docs.schema[text].dataType)
    changed = joined.select(F.when(F.col("spans").isNull(), F.col("doc")).otherwise(F.col("doc").withField(text, short)).alias("doc"))
    return marked.where("not maybe").select("doc").unionByName(changed).select("doc.*")
