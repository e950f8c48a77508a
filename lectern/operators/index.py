"""A stored inverted index: postings with positions, parted by the hash of the term.

Below the index's folder lie four Parquet tables:

* ``postings/bucket=b``: ``term, key, segment, size, at, head`` - where a term stands in a
  document's text and in its title, beside the document's length; a bucket's files are
  sorted by term, so a query reads the row groups of its terms and no text;
* ``terms/bucket=b``: the sorted dictionary that prefixes are looked up in;
* ``documents``: ``key, segment, size, stamp``; and
* ``ledger``: a row for each change with what it adds to the number and length of documents.

A change appends a segment for new and changed documents, and tombstones for changed and
gone ones: a posting is dead if its document has a younger tombstone.  ``compact`` writes
buckets anew without their dead postings, by dynamic partition overwrite.  A term's
documents are spread over ``SLICES`` files of its bucket or more, by the size of the texts, so
a word of every document is no one task's work and a file is sorted in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import TOKEN, tokens
from lectern.operators.retrieval import K1, LEAST_IDF, TITLE_WEIGHT, B
from lectern.storage import materialize

BUCKETS, SLICES = 16, 4
FILE_BYTES = 24_000_000  # bytes of text, for a bucket's slice, beyond which a segment has more slices
BLOCK_WORDS = 1_000_000  # words gathered at a time
BLOCK_POSTINGS = 200_000  # postings packed at a time when an index is made compact
MOST_BURIED = 4_000_000  # tombstones up to which they are sent to all tasks, at about 50 bytes each
POSTING = ["term", "key", "size", "at", "head", "bucket"]
SCHEMA = "term string, key {key}, segment int, size long, at array<int>, head array<int>, bucket int"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def parts_of(term: str) -> list[str]:
    """The words of a term: one, several of a phrase, or a beginning with its star."""
    return term.split(" ")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by the million words, one row at least."""
    ends, start = np.cumsum(batch.column(2).value_lengths().to_numpy() + batch.column(3).value_lengths().to_numpy()), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_WORDS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _gathered(batch: pa.RecordBatch, buckets: int, slices: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Postings of rows ``(key, slice, text, title)`` of words, in order of part, term and key,
    and the part of each: its bucket's slice."""
    batch = batch.take(pc.array_sort_indices(batch.column(0)))
    lists = [batch.column(i) for i in (2, 3)]
    lengths = [own.value_lengths().to_numpy().astype(np.int64) for own in lists]
    row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in lengths])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths])
    head = np.repeat([0, 1], [n.sum() for n in lengths])
    words = pa.concat_arrays([own.flatten() for own in lists]).dictionary_encode()
    by_value = pc.array_sort_indices(words.dictionary)
    known, rank = words.dictionary.take(by_value), np.argsort(by_value.to_numpy())
    code = rank[words.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in known.to_pylist()), np.int64, len(known))
    part = bucket[code] * slices + batch.column(1).to_numpy()[row]
    # text stands before title, and places are in order already
    whole = ((part * len(known) + code) * batch.num_rows + row) * 2 + head
    order = np.argsort(whole, kind="stable")
    posting, place, head = whole[order] >> 1, place[order].astype(np.int32), head[order]
    first = np.flatnonzero(np.diff(posting, prepend=-1))  # where each document of a term begins
    ends = lambda own: pa.array(np.concatenate([[0], np.cumsum(own)])[np.append(first, len(own))].astype(np.int32))
    places = [pa.ListArray.from_arrays(ends(head == h), pa.array(place[head == h])) for h in (0, 1)]
    at = order[first]
    rows = row[at]
    columns = [known.take(pa.array(code[at])), batch.column(0).take(pa.array(rows)), pa.array((lengths[0] + lengths[1])[rows]), *places]
    return pa.RecordBatch.from_arrays([*columns, pa.array(bucket[code[at]].astype(np.int32))], POSTING), part[at]


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _sent(rows: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    """``(part, rows)``: rows that stand in order of their part, packed part by part."""
    ends = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    packed = [_packed(rows.slice(i, j - i)) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], ["part", "rows"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that ``_sent`` packed."""
    for batch in batches:
        for packed in batch.column(1):
            yield from pa.ipc.open_stream(packed.as_buffer())


def _resent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings behind their part, packed part by part, ``BLOCK_POSTINGS`` and a batch at a time at most."""
    held: list[pa.RecordBatch] = []

    def flushed() -> pa.RecordBatch:
        whole = pa.concat_batches(held)
        part = whole.column(0).to_numpy()
        order = np.argsort(part, kind="stable")
        return _sent(whole.select(whole.schema.names[1:]).take(pa.array(order)), part[order])

    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= BLOCK_POSTINGS:
            yield flushed()
            held = []
    if held:
        yield flushed()


class InvertedIndex:
    """An index in ``path``; ``kind`` is the SQL type of the documents' keys.

    Keys are not null and tell documents apart: of rows with one key all texts count as
    one document's.  Null texts and titles have no words; a document without words counts
    among the documents.  Stamps may be null: null equals null and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", buckets: int = BUCKETS):
        self.spark, self.path, self.kind, self.buckets = spark, path, kind, buckets

    # what is stored

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, rows: DataFrame, name: str, *parts: str) -> None:
        rows.write.mode("append").option("compression", "zstd").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def tombstones(self) -> DataFrame:
        """``(key, buried)``: documents' segments below ``buried`` are dead."""
        return self._read("tombstones", f"key {self.kind}, segment int").groupBy("key").agg(F.max("segment").alias("buried"))

    def _living(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``key, segment``, others) whose documents have no younger tombstone."""
        buried = self.tombstones()
        count = self._read("tombstones", f"key {self.kind}, segment int").count()  # of files' footers
        if not count:
            return rows
        return rows.join(F.broadcast(buried) if count <= MOST_BURIED else buried, "key", "left").where("buried is null or segment >= buried").drop("buried")

    def documents(self) -> DataFrame:
        """``(key, segment, size, stamp)`` of the documents that are in the index."""
        return self._living(self._read("documents", f"key {self.kind}, segment int, size long, stamp string"))

    def postings(self) -> DataFrame:
        return self._read("postings", SCHEMA.format(key=self.kind))

    def statistics(self) -> DataFrame:
        """One row ``(n, mean_size)``, from the ledger of changes."""
        sums = self._read("ledger", "documents long, words long").agg(F.sum("documents").alias("n"), F.sum("words").alias("words"))
        return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.col("words").cast("double"), F.col("n")).alias("mean_size"))

    # changes

    def _posted(self, docs: DataFrame, segment: int, slices: int, repeated: bool) -> DataFrame:
        """Postings of ``docs``: gathered where a text is read, and shuffled as compressed Arrow
        batches, each of one part and in order, so that few runs are left to be merged."""
        buckets = self.buckets
        own = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int").alias("slice")
        words = docs.select("key", own, tokens(F.col("text")).alias("text"), tokens(F.col("title")).alias("title"))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _blocks(batch):
                    yield _sent(*_gathered(block, buckets, slices))

        parted = words.mapInArrow(gather, "part int, rows binary").repartitionById(buckets * slices, F.col("part"))
        posted = parted.mapInArrow(_dealt, f"term string, key {self.kind}, size long, at array<int>, head array<int>, bucket int")
        if repeated:  # rows of one key are one document
            every = lambda c: F.sort_array(F.flatten(F.collect_list(c))).alias(c)
            own = posted.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices))).repartition(buckets * slices, "bucket", "slice")
            posted = own.groupBy("bucket", "slice", "term", "key").agg(F.max("size").alias("size"), every("at"), every("head"))
        return posted.select("term", "key", F.lit(segment).alias("segment"), "size", "at", "head", "bucket").sortWithinPartitions("bucket", "term", "key")

    def _store(self, docs: DataFrame, buried: DataFrame, segment: int) -> None:
        length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("text", "title")), F.lit(0))
        slices = self._slices(docs.agg(F.sum(length.cast("long"))).first()[0] or 0)
        repeated = not docs.groupBy("key").count().where("count > 1").isEmpty()
        self._append(self._posted(docs, segment, slices, repeated), "postings", "bucket")
        own = docs.select("key", F.lit(segment).alias("segment"), F.col("stamp").cast("string").alias("stamp"), "text", "title")
        if repeated:
            words = sum((F.coalesce(F.regexp_count(F.lower(c), F.lit(TOKEN)), F.lit(0)) for c in ("text", "title")), F.lit(0))
            sizes = own.withColumn("size", words.cast("long"))
        else:  # a document's size stands in its postings
            stated = self._read("postings", SCHEMA.format(key=self.kind)).where(F.col("segment") == segment).groupBy("key").agg(F.max("size").alias("size"))
            sizes = own.drop("text", "title").join(stated, "key", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
        self._append(sizes.select("key", "segment", "size", "stamp"), "documents")
        known = self._read("postings", SCHEMA.format(key=self.kind)).where(F.col("segment") == segment).select("bucket", "term").distinct()
        self._append(known.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term"), "terms", "bucket")
        self._append(buried.select("key", F.lit(segment).alias("segment")), "tombstones")

    def _slices(self, size: int) -> int:
        return max(SLICES, -(-size // (self.buckets * FILE_BYTES)))

    def build(self, docs: DataFrame, key: str, stamp: Column | None = None, title: str | None = "title", text: str = "text") -> None:
        """Index ``docs`` in an empty folder."""
        rows = self._named(docs, key, stamp, title, text)
        self._store(rows, rows.limit(0), 0)
        totals = self._read("documents", f"key {self.kind}, segment int, size long, stamp string")
        self._append(totals.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")), "ledger")

    def _named(self, docs: DataFrame, key: str, stamp: Column | None, title: str | None, text: str) -> DataFrame:
        head = F.col(title) if title else F.lit(None).cast("string")
        mark = F.lit(None).cast("string") if stamp is None else stamp.cast("string")
        return docs.select(F.col(key).alias("key"), mark.alias("stamp"), head.alias("title"), F.col(text).alias("text"))

    def update(self, docs: DataFrame, key: str, stamp: Column, title: str | None = "title", text: str = "text") -> dict[str, int]:
        """Bring the index to ``docs``, all documents as they are now: those with another
        stamp are indexed anew, those that are gone are buried.  Returns the counts."""
        now = self._named(docs, key, stamp, title, text)
        had = self.documents().select("key", F.col("stamp").alias("had"), F.col("size").alias("old"), F.lit(True).alias("known"))
        told = now.select("key", "stamp", F.lit(True).alias("here")).join(had, "key", "full")
        fate = (
            F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "removed")
            .when(~F.col("stamp").eqNullSafe(F.col("had")), "updated")
        )
        changes = materialize(told.select("key", "old", fate.alias("fate")).where("fate is not null"), "changes")
        counts = {r["fate"]: (r["n"], r["old"] or 0) for r in changes.groupBy("fate").agg(F.count("*").alias("n"), F.sum("old").alias("old")).collect()}
        if counts:
            segment = 1 + self._read("tombstones", f"key {self.kind}, segment int").unionByName(
                self._read("documents", f"key {self.kind}, segment int, size long, stamp string").select("key", "segment")
            ).agg(F.max("segment")).first()[0]
            fresh = materialize(now.join(changes.where("fate <> 'removed'").select("key"), "key", "left_semi"), "fresh")
            self._store(fresh, changes.where("fate <> 'added'").select("key"), segment)
            own = self._read("documents", f"key {self.kind}, segment int, size long, stamp string").where(F.col("segment") == segment)
            gained = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"))
            lost = sum(counts.get(f, (0, 0))[0] for f in ("removed", "updated")), sum(counts.get(f, (0, 0))[1] for f in ("removed", "updated"))
            self._append(gained.select((F.col("n") - lost[0]).alias("documents"), (F.col("words") - lost[1]).alias("words")), "ledger")
        return {fate: counts.get(fate, (0, 0))[0] for fate in ("added", "updated", "removed")}

    def compact(self, buckets: Sequence[int] | None = None) -> None:
        """Write ``buckets`` (all if none are named) without their dead postings."""
        mine = self.postings() if buckets is None else self.postings().where(F.col("bucket").isin(*buckets))
        # a dynamic overwrite takes the place of the buckets once all of the new ones are written
        put = lambda rows, name: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")
        words = self._read("documents", f"key {self.kind}, segment int, size long, stamp string").agg(F.sum("size")).first()[0] or 0
        slices = self._slices(6 * words)
        part = (F.col("bucket") * slices + F.pmod(F.xxhash64("key"), F.lit(slices))).cast("int")
        columns = ["term", "key", "segment", "size", "at", "head", "bucket"]
        packed = self._living(mine).select(part.alias("part"), *columns).mapInArrow(_resent, "part int, rows binary")
        dealt = packed.repartitionById(self.buckets * slices, F.col("part")).mapInArrow(_dealt, SCHEMA.format(key=self.kind))
        put(dealt.sortWithinPartitions("bucket", "term", "key"), "postings")
        written = self.postings() if buckets is None else self.postings().where(F.col("bucket").isin(*buckets))
        put(written.select("bucket", "term").distinct().repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term"), "terms")

    # searches

    def words_from(self, beginnings: Sequence[str]) -> DataFrame:
        """``(bucket, term)`` of the words that begin so, from the sorted dictionary."""
        rows = self._read("terms", "term string, bucket int")
        return rows.where(_any(F.col("term").startswith(b) for b in beginnings)).distinct()

    def _postings_of(self, terms: Sequence[str]) -> DataFrame:
        """Living postings of all words that ``terms`` are made of: only their buckets are read."""
        parts = list(dict.fromkeys(p for t in terms for p in parts_of(t)))
        words, beginnings = [p for p in parts if not p.endswith("*")], [p[:-1] for p in parts if p.endswith("*")]
        buckets = {zlib.crc32(w.encode()) % self.buckets for w in words}  # as bucket_of
        if beginnings:
            buckets |= {r[0] for r in self.words_from(beginnings).select("bucket").distinct().collect()}  # at most all buckets
        meant = F.col("term").isin(*words)
        if beginnings:
            meant |= _any(F.col("term").startswith(b) for b in beginnings)
        return self._living(self.postings().where(F.col("bucket").isin(*buckets) & meant))

    def lookup(self, terms: Sequence[str], title_weight: float = TITLE_WEIGHT) -> DataFrame:
        """``(key, size, weights array<double>)`` of the documents that hold any part of a
        term, as ``retrieval.term_counts`` gives them for the whole corpus."""
        parts = list(dict.fromkeys(p for t in terms for p in parts_of(t)))
        held = self._postings_of(terms)
        of = {p: F.col("term").startswith(p[:-1]) if p.endswith("*") else F.col("term") == p for p in parts}
        gathered = held.groupBy("key").agg(
            F.max("size").alias("size"),
            *(F.flatten(F.collect_list(F.when(of[p], F.col(field)))).alias(f"{field}_{i}") for i, p in enumerate(parts) for field in ("at", "head")),
        )

        def shifted(places: str, by: int) -> Column:
            return F.transform(places, lambda at: at - by)

        def times(term: str, field: str) -> Column:
            """Places where all words of the term follow each other."""
            places = [shifted(f"{field}_{parts.index(p)}", i) for i, p in enumerate(parts_of(term))]
            both = places[0]
            for own in places[1:]:
                both = F.array_intersect(both, own)
            return F.size(both)

        weights = ((times(t, "at") + title_weight * times(t, "head")).cast("double") for t in terms)
        return gathered.select("key", "size", F.array(*weights).alias("weights"))

    def ranked(self, asked: DataFrame, query: str, title_weight: float = TITLE_WEIGHT, most: int | None = None) -> DataFrame:
        """Many queries at once: ``(query, key, score, held, of, place)`` of every document that
        holds any word of a query, for ``asked`` rows ``(query, term)`` of plain words.

        Queries meet postings by bucket and word, each word's documents are counted once,
        and ``place`` is by the score, rounded to nine places, and then the key.  Scores of
        words are dealt by document before they are dealt to the queries, so a document that
        many queries find is shuffled once a word.  With ``most`` only the best ``most`` of a
        query and the best ``most`` that hold all its words are kept; places up to ``most`` are as without.
        """
        own = materialize(asked.select(query, "term").where(F.col("term").isNotNull()).distinct(), "asked")
        sized = own.groupBy(query).agg(F.count("*").alias("of"))
        words = own.select("term", bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct()
        met = self._living(self.postings().join(words, ["bucket", "term"], "left_semi"))
        seen = materialize(met.groupBy("term").agg(F.count("*").alias("seen")), "seen")  # one row a word that is asked for
        f = F.size("at") + title_weight * F.size("head")
        idf = F.log((F.col("n") - F.col("seen") + 0.5) / (F.col("seen") + 0.5))
        norm = K1 * (1 - B + B * F.col("size") / F.col("mean_size"))
        part = F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("f") * (K1 + 1) / (F.col("f") + norm)
        counted = met.select("term", "key", "size", f.alias("f"))  # no places beyond here
        weighed = counted.join(seen, "term").crossJoin(F.broadcast(self.statistics())).select("term", "key", part.alias("part"))  # one row
        scored = weighed.repartition("key").join(own, "term").groupBy(query, "key").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("held"))
        found, order = scored.join(sized, query), (F.desc("score"), "key")
        if most is not None:
            near = F.row_number().over(W.partitionBy(query, "full").orderBy(*order))
            found = found.withColumn("full", F.col("held") == F.col("of")).withColumn("near", near).where(F.col("near") <= most)
        return found.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*order))).select(query, "key", "score", "held", "of", "place")

    def corpus(self, found: DataFrame, terms: int) -> DataFrame:
        """``found`` beside the corpus: one row ``(n, mean_size, frequencies)``."""
        seen = found.agg(F.array(*(F.count_if(F.col("weights")[i] > 0) for i in range(terms))).alias("frequencies"))
        return self.statistics().crossJoin(F.broadcast(seen))  # one row and one row


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out
