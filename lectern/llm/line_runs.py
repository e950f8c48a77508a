"""Line deduplication over levelled, sorted runs of line hashes; DataFrame functions only.

A run is a table of 128-bit line hashes, bucketed and sorted by the hash, so runs and
batches meet in merge joins without a shuffle of what is stored.  It has two parts:

* the *settled* one holds lines that were found to be in ``at_least`` documents;
* the *open* one holds, for other lines, the number of documents of one batch (or of
  several, once compacted).

Each new batch counts its lines (partial counts before the only shuffle), is anti-joined
with the settled parts, adds what the open parts know, and leaves one new run.  When a
level has ``fanout`` runs they are merged into one of the next level, so a batch meets a
number of runs that grows with the logarithm of the batches before it.

What is dropped is decided by exact joins; a sieve of fixed size only spares the lines and
texts that surely lose nothing.  A text is named by 128 bits of its own, never by a row
number, so a recomputed task gives the same rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import sieve
from lectern.storage import fresh_path, materialize

AT_LEAST = 10  # documents that hold a line for it to be dropped
FANOUT = 3  # runs of a level before they are merged
BATCHES = 4  # groups of files that the query takes as deliveries
BLANKS = " \t\n\x0b\f\r"
LARGE, SALTS = 1_000, 64  # documents from which a line's rows are dealt, and over how many keys
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]
TEXT = ["t1", "t2"]


def body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def line_keys(text: Column) -> Column:
    """The key of each line: stripped of blanks at both ends, A-Z in lower case."""

    def key(line: Column) -> Column:
        plain = F.octet_length(line) == F.char_length(line)  # where other letters cannot change, the quicker way
        return F.trim(F.when(plain, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER)), F.lit(BLANKS))

    return F.transform(F.split(text, "\n", -1), key)


def named(value: Column, names: list[str]) -> list[Column]:
    """128 bits of ``value`` as two longs."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


class LineRuns:
    """The lines of all batches so far, as levelled runs in the session's catalog.

    The files lie in the shared folder.  ``buckets`` is how many parts a run has; by
    default the session's shuffle partitions, so that a batch comes out of its shuffle
    parted as the runs are.
    """

    def __init__(self, spark: SparkSession, at_least: int = AT_LEAST, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.at_least, self.fanout = spark, at_least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]  # names of runs by level
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, name)
        parted = rows.select(*KEY, "n", "settled").repartition(self.buckets, *KEY)  # as they are: no shuffle
        out = parted.write.partitionBy("settled").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        out.option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        self.levels[level].append(name)

    def _runs(self, settled: bool) -> list[DataFrame]:
        return [self.spark.table(n).where(F.col("settled") == settled).select(*KEY, "n") for level in self.levels for n in level]

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """``rows`` merge-anti-joined with the settled part of every run."""
        return reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), self._runs(True), rows)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Take a batch of documents; each row is one document.

        Null and empty texts have one empty line, and empty keys are never counted; a
        line counts once a document; an empty batch changes nothing.
        """
        lines = docs.select(F.explode(F.array_distinct(line_keys(body(text)))).alias("line")).where("line <> ''")
        left = self.unsettled(lines.groupBy(*named(F.col("line"), KEY)).agg(F.count("*").alias("n")))
        total = F.col("n")
        for at, run in enumerate(self._runs(False)):
            left = left.join(run.withColumnRenamed("n", f"n{at}").hint("merge"), KEY, "left")
            total += F.coalesce(F.col(f"n{at}"), F.lit(0))
        settled = total >= self.at_least
        self._write(left.select(*KEY, F.when(settled, total).otherwise(F.col("n")).alias("n"), settled.alias("settled")), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._merge(level)

    def _merge(self, level: int) -> None:
        """The runs of a full level become one of the next; its open part loses settled lines."""
        files = self.spark.read.schema("k1 long, k2 long, n long, settled boolean")
        rows = reduce(DataFrame.unionByName, [files.parquet(self.paths[name]) for name in self.levels[level]])
        summed = rows.groupBy(*KEY).agg(F.max(F.when(F.col("settled"), F.col("n"))).alias("of_settled"), F.sum("n").alias("of_open"))
        settled = F.col("of_settled").isNotNull()
        merged = summed.select(*KEY, F.coalesce("of_settled", "of_open").alias("n"), settled.alias("settled"))
        old, self.levels[level] = self.levels[level], []
        left = self.unsettled(merged)  # of the other levels
        if level + 1 == len(self.levels):
            self.levels.append([])
        self._write(left, level + 1)
        for name in old:
            self._forget(name)

    def _forget(self, name: str) -> None:
        """Drop a run, with its files."""
        self.spark.sql(f"DROP TABLE {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def frequent(self) -> DataFrame:
        """``(k1, k2, n)`` of the settled lines, each once; ``n`` is as of their settling."""
        none = self.spark.range(0).select(F.col("id").alias("k1"), F.col("id").alias("k2"), F.col("id").alias("n"))
        return reduce(DataFrame.unionByName, self._runs(True), none)

    def close(self) -> None:
        """Drop all runs."""
        for level in self.levels:
            while level:
                self._forget(level.pop())


def _matched(rows: DataFrame, side: DataFrame, key: list[str], crowd: DataFrame, salt: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``side`` by ``key``; keys that the sieve of ``crowd`` marks are
    dealt over ``SALTS`` keys by the hash of ``salt``, so no key is one task's work."""
    held = sieve.build(crowd, F.struct(*key))
    rows, side = (sieve.mark(x, held, F.struct(*key), "crowded") for x in (rows, side))
    dealt = F.when(F.col("crowded"), F.pmod(F.xxhash64(*salt), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("salt", dealt).drop("crowded")
    right = side.withColumn("salt", F.explode(every)).drop("crowded")
    return left.join(right.hint("merge"), [*key, "salt"], how).drop("salt")


def without_lines(docs: DataFrame, frequent: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as one struct ``doc``, with long ``n_lines``, ``n_dropped`` and string ``kept``.

    ``frequent`` holds ``(k1, k2, n)`` of the lines to drop.  Null texts are empty, and an
    empty text is one empty line, which stays.  Repeated rows, ties and null ids change
    nothing; an empty table gives no rows; other columns stay inside ``doc``, whatever
    their names.
    """
    whole = docs.select(F.struct("*").alias("doc"), body(text).alias("body"))
    lines = whole.select(*named(F.col("body"), TEXT), F.posexplode(line_keys(F.col("body"))).alias("at", "line")).where("line <> ''")
    hashed = lines.select(*TEXT, "at", *named(F.col("line"), KEY))
    maybe = sieve.mark(hashed, sieve.build(frequent, F.struct(*KEY)), F.struct(*KEY), "maybe").where("maybe").drop("maybe")
    # copies of a text say the same: one row a text and line goes on
    once = maybe.groupBy(*TEXT, "at", *KEY).agg(F.count("*").alias("copies"))
    gone = _matched(once, frequent.select(*KEY), KEY, frequent.where(F.col("n") > LARGE), [*TEXT, "at"], "inner")
    places = materialize(gone.groupBy(*TEXT).agg(F.collect_set("at").alias("gone"), F.max("copies").alias("copies")), "dropped_lines")
    texts = whole.select("doc", "body", *named(F.col("body"), TEXT))
    marked = sieve.mark(texts, sieve.build(places, F.struct(*TEXT)), F.struct(*TEXT), "maybe")
    intact = marked.where("not maybe").select("doc", "body", F.lit(None).cast("array<int>").alias("gone"))
    crowd = places.where(F.col("copies") > LARGE)
    cut = _matched(marked.where("maybe").drop("maybe"), places.drop("copies"), TEXT, crowd, ["doc"], "left")
    rows = intact.unionByName(cut.select("doc", "body", "gone"))
    split = F.split("body", "\n", -1)
    left = F.filter(split, lambda line, at: ~F.array_contains(F.col("gone"), at))
    return rows.select(
        "doc",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(left, "\n")).alias("kept"),
    )


def deliveries(docs: DataFrame, most: int = BATCHES) -> list[DataFrame]:
    """A stored table as at most ``most`` batches, each a group of its files, read once."""
    files = sorted(docs.inputFiles())
    groups = [files[at::most] for at in range(min(most, len(files)))]
    return [docs.sparkSession.read.schema(docs.schema).parquet(*group) for group in groups]


def drop_frequent_lines(batches: list[DataFrame], text: str = "text", at_least: int = AT_LEAST) -> DataFrame:
    """All ``batches`` without the lines that ``at_least`` of their documents hold, as
    ``without_lines`` gives them."""
    spark = batches[0].sparkSession
    runs = LineRuns(spark, at_least)
    for batch in batches:
        runs.add(batch, text)
    frequent = materialize(runs.frequent(), "frequent_lines")
    runs.close()
    return without_lines(reduce(DataFrame.unionByName, batches), frequent, text)
