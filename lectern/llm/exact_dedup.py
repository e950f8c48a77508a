"""Exact deduplication by progressive refinement.

Three levels, each over what the last one left: texts whose length is unique are done;
of the rest, texts whose (length, prefix hash) is unique are done; only of the rest the
whole text is digested.  The sets of surviving keys travel as sieves of fixed size (see
``sieve``), so no level shuffles texts, and groups are formed over digests with partial
aggregation, so a text that a third of all rows hold costs one row per task.  A row that
an earlier level showed to be unique never enters the grouping; ``digest_all`` only adds
its digest to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import sieve
from lectern.storage import materialize

PREFIX_CHARS = 64
LARGE, SALTS = 1_000, 64  # copies from which a group's rows are dealt, and over how many keys


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def surviving_prefixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Levels one and two: the ``(length, prefix)`` keys that more than one row holds."""
    body = docs.select(_body(text).alias("body")).withColumn("length", F.octet_length("body"))
    shared = body.groupBy("length").count().where("count > 1")
    level1 = sieve.mark(body, sieve.build(shared, F.col("length")), F.col("length"), "maybe").where("maybe")
    prefix = F.xxhash64(F.substring("body", 1, PREFIX_CHARS)).alias("prefix")
    return level1.groupBy("length", prefix).count().where("count > 1").select("length", "prefix")


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their group, if any.  Digests that the sieve of large groups marks are
    dealt over ``SALTS`` keys, so the copies of one text are no one task's work."""
    crowd, key = sieve.build(groups.where(F.col("group_size") > LARGE), F.col("text_sha256")), F.col("text_sha256")
    rows, groups = sieve.mark(rows, crowd, key, "crowded"), sieve.mark(groups, crowd, key, "crowded")
    few = rows.where("not crowded").drop("crowded").join(groups.where("not crowded").drop("crowded"), "text_sha256", "left")
    salt = F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int")
    every = groups.where("crowded").drop("crowded").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = rows.where("crowded").drop("crowded").withColumn("salt", salt).join(every, ["text_sha256", "salt"], "left").drop("salt")
    return few.unionByName(many)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays.  ``text_sha256`` is null for
    texts that an earlier level showed to be unique, unless ``digest_all`` asks for it.

    Null texts count as empty, and empty texts are equal to each other.  A null id ranks
    below all others.  Of rows that agree in id and text, one is kept.  Other columns are
    not read, whatever their names.  An empty table gives no rows.
    """
    survivors = materialize(
        sieve.build(surviving_prefixes(docs, text), F.struct("length", "prefix")), "prefixes"
    )
    body = docs.select(F.col(doc_id).alias("doc_id"), _body(text).alias("body"))
    key = F.struct(F.octet_length("body").alias("length"), F.xxhash64(F.substring("body", 1, PREFIX_CHARS)).alias("prefix"))
    marked = sieve.mark(body, survivors, key, "maybe")
    rows = materialize(
        marked.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row_no"),
            "maybe",
            F.when(F.lit(True) if digest_all else F.col("maybe"), F.sha2("body", 256)).alias("text_sha256"),
        ),
        "digests",
    )
    groups = materialize(
        rows.where("maybe")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "groups",
    )
    nobody = F.lit(None).cast(groups.schema["keep"].dataType).alias("keep"), F.lit(None).cast("long").alias("group_size")
    alone = rows.where("not maybe").select("text_sha256", "doc_id", "row_no", *nobody)
    joined = alone.unionByName(_named(rows.where("maybe"), groups).select(*alone.columns))
    return joined.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row_no") == F.col("row_no"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops; all columns stay.

    Rows that agree in id and text with the one that stays are reduced to one.
    """
    found = exact_duplicates(docs, doc_id, text)
    gone = found.where("not kept").select("doc_id", "text_sha256").distinct().alias("g")
    keep = found.where("kept and group_size > 1").select("doc_id", "text_sha256").alias("k")
    same = F.col("g.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("g.text_sha256") == F.col("k.text_sha256"))
    twice = materialize(gone.join(keep, same, "left_semi"), "twice")  # keys of repeated rows
    digest = F.sha2(_body(text), 256)
    rest = sieve.without(docs, gone, {"doc_id": F.col(doc_id), "text_sha256": digest})
    if twice.isEmpty():
        return rest
    again = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("id"), digest.alias("sha"))
    once = again.join(twice, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return rest.unionByName(once.dropDuplicates(["id", "sha"]).select("whole.*"))
