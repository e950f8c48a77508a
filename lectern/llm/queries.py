"""The operators applied to the tables, with production parameters, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    chunks,
    exact_dedup,
    language,
    line_runs,
    mixing,
    packing,
    periodic_runs,
    permutation_index,
    simhash,
    toxicity,
    training_order,
    warc,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_along_curve(_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True)


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = permutation_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("rank", F.col("rank").cast("int"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    records = warc.round_trip(pages).where("kind = 'record'")
    kind = pages.schema["page_id"].dataType.simpleString()
    revisit, named = F.col("warc_type") == "revisit", F.regexp_extract("payload_digest", "sha256:(.*)", 1)
    return records.select(
        warc.page_of("record_id", kind).alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, named).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_of("refers_to", kind).alias("refers_to"),
    )


OP5_SQL = """
WITH page AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), known AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
           min(page_id) OVER (PARTITION BY html) AS first_id
    FROM page
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM known
"""


def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pieces`` names, for each run of words taken, its shard and its rank there."""
    plan = mixing.mixing_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"), "pieces")


def _remainder(column: str, of: int) -> Column:
    """crc32 of a column as text, modulo ``of``; null is the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _remainder("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.identify(spark, model, F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its slot in the training order, and the shard and
    the checksum of the slot's record as read back from the shard."""
    manifest, index = training_order.materialise_order(_table(spark, sf_dir, "documents"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(memoryview(ids.as_buffer())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], ["slot", "record_crc32"])

    # the planner sees the manifest's few rows, not what the shards hold: never broadcast that
    read = training_order.read_shards(manifest).mapInArrow(sums, "slot long, record_crc32 long")
    rows = index.join(read.hint("merge"), "slot").select("slot", "record_crc32", F.posexplode("pieces").alias("place", "piece"))
    shard = F.floor(F.col("slot") / training_order.SHARD).alias("shard")
    return rows.select("slot", shard, "place", "piece.*", "record_crc32")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = _remainder("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(spark, model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def planted(text: Column, key: Column) -> Column:
    """``text``, or for one key in ten its words with a periodic tail, as crc32 of the key says."""
    words = F.regexp_extract_all(text, F.lit(periodic_runs.WORD), F.lit(0))
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = (F.ceil((n - a) / p)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), periodic).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = periodic_runs.periodic_runs(docs.select("doc_id", planted(text, F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    rows = found.select("doc.doc_id", "runs", "collapsed", longest.alias("x"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("x.col2")).alias("start"),
        F.col("x.length").alias("length"),
        (-F.col("x.col3")).alias("period"),
        F.expr("1000 * x.length div -x.col3").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_runs.drop_frequent_lines(line_runs.deliveries(docs))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH doc AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS MATERIALIZED (
    SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM doc
), keyed AS MATERIALIZED (
    SELECT row_no, doc_id, line, place,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM line
), frequent AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_no) >= 10
), told AS (
    SELECT keyed.*, frequent.key IS NOT NULL AS dropped FROM keyed LEFT JOIN frequent ON keyed.key = frequent.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM told GROUP BY row_no
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_packing, op2_chunk_dedup, op3_exact_dedup, op4_permutation_index, op5_warc_salvage,
        op6_simhash_ball, op7_source_mixing, op8_language_id, op9_training_order, op10_toxicity,
        op11_periodic_runs, op12_line_runs, op13_whitening,
    )
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op5_warc_salvage": OP5_SQL, "op12_line_runs": OP12_SQL}
