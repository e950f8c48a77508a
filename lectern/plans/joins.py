"""Record joins over the tables: as-of, scope, aliases, retries, priorities, and the SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import predicates, text
from lectern.operators import practice, records
from lectern.plans.tables import table

PICKED = [42, 7, 42, 300, 1]


def as_of_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's newest signup before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    joined_up = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup"))
    return records.as_of(bought, joined_up, "user_id", "ts", "since").select("event_id", F.col("version.signup").alias("signup"))


def retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' errors since their last purchase, each month a new stamp."""
    rows = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select(
        "user_id", F.date_format("ts", "yyyy-MM").alias("stamp"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok")
    )
    return records.retry_budget(rows, "user_id")


def scope_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in scope: delivered by a selected supplier, or by none at all."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("path")).distinct()
    selected = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("module"))
    found = records.in_scope(links, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")), selected)
    return found.select(F.col("path").alias("p_partkey"), F.coalesce(F.size("modules"), F.lit(0)).cast("int").alias("modules"), "in_scope")


def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and day as one record: the dearest names it, the rest are aliases."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.concat_ws("/", "o_custkey", F.date_format("o_orderdate", "yyyy-MM")).alias("entry"), F.col("o_orderkey").alias("name"),
        F.array("o_orderpriority").alias("contexts"), "o_totalprice",
    )
    found = records.merge_aliases(rows, "entry", "contexts", -F.col("o_totalprice"))
    return found.select("entry", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("contexts", ",").alias("contexts"))


def record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability of documents: removed source, else record, else current."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("source"), F.lit(None).cast("string").alias("marker"))
    known = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("path"), F.lit("ok").alias("status"), (F.col("quality") == 0).alias("stale"), (F.col("toxic") == 1).alias("locked")
    )
    return records.material_status(docs, known, F.col("source") == "src1").select(F.col("path").alias("doc_id"), "availability")


def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two kinds and two sources, by path, in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", "source", F.lit("all"), F.col("doc_id").cast("string")).alias("path"))
    courses = spark.createDataFrame([("1", "One", "S-1", "src1"), ("2", "Twelve", "S-12", "src12")], "id string, name string, code string, folder string")
    kept = predicates.in_course(docs, predicates.course_folders(courses, "src1")).where(predicates.of_kind(F.col("lang"), "en, fr"))
    return kept.select("doc_id", "lang", "path", text.course_of(F.col("path")).alias("course")).orderBy("path")


def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns by the digest of role and text: the first of equals, and how many."""
    rows = table(spark, sf_dir, "conversations").withColumn("key", practice.dedup_key("role", "text"))
    first = F.min(F.struct("conv_id", "turn"))
    return rows.groupBy("key").agg(first.alias("m"), F.count("*").alias("n")).select("m.conv_id", "m.turn", "n")


def picked_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given customers in the given order, each once, without their balance."""
    return records.detail_view(table(spark, sf_dir, "customer"), "c_custkey", PICKED, ["c_acctbal"])


QUERIES = {
    f.__name__: f
    for f in (as_of_signup, retry_budget, scope_membership, alias_merge, record_status, filtered_documents, question_keys, picked_details)
}
ORACLES = {
    "as_of_signup": """
SELECT p.event_id, s.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "retry_budget": """
WITH r AS (SELECT user_id, strftime(ts, '%Y-%m') AS stamp, ts, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')),
n AS (SELECT r.* FROM r JOIN (SELECT user_id, max_by(stamp, ts) AS newest FROM r GROUP BY user_id) m ON r.user_id = m.user_id AND stamp = newest),
g AS (SELECT user_id, max(ts) AS good FROM n WHERE ok GROUP BY user_id),
c AS (SELECT n.user_id, stamp, count(*) FILTER (NOT ok AND (good IS NULL OR ts > good)) AS misses FROM n LEFT JOIN g ON n.user_id = g.user_id GROUP BY n.user_id, stamp)
SELECT user_id, stamp, misses, misses >= 3 AS give_up FROM c""",
    "scope_membership": """
SELECT p_partkey, count(DISTINCT l_suppkey)::INT AS modules, coalesce(bool_or(s_acctbal > 8000), true) AS in_scope
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey""",
    "alias_merge": """
WITH o AS (SELECT o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS entry, o_orderkey, o_orderpriority,
                  row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders)
SELECT entry, min(o_orderkey) FILTER (nth = 1) AS name, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY nth) FILTER (nth > 1), '') AS aliases,
       array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS contexts FROM o GROUP BY entry""",
    "record_status": """
SELECT d.doc_id, CASE WHEN source = 'src1' THEN 'removed' WHEN toxic = 1 THEN 'restricted' WHEN quality = 0 THEN 'stale' ELSE 'current' END AS availability
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "filtered_documents": """
SELECT doc_id, lang, source || '/all/' || doc_id AS path, source || '/all' AS course FROM documents WHERE source = 'src1' AND lang IN ('en', 'fr')""",
    "question_keys": """
SELECT conv_id, turn, n FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY role, text) AS n,
       row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS nth FROM conversations) WHERE nth = 1""",
    "picked_details": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey IN (42, 7, 300, 1)",
}
