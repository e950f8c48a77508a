"""Queries of upkeep, names and predicates over the tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import names, predicates
from lectern.operators import retrieval, upkeep
from lectern.plans.tables import table


def batch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of lines: one line of more than 48 refuses its order, so do over six lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    problem = F.when(F.col("l_quantity") > 48, "invalid_question")
    found = upkeep.gate_batches(rows, "l_orderkey", problem, F.lit(1), most=6)
    return found.select("l_orderkey", "l_linenumber", "error")


def assisted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events other than views, by whether the user's event before was a view."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = upkeep.assisted(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")
    return found.select("event_id", "assisted")


def plan_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and lines that are left when the customers of five nations go."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "c_custkey"), "l_orderkey")
    left = upkeep.without_plans(customers.where("c_nationkey < 5"), "c_custkey", customers, orders, lines)
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("kind"), "rows") for n, t in zip(("plans", "questions", "attempts"), left, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stamp_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of two kinds, some of them of texts that have changed or gone since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old, new = F.md5("text"), F.sha2("text", 256)
    stamp = F.when(F.col("doc_id") % 3 == 0, new).when(F.col("doc_id") % 3 == 1, old).otherwise(F.md5(F.lit("other")))
    saved = docs.select("doc_id", stamp.alias("stamp"))
    found = upkeep.restamped(saved, docs.where("doc_id % 7 <> 0"), "doc_id", old, new)
    return found.select("doc_id", "stamp", "state")


def description_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as saved descriptions, and longer ones written later for some of them."""
    parts = table(spark, sf_dir, "part")
    saved = parts.select("p_partkey", F.col("p_name").alias("note"), F.lit(1).alias("at"))
    longer = F.concat(F.lit("  "), F.concat_ws(", ", "p_name", "p_brand", "p_type"))
    written = parts.where("p_partkey % 2 = 0").select("p_partkey", longer.alias("note"), F.lit(2).alias("at"))
    found = upkeep.save_descriptions(saved, written, "p_partkey", "note", "at")
    return found.select("p_partkey", "note", "at")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and purchases of each type, and over all types."""
    metrics = {"events": F.lit(1), "large": (F.col("value") > 100).cast("int")}
    return upkeep.run_statistics(table(spark, sf_dir, "events"), "event_type", metrics)


def people_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits, some of kinds that only a program reads, with their first line as snippet."""
    kind = F.when(F.col("doc_id") % 5 == 0, "calendar").when(F.col("doc_id") % 5 == 1, "grades").otherwise("page")
    snippet = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Original file: "), "source")).otherwise(F.substring("text", 1, 20))
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), snippet.alias("snippet"))
    return predicates.for_people(rows, "kind", "snippet").select("doc_id", "kind", predicates.bucket(F.col("kind")).alias("bucket"))


def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts as file names, some with an extension or the name of a device, as clean text, on
    one line, and a page's ninth."""
    text = F.coalesce("text", F.lit(""))
    title = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("con."), text)).when(F.col("doc_id") % 9 < 5, F.concat(F.lit("a/b: "), text, F.lit(".pdf"))).otherwise(text)
    x, y = F.col("doc_id") % 10 / 10, F.col("doc_id") % 7 / 7
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.safe_name(title).alias("name"), F.sha2(names.clean_text(F.concat(text, F.lit("\n # e\ufb03-\nx  \n\n\n \nend"))), 256).alias("clean"),
        F.sha2(names.inline(text), 256).alias("line"), names.region(x, y).alias("region"),
    )


def hit_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits for two words, held against texts of which the French have changed and the Spanish have gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    terms = ["the", "idiot"]
    held = lambda t: F.regexp_like(F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.lit(f" {t} "))
    hits = docs.where(held("the") | held("idiot")).select("doc_id", F.sha2("text", 256).alias("digest"), (held("the") & held("idiot")).alias("complete"))
    now = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the "), F.regexp_replace("text", "(?i)idiot", "person"))).otherwise(F.col("text"))
    current = docs.where("lang is null or lang <> 'es'").select("doc_id", now.alias("text"))
    return retrieval.recheck(hits, current, "doc_id", terms).select("doc_id", "complete")


def reply_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers reached from the first by parts that they share, with the round; to the fixed point."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    to_part = lines.select(F.concat(F.lit("s"), "s").alias("a"), F.concat(F.lit("p"), "p").alias("b"))
    both = to_part.unionByName(to_part.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return upkeep.reached(both, spark.createDataFrame([("s1",)], "node string"))


QUERIES = {
    f.__name__: f
    for f in (
        batch_gate, assisted_attempts, plan_cascade, stamp_upgrade, description_upsert, run_counts, people_hits, plain_names, hit_recheck, reply_closure,
    )
}
ORACLES = {
    "batch_gate": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 48 THEN 'invalid_question' WHEN count(*) OVER o > 6 THEN 'batch_too_large'
       WHEN max(l_quantity) OVER o > 48 THEN 'batch_refused' END AS error FROM lineitem WINDOW o AS (PARTITION BY l_orderkey)""",
    "assisted_attempts": """
SELECT event_id, coalesce(seen, false) AS assisted FROM (
    SELECT event_id, event_type, lag(event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events)
WHERE event_type IS DISTINCT FROM 'view'""",
    "plan_cascade": """
WITH kept AS (SELECT c_custkey FROM customer WHERE NOT coalesce(c_nationkey < 5, false)),
kept_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5))
SELECT 'plans' AS kind, count(*) AS rows FROM kept UNION ALL SELECT 'questions', count(*) FROM kept_orders
UNION ALL SELECT 'attempts', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept_orders)""",
    "stamp_upgrade": """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 < 2 THEN sha256(coalesce(text, '')) WHEN doc_id % 3 = 0 THEN sha256(coalesce(text, ''))
                    WHEN doc_id % 3 = 1 THEN md5(coalesce(text, '')) ELSE md5('other') END AS stamp,
       CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'current' WHEN doc_id % 3 = 1 THEN 'upgraded' ELSE 'changed' END AS state
FROM documents""",
    "description_upsert": """
WITH written AS (SELECT p_partkey, concat_ws(', ', p_name, p_brand, p_type) AS note FROM part WHERE p_partkey % 2 = 0)
SELECT part.p_partkey, coalesce(note, p_name) AS note, CASE WHEN note IS NULL THEN 1 ELSE 2 END AS at
FROM part LEFT JOIN written ON part.p_partkey = written.p_partkey AND length(note) BETWEEN 20 AND 2500""",
    "run_counts": """
WITH s AS (SELECT event_type, grouping(event_type) = 1 AS overall, count(*)::DOUBLE AS events, sum((value > 100)::INT)::DOUBLE AS large
           FROM events GROUP BY ROLLUP (event_type))
SELECT event_type, overall, 'events' AS metric, events AS value FROM s UNION ALL SELECT event_type, overall, 'large', large FROM s""",
    "people_hits": "SELECT doc_id, 'page' AS kind, 'page' AS bucket FROM documents WHERE doc_id % 5 > 1 AND doc_id % 4 <> 0",
    "plain_names": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'con.' || t WHEN doc_id % 9 < 5 THEN 'a/b: ' || t || '.pdf' ELSE t END AS title FROM d),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g') AS bare FROM n),
w AS (SELECT *, CASE WHEN bare = '' THEN 'untitled' WHEN upper(split_part(bare, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN '_' || bare ELSE bare END AS whole FROM b),
e AS (SELECT *, regexp_extract(whole, '^.+(\.[^.]{1,8})$', 1) AS ending FROM w),
s AS (SELECT *, substr(whole, 1, length(whole) - length(ending)) AS stem FROM e),
k AS (SELECT *, list_max(list_filter(range(0, 111), lambda k: k <= least(length(stem), 110 - length(ending)) AND strlen(substr(stem, 1, k)) <= 200 - strlen(ending))) AS size FROM s)
SELECT doc_id, CASE WHEN length(whole) > 110 OR strlen(whole) > 200 THEN regexp_replace(substr(stem, 1, size), '[. ]+$', '') || ending ELSE whole END AS name,
       sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t || chr(10) || ' # effi' || 'x  ' || chr(10) || chr(10) || 'end', '([\pL\pN_\pM])-\n([a-z])', '\1\2', 'g'),
           '[\t\f\r \x{a0}]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(^|\n)([\t \x{a0}]*)#', '\1\2\\#', 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS clean,
       sha256(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS line,
       ['top', 'middle', 'bottom'][least(floor((doc_id % 7) / 7.0 * 3), 2)::INT + 1] || ' ' || ['left', 'centre', 'right'][least(floor((doc_id % 10) / 10.0 * 3), 2)::INT + 1] AS region
FROM k""",
    "hit_recheck": r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 3 = 0 THEN 'the ' || regexp_replace(text, 'idiot', 'person', 'gi') ELSE text END AS now FROM d),
c AS (SELECT doc_id, lang, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS t, ' ' || regexp_replace(lower(now), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS n FROM w)
SELECT doc_id, contains(n, ' the ') AND contains(n, ' idiot ') AS complete FROM c
WHERE (lang IS NULL OR lang <> 'es') AND (contains(t, ' the ') OR contains(t, ' idiot ')) AND (contains(n, ' the ') OR contains(n, ' idiot '))""",
    "reply_closure": """
WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem),
both_ways AS (SELECT s AS a, p AS b FROM e UNION ALL SELECT p, s FROM e),
walk(node, round) AS (SELECT 's1', 0 UNION SELECT b, round + 1 FROM walk JOIN both_ways ON a = node WHERE round < 12)
SELECT node, min(round) AS round FROM walk GROUP BY node""",
}
