"""Coverage, scope, calendar, grade and change queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import percent
from lectern.operators import changes, coverage
from lectern.plans.tables import table

NOW = "2000-06-15 00:00:00"
POSSIBLE = 50.0  # points of an item


def missed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers below an order's largest that no line has."""
    gaps = coverage.gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return gaps.select("l_orderkey", F.explode(F.sequence("first", "last")).alias("l_linenumber"))


def unit_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = coverage.gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return coverage.worded(runs, ["l_orderkey"])


def coverage_progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order, by region and nation, with totals."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    rows = (
        table(spark, sf_dir, "customer").join(ordered, "c_custkey", "left")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", "n_name", F.coalesce("has", F.lit(False)).alias("has"))
    )
    return coverage.progress(rows, ["r_name", "n_name"], "has")


def uncited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def citation_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose lines cite a part in scope."""
    scope = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("inside"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(scope, "l_partkey", "left")
    found = lines.groupBy("l_orderkey").agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("ok"), F.count("*").alias("citations"))
    return found.where("ok").select("l_orderkey", "citations")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as of two days; pending ones have a new price in the second."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    old = orders.where("o_orderdate < timestamp_ntz'2001-01-01 00:00:00'").select("o_orderkey", changes.stamp("o_orderstatus", "o_totalprice").alias("stamp"))
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = orders.where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'").withColumn("o_totalprice", price)
    return old, new.select("o_orderkey", changes.stamp("o_orderstatus", "o_totalprice").alias("stamp"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_diff(*_snapshots(spark, sf_dir), "o_orderkey", "stamp")


def scope_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot_diff(spark, sf_dir)
    return found.where("change <> 'unchanged'").groupBy("change").agg(F.count("*").alias("sources"))


def mark_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as items, those with orders since 2000 as seen, listings by segment."""
    items = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("removed"))
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'2000-01-01 00:00:00'")
    listings = items.select("c_mktsegment", (F.col("c_mktsegment") != "MACHINERY").alias("complete")).distinct()
    swept = changes.mark_and_sweep(items, recent.select(F.col("o_custkey").alias("c_custkey")), listings, "c_custkey", "c_mktsegment")
    return swept.select("c_custkey", "state")


def selection_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier for each customer: of its nation, else of its region, else any."""
    nations = table(spark, sf_dir, "nation")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    usable = suppliers.where("s_acctbal > 5000")
    by_nation = usable.groupBy(F.col("n_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("near"))
    by_region = usable.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("far"))
    anyone = usable.agg(F.min("s_suppkey").alias("other"))
    customers = table(spark, sf_dir, "customer").join(nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    chosen = customers.join(by_nation, "c_nationkey", "left").join(by_region, "n_regionkey", "left").crossJoin(F.broadcast(anyone))
    return chosen.select("c_custkey", F.coalesce("near", "far", "other").alias("s_suppkey"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, events = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    done = orders.where("o_orderstatus = 'F'")
    open_lines = lines.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return (
        orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due"))
        .unionByName(open_lines.select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("due")))
        .unionByName(events.where("event_type = 'signup'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("due")))
    )


def calendar_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dated items by kind and month; lines of finished orders are left out."""
    month = F.date_format("due", "yyyy-MM").alias("month")
    return _dated(spark, sf_dir).groupBy("kind", month).agg(F.count("*").alias("items"), F.sum("id").alias("ids"))


def calendar_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dated(spark, sf_dir).where(F.col("due") >= F.lit(NOW).cast("timestamp_ntz"))
    top = rows.orderBy("due", "kind", "id").limit(50)
    return top.select("kind", "id", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


def grade_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per part type; returned lines are excused, empty types show zeros."""
    parts = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    sums = lines.groupBy("p_type").agg(F.sum("l_quantity").alias("score"), F.count("*").alias("n"))
    every = parts.select("p_type").distinct().join(sums, "p_type", "left")
    score, n = F.coalesce("score", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return every.select("p_type", score.alias("score"), n.alias("n"), percent(score, n * POSSIBLE).alias("percent"))


def weak_items_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("n"))
    ratio = F.round(F.col("s") / (F.col("n") * POSSIBLE), 6).alias("ratio")
    return lines.select("l_partkey", ratio).where("ratio < 0.9").orderBy("ratio", "l_partkey").limit(15)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(status == "F").alias("done"), F.count_if(status == "O").alias("waiting"),
        F.count_if(status == "P").alias("pending"), F.count("*").alias("total"),
    )


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "kind")


def next_due_per_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next order of each nation's customers after now."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(NOW).cast("timestamp_ntz"))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    order = F.struct("o_orderdate", "o_orderkey")
    return rows.groupBy("c_nationkey").agg(F.min(order).alias("first")).select(
        "c_nationkey", F.col("first.o_orderkey").alias("o_orderkey"), F.date_format("first.o_orderdate", "yyyy-MM-dd").alias("due")
    )


def placement_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each part is placed: its cheapest line, then the first order and line."""
    order = F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(order).alias("m")).select("l_partkey", "m.l_orderkey", "m.l_linenumber", "m.l_suppkey")


def shortest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand the part with the shortest name, ties to the smaller key."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min(F.struct(F.length("p_name").alias("n"), "p_partkey", "p_name")).alias("m")
    ).select("p_brand", F.col("m.p_partkey").alias("p_partkey"), F.col("m.p_name").alias("p_name"))


def cited_and_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INTERSECT and EXCEPT of cited and offered parts, counted."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    offered = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"))
    both = cited.intersect(offered).agg(F.count("*").alias("n")).select(F.lit("cited and offered").alias("what"), "n")
    only = offered.exceptAll(cited.distinct()).agg(F.count("*").alias("n")).select(F.lit("offered only").alias("what"), "n")
    return both.unionByName(only)


def upcoming_and_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first, undated last: each customer's last order, customers without at the end."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    nth = F.row_number().over(W.partitionBy(F.col("last").isNull()).orderBy(F.desc_nulls_last("last"), "c_custkey"))
    return rows.withColumn("nth", nth).where("nth <= 100").select("c_custkey", F.date_format("last", "yyyy-MM-dd").alias("last"), "nth")


QUERIES = {
    f.__name__: f
    for f in (
        missed_units, unit_islands, coverage_progress_rollup, uncited_sources, citation_in_scope, snapshot_diff,
        scope_changes, mark_sweep, selection_priority_join, calendar_union, calendar_upcoming, grade_by_category,
        weak_items_top15, status_counts, kind_counts, next_due_per_course, placement_argmin, shortest_match,
        cited_and_available, upcoming_and_late,
    )
}

_MISSED = """missed AS (
  SELECT l_orderkey, n::INT AS l_linenumber
  FROM (SELECT l_orderkey, unnest(generate_series(1, max(l_linenumber))) AS n FROM lineitem GROUP BY l_orderkey)
  EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem)"""
_DIFF = """diff AS (
  SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
         CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete'
              WHEN o.o_orderstatus = 'P' THEN 'update' ELSE 'unchanged' END AS change
  FROM (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01') o
  FULL JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') n ON o.o_orderkey = n.o_orderkey)"""
_DATED = """dated AS (
  SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS due FROM orders
  UNION ALL SELECT 'line', l_orderkey, l_shipdate FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
  UNION ALL SELECT 'event', event_id, ts FROM events WHERE event_type = 'signup')"""

ORACLES = {
    "missed_units": f"WITH {_MISSED} SELECT * FROM missed",
    "unit_islands": f"""WITH {_MISSED},
numbered AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM missed),
runs AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM numbered GROUP BY l_orderkey, run)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS units FROM runs GROUP BY l_orderkey""",
    "coverage_progress_rollup": """
WITH r AS (SELECT r_name, n_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, n_name, count(*) AS total, count(*) FILTER (has) AS done, bool_and(has) AS complete FROM r GROUP BY ROLLUP (r_name, n_name)""",
    "uncited_sources": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "citation_in_scope": """
SELECT l_orderkey, count(*) AS citations FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 40
GROUP BY l_orderkey HAVING bool_and(p_partkey IS NOT NULL)""",
    "snapshot_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "scope_changes": f"WITH {_DIFF} SELECT change, count(*) AS sources FROM diff WHERE change <> 'unchanged' GROUP BY change",
    "mark_sweep": """
SELECT c_custkey, CASE WHEN found AND c_acctbal < 0 THEN 'restored' WHEN found THEN 'seen' WHEN c_acctbal < 0 THEN 'removed'
                       WHEN c_mktsegment <> 'MACHINERY' THEN 'removed' ELSE 'kept' END AS state
FROM (SELECT *, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01') AS found FROM customer)""",
    "selection_priority_join": """
WITH s AS (SELECT s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM s WHERE s.n_nationkey = c_nationkey),
                           (SELECT min(s_suppkey) FROM s WHERE s.n_regionkey = n.n_regionkey), (SELECT min(s_suppkey) FROM s)) AS s_suppkey
FROM customer JOIN nation n ON c_nationkey = n.n_nationkey""",
    "calendar_union": f"WITH {_DATED} SELECT kind, strftime(due, '%Y-%m') AS month, count(*) AS items, sum(id)::BIGINT AS ids FROM dated GROUP BY ALL",
    "calendar_upcoming": f"""WITH {_DATED}
SELECT kind, id, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM (SELECT * FROM dated WHERE due >= TIMESTAMP '{NOW}' ORDER BY due, kind, id LIMIT 50)""",
    "grade_by_category": """
SELECT t.p_type, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n, 0) AS n,
       CASE WHEN coalesce(n, 0) > 0 THEN round(score * 100.0 / (n * 50.0), 1) END::DOUBLE AS percent
FROM (SELECT DISTINCT p_type FROM part) t LEFT JOIN (
  SELECT p_type, sum(l_quantity) AS score, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY p_type) g
ON t.p_type = g.p_type""",
    "weak_items_top15": """
SELECT l_partkey, ratio FROM (SELECT l_partkey, round(sum(l_quantity) / (count(*) * 50.0), 6) AS ratio FROM lineitem GROUP BY l_partkey)
WHERE ratio < 0.9 ORDER BY ratio, l_partkey LIMIT 15""",
    "status_counts": """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS waiting,
       count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) AS total FROM orders GROUP BY o_orderpriority""",
    "kind_counts": "SELECT lang AS kind, count(*) AS documents FROM documents GROUP BY lang",
    "next_due_per_course": f"""
SELECT c_nationkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS due FROM (
  SELECT c_nationkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS nth
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '{NOW}') WHERE nth = 1""",
    "placement_argmin": """
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS nth FROM lineitem) WHERE nth = 1""",
    "shortest_match": """
SELECT p_brand, p_partkey, p_name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_partkey) AS nth FROM part) WHERE nth = 1""",
    "cited_and_available": """
SELECT 'cited and offered' AS what, count(*) AS n FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 10)
UNION ALL SELECT 'offered only', count(*) FROM (SELECT p_partkey FROM part WHERE p_size > 10 EXCEPT SELECT l_partkey FROM lineitem)""",
    "upcoming_and_late": """
SELECT c_custkey, strftime(last, '%Y-%m-%d') AS last, nth::INT AS nth FROM (
  SELECT c_custkey, last, row_number() OVER (PARTITION BY last IS NULL ORDER BY last DESC NULLS LAST, c_custkey) AS nth
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey) WHERE nth <= 100""",
}
