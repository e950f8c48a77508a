"""Queries of records, grids, boxes, visuals and kept listings over the tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import predicates
from lectern.operators import changes, records, study
from lectern.plans.tables import table
from lectern.sources import grids


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, source = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source")
    return table(spark, sf_dir, "documents").select("doc_id", text, source)


def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their text versions and their pictures with the first record that knows them."""
    docs = _documents(spark, sf_dir)
    base, third = F.concat_ws("/", "source", F.concat("doc_id", F.lit(".pdf"))), F.col("doc_id") % 3
    path = F.when(third == 0, base).when(third == 1, F.concat(base, F.lit(".md"))).otherwise(F.concat(base, F.lit(".assets/page/1.png")))
    item = lambda number: docs.select(
        F.col("source").alias("course"), number.alias("item"), number.alias("position"), base.alias("path"), F.concat(base, F.lit(".md")).alias("text")
    )
    items = item(F.col("doc_id")).where("item % 2 = 0").unionByName(item(F.col("doc_id") + 10**9).where("item % 10 < 3"))
    return records.record_items(docs.select(path.alias("path")), items)


def token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two link tokens each, of which those of even documents are known."""
    docs = _documents(spark, sf_dir)
    token = lambda kind, n: F.concat(F.lit(f"[see](canvas-{kind}:"), n.cast("string"), F.lit(")"))
    marked = docs.select("doc_id", F.concat(token("page", F.col("doc_id")), "text", token("file", F.col("doc_id") + 1)).alias("text"))
    known = docs.where("doc_id % 2 = 0").select(
        F.explode(F.array(F.lit("canvas-page"), F.lit("canvas-file"))).alias("kind"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("../"), "source", F.lit(".md")).alias("target")
    )
    return records.resolve_tokens(marked, known, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))


def label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labels and boxes of pages of four: the smallest box that a label is in."""
    parts = table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 4))
    labels = parts.select("page", F.col("p_partkey").alias("label"), (F.col("p_partkey") * 7 % 100).alias("cx"), (F.col("p_size") * 3 % 60).alias("cy"))
    box = {"x": F.col("p_partkey") % 4 * 20, "y": F.col("p_size"), "w": F.lit(24), "h": 20 + F.col("p_partkey") % 3 * 4}
    return records.labels_in_boxes(labels, parts.select("page", F.col("p_partkey").alias("box"), *(v.alias(k) for k, v in box.items())), "page")


def mathy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with formulas below, by whether they are mathematics."""
    more = F.concat("text", F.repeat(F.lit("\nx = 1"), (F.col("doc_id") % 5).cast("int")), F.repeat(F.lit("∑"), (F.col("doc_id") % 7 - 3).cast("int")))
    return _documents(spark, sf_dir).select("doc_id", predicates.is_mathy(more).alias("mathy"))


def visual_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source: visual ones, described ones, and the first to do."""
    fourth, seen = F.col("doc_id") % 4, "\n> Visual content: {}. View it."
    note = F.when(fourth == 0, seen.format("chart or diagram")).when(fourth == 1, seen.format("scanned page") + "\n> **What this shows** a line").when(fourth == 2, seen.format("plain")).otherwise("")
    rows = _documents(spark, sf_dir).select(
        F.col("source").alias("path"), F.col("doc_id").alias("sec_no"), F.format_string("[Page %d] Title", "doc_id").alias("heading"), F.concat("text", note).alias("text")
    )
    found = study.visual_survey(study.units(rows))
    return found.select("path", "total", "described", F.size("todo").alias("listed"), F.get("todo", F.lit(0))["sec_no"].alias("first"))


def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where a course leads to them: labelled ones from the last, then all from the first."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", (-F.col("doc_id")).alias("position"))
    return study.course_walk([labelled, table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("position"))], "doc_id")


def kept_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of priorities whose listing was whole as newly listed, those of the others as they were."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"))
    new = orders.where("o_orderkey % 2 = 0").withColumn("run", F.lit("new"))
    listings = orders.select("kind", (F.col("kind") < "3").alias("complete"))
    return changes.keep_last_good(orders.withColumn("run", F.lit("old")), new, listings, "kind")


def last_good_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by what their last purchase is followed by."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return changes.last_state(rows, "user_id", "event_id", "ok")


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as an HTML table: the customer spans their rows, a priority two columns."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    cells = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "p"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<td>"), r["o_orderkey"].cast("string"), F.lit("</td><td colspan='2'><b>"), r["p"], F.lit("</b> of 5</td></tr>"))), "<tr>")
    head = F.concat(F.lit("<p>x</p><table><tr><th>c</th><th>o</th><th colspan=2>p</th></tr><tr><td rowspan="), F.size("rows").cast("string"), F.lit(">"), F.col("o_custkey").cast("string"), F.lit("</td>"))
    return cells.select("o_custkey", F.concat(head, body, F.lit("</table>")).alias("html"))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanned tables as grids."""
    found = grids.html_tables(_order_tables(spark, sf_dir), "o_custkey", "html")
    return found.select("o_custkey", "row_no", "col_no", "text", "header", "repeated")


def order_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanned tables as Markdown."""
    return grids.as_markdown(grids.html_tables(_order_tables(spark, sf_dir), "o_custkey", "html"), "o_custkey").select("o_custkey", "markdown")


QUERIES = {
    f.__name__: f
    for f in (
        record_lookup, token_links, label_boxes, mathy_texts, visual_units, walk_order, kept_listings, last_good_states, order_grid, order_markdown,
    )
}
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS source FROM documents)"
_ORDERS = """o AS (SELECT o_custkey, o_orderkey, substr(o_orderpriority, 1, 1) AS p,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, substr(o_orderpriority, 1, 1))::INT AS nth FROM orders)"""
ORACLES = {
    "record_lookup": f"""
WITH {_DOCS} SELECT source || '/' || doc_id || ['.pdf', '.pdf.md', '.pdf.assets/page/1.png'][doc_id % 3 + 1] AS path, source AS course,
     CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS item FROM d WHERE doc_id % 2 = 0 OR doc_id % 10 < 3""",
    "token_links": f"""
WITH {_DOCS} SELECT d.doc_id, sha256('[see](' || CASE WHEN d.doc_id % 2 = 0 THEN '../' || d.source || '.md' ELSE 'canvas-page:' || d.doc_id END || ')' || d.text ||
     '[see](' || CASE WHEN n.doc_id % 2 = 0 THEN '../' || n.source || '.md' ELSE 'canvas-file:' || (d.doc_id + 1) END || ')') AS digest
FROM d LEFT JOIN d n ON n.doc_id = d.doc_id + 1""",
    "label_boxes": """
WITH p AS (SELECT p_partkey AS k, p_partkey // 4 AS page, p_partkey * 7 % 100 AS cx, p_size * 3 % 60 AS cy, p_partkey % 4 * 20 AS x, p_size AS y, 24 AS w, 20 + p_partkey % 3 * 4 AS h FROM part)
SELECT l.page, l.k AS label, min_by(b.k, (b.w * b.h, b.k)) AS box FROM p l JOIN p b ON l.page = b.page AND l.cx BETWEEN b.x - b.w / 4.0 AND b.x + b.w * 1.25 AND l.cy BETWEEN b.y - b.h / 4.0 AND b.y + b.h * 1.25
GROUP BY l.page, l.k""",
    "mathy_texts": f"""
WITH {_DOCS}, m AS (SELECT doc_id, text || repeat(chr(10) || 'x = 1', doc_id % 5) || repeat('∑', greatest(doc_id % 7 - 3, 0)) AS t FROM d)
SELECT doc_id, length(t) - length(translate(t, '{predicates.MATH_SIGNS}', '')) >= 3
       OR len(list_filter(string_split(t, chr(10)), lambda x: contains(x, '=') AND length(trim(x)) BETWEEN 3 AND 90)) >= 3 AS mathy FROM m""",
    "visual_units": f"""
WITH {_DOCS}
SELECT source AS path, count(*) FILTER (doc_id % 4 < 2) AS total, count(*) FILTER (doc_id % 4 = 1) AS described, least(count(*) FILTER (doc_id % 4 = 0), 20)::INT AS listed,
       min(doc_id) FILTER (doc_id % 4 = 0) AS first FROM d WHERE doc_id % 4 < 2 GROUP BY source""",
    "walk_order": """
SELECT doc_id, min(source)::INT AS source, min_by(position, (source, position)) AS position
FROM (SELECT doc_id, 0 AS source, -doc_id AS position FROM labels UNION ALL SELECT doc_id, 1, doc_id FROM documents) GROUP BY doc_id""",
    "kept_listings": """
SELECT o_orderkey, o_orderpriority AS kind, CASE WHEN o_orderpriority < '3' THEN 'new' ELSE 'old' END AS run FROM orders WHERE o_orderpriority >= '3' OR o_orderkey % 2 = 0""",
    "last_good_states": """
SELECT user_id, CASE WHEN last_good IS NULL THEN 'failed' WHEN last_good < last THEN 'stale' ELSE 'current' END AS state, last_good
FROM (SELECT user_id, max(event_id) AS last, max(event_id) FILTER (event_type = 'purchase') AS last_good FROM events GROUP BY user_id)""",
    "order_grid": f"""
WITH {_ORDERS}, c AS (SELECT DISTINCT o_custkey FROM orders)
SELECT o_custkey, 0 AS row_no, col_no, ['c', 'o', 'p', ''][col_no + 1] AS text, true AS header, col_no = 3 AS repeated FROM c, unnest([0, 1, 2, 3]) t(col_no)
UNION ALL SELECT o_custkey, nth, col_no, [o_custkey::VARCHAR, o_orderkey::VARCHAR, p || ' of 5', ''][col_no + 1], false, col_no = 3 OR col_no = 0 AND nth > 1
FROM o, unnest([0, 1, 2, 3]) t(col_no)""",
    "order_markdown": f"""
WITH {_ORDERS} SELECT o_custkey, '| c | o | p |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
     string_agg('| ' || o_custkey || ' | ' || o_orderkey || ' | ' || p || ' of 5 |  |', chr(10) ORDER BY nth) AS markdown FROM o GROUP BY o_custkey""",
}
