"""Queries of locators, threads and reviewed sources over the tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import changes, locators, records, threads, upkeep
from lectern.plans.tables import table


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as sections of their brand, and a citation of each, every second one without its first vowel."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("name"))
    written = F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.regexp_replace("name", "^([^aeiou]*)[aeiou]", "$1"))
    sections = parts.select("path", F.col("p_partkey").alias("sec_no"), F.concat(F.lit("## "), "name").alias("locator"))
    return parts.select("p_partkey", "path", written.alias("locator")), sections


def locator_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by locator: the section each opens, or why it opens none."""
    citations, sections = _sections(spark, sf_dir)
    return records.by_locator(citations, sections).select("p_partkey", "sec_no", "error")


def locator_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each citation that opens nothing, the three nearest names of its source."""
    citations, sections = _sections(spark, sf_dir)
    lost = records.by_locator(citations, sections).where("error = 'missing_locator'").select("p_partkey", "path", "locator")
    near = locators.close_names(lost, sections)
    return lost.join(near, ["path", "locator"]).select("p_partkey", "rank", "name", F.round("similarity", 6).alias("similarity"))


def _discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the JSON of threads: of four turns, one opens, two answer it, one answers the second."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    depth = F.element_at(F.array(*map(F.lit, (0, 1, 1, 2))), (F.col("nth") % 4 + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").withColumn("nth", nth).withColumn("depth", depth)
    turns = turns.withColumn("next", F.lead("depth").over(W.partitionBy("conv_id").orderBy("turn")))
    entry = F.to_json(F.struct(
        F.col("turn").alias("id"), F.col("role").alias("user_id"), F.col("text").alias("message"),
        F.lit("2024-03-01T10:00:00Z").alias("created_at"), (F.col("nth") % 5 == 4).alias("deleted"),
    ))
    opened = F.concat(F.expr("left(entry, length(entry) - 1)"), F.lit(',"replies":['))
    closed = F.repeat(F.lit("]}"), (F.col("depth") - F.coalesce("next", F.lit(0)) + 1).cast("int"))
    piece = F.concat(opened, closed, F.when(F.col("next") <= F.col("depth"), ",").otherwise(""))
    pieces = turns.withColumn("entry", entry).select("conv_id", F.struct("nth", piece.alias("p")).alias("piece"))
    view = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["p"]), "")
    people = F.lit('],"participants":[{"id":"user","display_name":"Student"},{"id":"assistant","display_name":"Tutor"}]}')
    return pieces.groupBy("conv_id").agg(F.concat(F.lit('{"view":['), view, people).alias("body"))


def thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of nested threads in the order of reading, with depth and path."""
    rows = threads.replies(_discussions(spark, sf_dir), "conv_id", "body")
    return rows.select("conv_id", "position", "depth", F.array_join("path", ".").alias("path"), "id", "parent", "author", "message", "deleted")


def thread_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested threads as nested lists, tutors named as instructors."""
    found = _discussions(spark, sf_dir)
    teachers = spark.createDataFrame([("assistant",)], "author_id string")
    return threads.render(found.select("conv_id"), threads.replies(found, "conv_id", "body"), "conv_id", teachers)


def scope_two_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against what was reviewed: some reviewed in an older form of stamp, some changed, new, gone or missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new, old = F.sha2("text", 256), F.md5("text")
    was = F.when(F.col("doc_id") % 11 == 0, F.md5(F.lit("other"))).when(F.col("doc_id") % 3 == 1, old).otherwise(new)
    reviewed = docs.where("doc_id % 7 <> 0").select("doc_id", was.alias("stamp"), (F.col("doc_id") % 13 == 0).alias("missing"))
    current = docs.where("doc_id % 5 <> 0").select("doc_id", new.alias("stamp"), old.alias("legacy"), (F.col("doc_id") % 17 == 0).alias("missing"))
    return changes.scope_diff(reviewed, current, "doc_id", "stamp", "legacy", "missing")


def carried_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of documents saved with a digest, without one, or at a place that is gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    third = F.col("doc_id") % 3
    files = docs.select("doc_id", "digest", "n_chars", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("touched"))
    saved = docs.select(
        F.col("doc_id").alias("note"), F.when(third == 2, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") % 9 == 0, "other").when(third == 1, None).when(F.col("doc_id") % 10 == 5, "lost").otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.lit("2024-01-20").cast("date").alias("described"),
    )
    found = upkeep.carried_over(saved, files, "doc_id", "digest", "n_chars", "described", "touched")
    return found.select("note", "doc_id", "digest", "state")


QUERIES = {
    f.__name__: f for f in (locator_citations, locator_suggestions, thread_rows, thread_markdown, scope_two_stamps, carried_descriptions)
}
_CITED = """s AS (SELECT p_partkey, p_brand AS path, p_name AS name FROM part),
c AS (SELECT p_partkey, path, CASE WHEN p_partkey % 2 = 0 THEN name ELSE regexp_replace(name, '^([^aeiou]*)[aeiou]', '\\1') END AS locator FROM s),
h AS (SELECT c.p_partkey, c.path, c.locator, count(s.p_partkey) AS n, min(s.p_partkey) AS sec_no
      FROM c LEFT JOIN s ON c.path = s.path AND c.locator = s.name GROUP BY ALL)"""
_TURNS = """t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS nth FROM conversations),
r AS (SELECT *, [0, 1, 1, 2][nth % 4 + 1] AS depth, nth // 4 AS top FROM t)"""
ORACLES = {
    "locator_citations": f"""
WITH {_CITED} SELECT p_partkey, CASE WHEN n = 1 THEN sec_no END AS sec_no,
     CASE WHEN n = 0 THEN 'missing_locator' WHEN n > 1 THEN 'ambiguous_locator' END AS error FROM h""",
    "locator_suggestions": f"""
WITH {_CITED}, w AS (SELECT DISTINCT path, locator FROM h WHERE n = 0), n AS (SELECT DISTINCT path, name FROM s),
p AS (SELECT w.path, locator, name, levenshtein(locator, name) AS edits, greatest(length(locator), length(name)) AS longer FROM w JOIN n ON w.path = n.path),
k AS (SELECT path, locator, name, 1 - edits::DOUBLE / longer AS similarity,
             row_number() OVER (PARTITION BY path, locator ORDER BY 1 - edits::DOUBLE / longer DESC, name) AS rank FROM p WHERE edits * 10 <= longer * 4)
SELECT p_partkey, rank::INT AS rank, name, round(similarity, 6) AS similarity FROM h JOIN k ON h.path = k.path AND h.locator = k.locator WHERE n = 0 AND rank <= 3""",
    "thread_rows": f"""
WITH {_TURNS} SELECT conv_id, nth AS position, depth::INT AS depth, top || ['', '.0', '.1', '.1.0'][nth % 4 + 1] AS path, turn::VARCHAR AS id,
     CASE nth % 4 WHEN 1 THEN lag(turn) OVER o WHEN 2 THEN lag(turn, 2) OVER o WHEN 3 THEN lag(turn) OVER o END::VARCHAR AS parent,
     CASE role WHEN 'user' THEN 'Student' WHEN 'assistant' THEN 'Tutor' END AS author, text AS message, nth % 5 = 4 AS deleted
FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY nth)""",
    "thread_markdown": f"""
WITH {_TURNS}, m AS (SELECT *, repeat('  ', depth) AS pad, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS said,
       CASE role WHEN 'user' THEN 'Student' WHEN 'assistant' THEN 'Tutor (Instructor)' ELSE 'Someone' END AS who FROM r),
l AS (SELECT *, list_transform(string_split_regex(said, '\\r?\\n'), lambda x: regexp_replace(x, '\\s+$', '')) AS lines, pad || '- **' || who || '** · 2024-03-01:' AS head FROM m)
SELECT conv_id, string_agg(CASE WHEN nth % 5 = 4 THEN pad || '- _(deleted reply)_' WHEN said = '' THEN head WHEN len(lines) = 1 THEN head || ' ' || said
       ELSE head || chr(10) || array_to_string(list_transform(lines, lambda x: CASE WHEN x = '' THEN '' ELSE pad || '  ' || x END), chr(10)) END, chr(10) ORDER BY nth) AS markdown
FROM l GROUP BY conv_id""",
    "scope_two_stamps": """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 11 = 0 OR (doc_id % 13 = 0) <> (doc_id % 17 = 0) THEN 'changed'
       ELSE 'unchanged' END AS change FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0""",
    "carried_descriptions": """
WITH d AS (SELECT doc_id, n_chars, sha256(coalesce(text, '')) AS digest, DATE '2024-01-01' + (doc_id % 40)::INT AS touched FROM documents),
s AS (SELECT *, doc_id % 3 AS third, CASE WHEN doc_id % 9 = 0 THEN 'other' WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 10 = 5 THEN 'lost' ELSE digest END AS own,
             min(doc_id) OVER (PARTITION BY digest) AS place FROM d)
SELECT doc_id AS note, CASE WHEN third < 2 THEN doc_id WHEN own = digest THEN place ELSE -1 - doc_id END AS doc_id,
       CASE WHEN third = 1 AND doc_id % 4 <> 0 AND touched < DATE '2024-01-20' THEN digest ELSE own END AS digest,
       CASE WHEN third = 2 THEN CASE WHEN own = digest THEN 'moved' ELSE 'gone' END WHEN own = digest THEN 'current'
            WHEN third = 1 AND doc_id % 4 <> 0 AND touched < DATE '2024-01-20' THEN 'carried' ELSE 'stale' END AS state FROM s""",
}
