"""Section, evidence, mining and page queries over ``documents``, ``benchmark`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import html
from lectern.operators import changes, coverage, practice, sections
from lectern.plans.tables import table

EMPHASIS = r"(?i)\b(this|the|and)\b"
SPLIT = r"[^.!?\n]+"
MOST_HINTS = 150
MOVES = [("https://m", "https://mobile"), ("https://blog", "https://journal"), ("http:", "https:")]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_lines_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document with the number of the block they are in: a line of one word
    begins a block."""
    rows = sections.lines(_docs(spark, sf_dir), "doc_id")
    heading = (~F.contains(F.trim("line"), F.lit(" "))).cast("int")
    number = F.sum(heading).over(W.partitionBy("doc_id").orderBy("line_no"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), number.alias("block"))


def duplicate_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.lines(_docs(spark, sf_dir), "doc_id").withColumn("line", F.substring_index("line", " ", 1))
    nth = F.row_number().over(W.partitionBy("doc_id", F.lower("line")).orderBy("line_no"))
    return rows.withColumn("nth", nth).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.when(F.col("nth") == 1, F.col("line")).otherwise(F.concat("line", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).alias("locator"),
    )


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.sections(_docs(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "sec_no", F.posexplode(sections.packed(F.col("text"), F.col("heading"), F.col("level"))).alias("chunk_no", "chunk"))


def doc_page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", sections.page_of(text, 100, 200).alias("page"), (F.length(text) > 300).alias("more"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts once each with where else they stand; spacing and case do not count."""
    folded = F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), 256)
    return _docs(spark, sf_dir).groupBy(folded.alias("folded")).agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("others"))


def content_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents whose text a labelled one has: done through their twin."""
    print_of = _docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("print"))
    marks = table(spark, sf_dir, "labels").select("doc_id").distinct()
    done = print_of.join(marks, "doc_id", "left_semi").groupBy("print").agg(F.min("doc_id").alias("twin"))
    return print_of.join(marks, "doc_id", "left_anti").join(done, "print").select("doc_id", "twin")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three or more documents of a source share."""
    rows = sections.lines(_docs(spark, sf_dir).withColumn("key", F.struct("source", "doc_id")), "key")
    flat = rows.select("key.source", "key.doc_id", F.trim("line").alias("line")).where("line <> ''")
    found = coverage.frequent_lines(flat, "source", "line", "doc_id", 3, 0.0)
    return found.select("source", F.sha2("line", 256).alias("line"), "times")


def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of text, language and availability; ids and names are no part of it."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = _docs(spark, sf_dir).join(marks, "doc_id", "left")
    parts = (F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("quality").cast("string"), F.lit("current")))
    return rows.select("doc_id", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage cited from the documents numbered by its id and twice its id."""
    items = table(spark, sf_dir, "benchmark")
    again = items.select(F.col("item_id").alias("citation"), (F.col("item_id") * 2).alias("doc_id"), F.col("text").alias("quote"))
    return items.select(F.col("item_id").alias("citation"), F.col("item_id").alias("doc_id"), F.col("text").alias("quote")).unionByName(again).distinct()


def quote_evidence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing wrong with each citation, null for valid ones."""
    found = practice.validate_quotes(_citations(spark, sf_dir), _docs(spark, sf_dir), "quote", "text", "doc_id")
    return found.select("citation", "doc_id", "error")


def quote_evidence_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of 40 characters from the middle of each document, in every third with a
    letter added, which its text does not hold."""
    docs = _docs(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    inside = F.substring(text, F.floor(F.length(text) / 2).cast("int") + 1, F.lit(40))
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(inside, F.lit("#"))).otherwise(inside)
    found = practice.validate_quotes(docs.select("doc_id", quote.alias("quote")), docs, "quote", "text", "doc_id")
    return found.select("doc_id", F.col("error").isNull().alias("valid"))


def evidence_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations saved with a digest, rechecked after every German text has changed."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    saved = docs.select("doc_id", F.sha2("text", 256).alias("saved"))
    now = docs.select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("now"))
    return saved.join(now, "doc_id").select("doc_id", F.when(F.col("saved") == F.col("now"), "current").otherwise("changed_source").alias("state"))


def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason, in order, why a document is no evidence."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    code = practice.first_failure(
        (F.col("source").isNull() | F.contains("source", F.lit("..")), "invalid_path"),
        (F.coalesce(F.length("text"), F.lit(0)) == 0, "missing_source"),
        (F.col("toxic") == 1, "unavailable_source"),
        (F.col("quality") == 0, "stale_extraction"),
        (F.length("text") < 200, "unreadable_source"),
    )
    return rows.select("doc_id", code.alias("code"))


def sentence_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emphatic sentences of each source, each text once, best first, ``MOST_HINTS`` at most."""
    spans = F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPLIT), F.lit(0))).alias("ord", "sentence")
    rows = _docs(spark, sf_dir).select("doc_id", "source", spans)
    rows = rows.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"\s+", " "))).where(F.length("sentence") >= 12)
    weight = F.regexp_count("sentence", F.lit(EMPHASIS)).alias("weight")
    hits = rows.select("doc_id", "source", "ord", F.sha2(F.lower("sentence"), 256).alias("folded"), weight).where("weight > 0")
    once = hits.groupBy("folded").agg(F.min(F.struct("doc_id", "ord", "source", "weight")).alias("m")).select("folded", "m.*")
    nth = F.row_number().over(W.partitionBy("source").orderBy(F.desc("weight"), "doc_id", "ord"))
    kept = once.withColumn("nth", nth).where(F.col("nth") <= MOST_HINTS)
    return kept.select("source", "nth", "doc_id", "folded", F.col("weight").cast("long").alias("weight"))


def stop_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPLIT), F.lit(0))
    useful = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
    return _docs(spark, sf_dir).select("doc_id", F.size(useful).cast("long").alias("sentences"))


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(html.links(F.coalesce("html", F.lit("")))).alias("ord", "target"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_links(spark, sf_dir).select("page_id", F.col("ord").cast("long").alias("ord"), "target")


def link_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target once, from the page and place that name it first."""
    first = F.min(F.struct("page_id", "ord"))
    return _page_links(spark, sf_dir).groupBy("target").agg(first.alias("m")).select("target", "m.page_id", F.col("m.ord").cast("long").alias("ord"))


def _host(url: str) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1)


def page_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme, host = F.regexp_extract("url", r"^([a-z]+)://", 1), F.substring_index(_host("url"), ".", 1)
    return table(spark, sf_dir, "pages").groupBy(scheme.alias("scheme"), host.alias("platform")).agg(F.count("*").alias("pages"))


def page_link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets reached from page 0 within three rounds: pages that share a target are linked."""
    edges = _page_links(spark, sf_dir).select("page_id", "target").distinct()
    known = edges.where("page_id = 0").select("page_id").distinct().withColumn("round", F.lit(0))
    for n in (1, 2, 3):
        targets = known.where(F.col("round") == n - 1).select("page_id").join(edges, "page_id").select("target").distinct()
        reached = edges.join(targets, "target", "left_semi").select("page_id").distinct()
        known = known.unionByName(reached.join(known, "page_id", "left_anti").withColumn("round", F.lit(n)))
    return known


def page_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.html_text(F.col("html")).alias("text"), html.html_text(F.col("html"), True).alias("markdown"))


def path_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as names that must be unique whatever their case."""
    names = table(spark, sf_dir, "pages").select("page_id", F.substring_index(_host("url"), ".", 1).alias("name"))
    return changes.claim_paths(names, "page_id", "name").select("page_id", "claimed")


def key_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs after a rename of prefixes; the longest prefix of whole parts wins."""
    moves = spark.createDataFrame(MOVES, "old string, new string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "//([a-z]+)[.]", "//$1/").alias("url"))
    moves = moves.select(F.regexp_replace("old", "https://([a-z]+)$", "https://$1").alias("old"), "new")
    return changes.move_keys(pages, F.broadcast(moves), "url").select("page_id", "moved")


QUERIES = {
    f.__name__: f
    for f in (
        doc_lines_sections, duplicate_locators, chunk_pack, doc_page_slice, content_dedup, content_twins, running_headers,
        doc_fingerprint, quote_evidence_errors, quote_evidence_valid, evidence_recheck, source_admission, sentence_mining,
        stop_sentence_split, page_links, link_dedupe, page_platforms, page_link_closure, page_html_text, path_claims, key_moves,
    )
}

_LINES = """lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)"""
_LINKS = r"""link AS (SELECT page_id, unnest(t) AS target, generate_subscripts(t, 1) - 1 AS ord FROM (
       SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a\s[^>]*?href=["'']([^"''>]*)["'']', 1) AS t FROM pages))"""
_PLAIN = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(X, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\*\*|__|`', '', 'g'), '\s+', ' ', 'g')))"
_SENTENCES = r"regexp_extract_all(coalesce(text, ''), '[^.!?\n]+', 0)"

ORACLES = {
    "doc_lines_sections": f"""WITH {_LINES}
SELECT doc_id, line_no::BIGINT AS line_no,
       (sum(CASE WHEN contains(trim(line), ' ') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS block FROM lines""",
    "duplicate_locators": f"""WITH {_LINES},
n AS (SELECT doc_id, line_no, split_part(line, ' ', 1) AS line,
             row_number() OVER (PARTITION BY doc_id, lower(split_part(line, ' ', 1)) ORDER BY line_no) AS nth FROM lines)
SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN nth = 1 THEN line ELSE line || ' (' || nth || ')' END AS locator FROM n""",
    "doc_page_slice": "SELECT doc_id, substr(coalesce(text, ''), 101, 200) AS page, length(coalesce(text, '')) > 300 AS more FROM documents",
    "content_dedup": r"""
SELECT sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS folded, min(doc_id) AS doc_id, count(*) - 1 AS others
FROM documents GROUP BY 1""",
    "content_twins": """
WITH p AS (SELECT doc_id, coalesce(text, '') AS t, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents)
SELECT a.doc_id, min(b.doc_id) AS twin FROM p a JOIN p b ON a.t = b.t WHERE NOT a.done AND b.done GROUP BY a.doc_id""",
    "running_headers": f"""WITH {_LINES}
SELECT source, sha256(trim(line)) AS line, count(DISTINCT doc_id) AS times FROM lines WHERE trim(line) <> ''
GROUP BY source, trim(line) HAVING count(DISTINCT doc_id) >= 3""",
    "doc_fingerprint": """
SELECT d.doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(quality::VARCHAR, 'current')) AS fingerprint
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "quote_evidence_errors": f"""
WITH c AS (SELECT item_id AS citation, item_id AS doc_id, text AS quote FROM benchmark UNION SELECT item_id, item_id * 2, text FROM benchmark)
SELECT citation, c.doc_id, CASE WHEN d.text IS NULL THEN 'missing_source' WHEN NOT contains({_PLAIN.replace('X', 'd.text')}, {_PLAIN.replace('X', 'quote')})
       THEN 'quote_mismatch' END AS error FROM c LEFT JOIN documents d ON c.doc_id = d.doc_id""",
    "quote_evidence_valid": r"""
WITH d AS (SELECT doc_id, text IS NOT NULL AS known, coalesce(text, '') AS t FROM documents),
q AS (SELECT doc_id, known, t, substr(t, (length(t) // 2) + 1, 40) || CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END AS quote FROM d),
f AS (SELECT doc_id, known, lower(trim(regexp_replace(regexp_replace(t, '\*\*|__|`', '', 'g'), '\s+', ' ', 'g'))) AS t,
             lower(trim(regexp_replace(regexp_replace(quote, '\*\*|__|`', '', 'g'), '\s+', ' ', 'g'))) AS quote FROM q)
SELECT doc_id, known AND length(regexp_replace(quote, '[^\p{L}\p{N}]', '', 'g')) >= 2 AND contains(t, quote) AS valid FROM f""",
    "evidence_recheck": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'changed_source' ELSE 'current' END AS state FROM documents",
    "source_admission": """
SELECT d.doc_id, CASE WHEN source IS NULL OR contains(source, '..') THEN 'invalid_path' WHEN coalesce(length(text), 0) = 0 THEN 'missing_source'
       WHEN toxic = 1 THEN 'unavailable_source' WHEN quality = 0 THEN 'stale_extraction' WHEN length(text) < 200 THEN 'unreadable_source' END AS code
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "sentence_mining": rf"""
WITH s AS (SELECT doc_id, source, unnest({_SENTENCES}) AS raw, generate_subscripts({_SENTENCES}, 1) - 1 AS ord FROM documents),
h AS (SELECT doc_id, source, ord, sha256(lower(trim(regexp_replace(raw, '\s+', ' ', 'g')))) AS folded,
             len(regexp_extract_all(trim(regexp_replace(raw, '\s+', ' ', 'g')), '(?i)\b(this|the|and)\b', 0)) AS weight
      FROM s WHERE length(trim(regexp_replace(raw, '\s+', ' ', 'g'))) >= 12),
o AS (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY doc_id, ord) AS nth_text FROM h WHERE weight > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id, ord) AS nth FROM o WHERE nth_text = 1)
SELECT source, nth::INT AS nth, doc_id, folded, weight::BIGINT AS weight FROM r WHERE nth <= 150""",
    "stop_sentence_split": f"SELECT doc_id, len(list_filter({_SENTENCES}, lambda s: trim(s) <> ''))::BIGINT AS sentences FROM documents",
    "page_links": f"WITH {_LINKS} SELECT page_id, ord::BIGINT AS ord, target FROM link",
    "link_dedupe": f"""WITH {_LINKS}
SELECT target, page_id, ord::BIGINT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY page_id, ord) AS nth FROM link) WHERE nth = 1""",
    "page_platforms": """
SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, split_part(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.', 1) AS platform, count(*) AS pages
FROM pages GROUP BY ALL""",
    "page_link_closure": f"""
WITH {_LINKS}, e AS (SELECT DISTINCT page_id, target FROM link),
n1 AS (SELECT DISTINCT b.page_id FROM e a JOIN e b ON a.target = b.target WHERE a.page_id = 0),
n2 AS (SELECT DISTINCT b.page_id FROM n1 JOIN e a ON a.page_id = n1.page_id JOIN e b ON a.target = b.target),
n3 AS (SELECT DISTINCT b.page_id FROM n2 JOIN e a ON a.page_id = n2.page_id JOIN e b ON a.target = b.target),
u AS (SELECT 0 AS page_id, 0 AS n WHERE EXISTS (SELECT 1 FROM e WHERE page_id = 0)
      UNION ALL SELECT page_id, 1 FROM n1 UNION ALL SELECT page_id, 2 FROM n2 UNION ALL SELECT page_id, 3 FROM n3)
SELECT page_id, min(n)::INT AS round FROM u GROUP BY page_id""",
    "path_claims": """
WITH n AS (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.', 1) AS name FROM pages)
SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY lower(name) ORDER BY page_id) = 1 THEN name ELSE name || ' (' || page_id || ')' END AS claimed FROM n""",
    "key_moves": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '//([a-z]+)[.]', '//\1/', 'g') AS u FROM pages)
SELECT page_id, CASE WHEN u = 'https://m' OR starts_with(u, 'https://m/') THEN 'https://mobile' || substr(u, 10)
                     WHEN u = 'https://blog' OR starts_with(u, 'https://blog/') THEN 'https://journal' || substr(u, 13)
                     WHEN starts_with(u, 'http:/') THEN 'https:' || substr(u, 6) ELSE u END AS moved FROM p""",
}
