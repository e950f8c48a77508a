"""Retrieval queries over ``documents`` and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import stem, text
from lectern.operators import retrieval
from lectern.operators.index import InvertedIndex
from lectern.plans.tables import table
from lectern.storage import fresh_path, materialize

TERMS = ["anstou", "thinghe", "thntwh"]
BOTH = ["ertion", "ontion"]
ALTERNATE = ["thinghe", "thha"]
TOP = 20
CAP = 3
KINDS = ["en", "fr"]
COURSES = ["src0", "src1", "src2", "src3", "src4"]
AROUND = 3
PHRASE, PREFIX = "of the", "thing*"
QUERY, OTHER_QUERY = 'Show me the "the and" or thing* of anst', 'ertion "of the"'
ASKED = 6  # words of a passage that are asked for
MOST_KEYED = 5  # words of a passage by whose hash it is looked up


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first line as title and the rest as text."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    head = F.substring_index(body, "\n", 1)
    return docs.select(
        "doc_id", F.col("source").alias("course"), F.col("lang").alias("kind"), head.alias("title"),
        F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\\n', 1)) + 2)").alias("text"),
    )


_INDEXES: dict[tuple[str, str], InvertedIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The index of a folder's documents, built once a session: title, rest, and the digest as stamp."""
    known = spark.sparkContext.applicationId, sf_dir
    if known not in _INDEXES:
        index = InvertedIndex(spark, fresh_path(spark, "index"))
        index.build(_titled(spark, sf_dir), "doc_id", F.sha2(F.concat("title", "text"), 256))
        _INDEXES[known] = index
    return _INDEXES[known]


def _ranked(spark: SparkSession, sf_dir: str, terms: list[str], complete: bool, title_weight: float = 1.0) -> DataFrame:
    """The best documents for ``terms``; without a title weight a document is one text."""
    index = stored_index(spark, sf_dir)
    found = index.lookup(terms, title_weight)
    scored = retrieval.bm25(found, index.corpus(found, len(terms)), len(terms)).withColumnRenamed("key", "doc_id")
    hits = scored.where(F.col("held") == len(terms)) if complete else scored
    top = hits.orderBy(F.desc("score"), "doc_id").limit(TOP)
    return top.select("doc_id", F.col("held").cast("int").alias("held"), F.round("score", 6).alias("score"))


def doc_bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, BOTH, True)


def doc_bm25_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, TERMS, False)


def doc_bm25_fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, TERMS, False, retrieval.TITLE_WEIGHT).select("doc_id", "score")


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where the words of a phrase follow each other; its frequency is the phrase's own."""
    return _ranked(spark, sf_dir, [PHRASE], False, retrieval.TITLE_WEIGHT)


def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that begin so are one term, beside a plain one."""
    return _ranked(spark, sf_dir, [PREFIX, TERMS[0]], False)


def _fused(spark: SparkSession, sf_dir: str, where=None, queries=(TERMS, ALTERNATE)) -> DataFrame:
    index = stored_index(spark, sf_dir)
    terms = list(dict.fromkeys(t for q in queries for t in q))
    found = index.lookup(terms)
    hits = found
    if where is not None:  # narrow columns only; the statistics stay those of all documents
        meant = _titled(spark, sf_dir).where(where).select(F.col("doc_id").alias("key"))
        hits = found.join(meant, "key", "left_semi")
    return retrieval.fused(hits, index.corpus(found, len(terms)), "key", queries, terms).withColumnRenamed("key", "doc_id")


def search_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query as it is typed, with an alternate: stop words, a phrase, a beginning, bounds,
    the best of each course, and the state of each hit's text since it was indexed."""
    queries = retrieval.bounded_queries(QUERY, [OTHER_QUERY], TOP)
    hits = retrieval.availability(_fused(spark, sf_dir, queries=queries), _records(spark, sf_dir), "doc_id")
    hits = hits.join(_titled(spark, sf_dir).select("doc_id", "course"), "doc_id")
    order = [F.col("availability") != "current", F.desc("complete"), F.desc("fused"), F.col("doc_id")]
    top = retrieval.capped(hits, "course", order, CAP).orderBy(*order).limit(TOP)
    stamps = stored_index(spark, sf_dir).documents().select(F.col("key").alias("doc_id"), "stamp")
    now = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "^([^\n]*)\n", "$1").alias("text"))
    same = F.col("stamp") == F.sha2("text", 256)
    told = stamps.join(F.broadcast(top), "doc_id")  # TOP rows, so texts stay where they are
    return now.join(F.broadcast(told), "doc_id").select(
        "doc_id", "course", "availability", "complete", F.round("fused", 10).alias("fused"), F.size("queries").alias("matched"), same.alias("unchanged")
    )


def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds of each word after texts came, changed and went: as one built anew."""
    now = _titled(spark, sf_dir)
    stamp = F.when(F.col("kind") != "fr", F.sha2(F.concat("title", "text"), 256))  # French texts have none
    gone = now.where("kind = 'en'").select((-1 - F.col("doc_id")).alias("doc_id"), "course", "kind", "title", "text")
    kept = now.where("course is null or course <> 'src1'")
    before = kept.withColumn("text", F.when(F.col("kind") == "de", F.lower("title")).otherwise(F.col("text"))).unionByName(gone)
    index = InvertedIndex(spark, fresh_path(spark, "changed_index"))
    index.build(before, "doc_id", stamp)
    index.update(now, "doc_id", stamp)
    index.compact(range(0, index.buckets, 2))
    living = index._living(index.postings().select("term", "key", "segment", "size", (F.size("at") + F.size("head")).alias("times")))
    return living.groupBy("term").agg(
        F.count("*").alias("documents"), F.sum("times").cast("long").alias("times"), F.sum("size").cast("long").alias("words")
    )


def search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _fused(spark, sf_dir).orderBy(F.desc("complete"), F.desc("fused"), "doc_id").limit(TOP)
    return hits.select("doc_id", F.round("fused", 10).alias("fused"), "complete", F.size("queries").alias("matched"))


def search_rrf_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ``CAP`` hits of a course; the cap comes after fusion and before the limit."""
    hits = _fused(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    order = [F.desc("complete"), F.desc("fused"), F.col("doc_id")]
    top = retrieval.capped(hits, "source", order, CAP).orderBy(*order).limit(TOP)
    return top.select("doc_id", "source", F.round("fused", 10).alias("fused"), "complete")


def search_filtered_kind_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on kind and course; statistics stay those of the whole corpus."""
    where = F.col("kind").isin(KINDS) & F.col("course").isin(COURSES)
    hits = _fused(spark, sf_dir, where).orderBy(F.desc("complete"), F.desc("fused"), "doc_id").limit(TOP)
    return hits.select("doc_id", F.round("fused", 10).alias("fused"), "complete")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 0, "stale").otherwise("current")
    return marks.select("doc_id", status.alias("availability"))


def search_status_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable documents first, then complete matches, then the fused score."""
    hits = retrieval.availability(_fused(spark, sf_dir), _records(spark, sf_dir), "doc_id")
    order = [F.col("availability") != "current", F.desc("complete"), F.desc("fused"), F.col("doc_id")]
    return hits.orderBy(*order).limit(TOP).select("doc_id", "availability", "complete", F.round("fused", 10).alias("fused"))


ranked_search = search_status_order


def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their number of stemmed, diacritics-free terms of the query."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    wanted = sorted({stem.porter(stem.folded(t)) for t in TERMS})
    hits = docs.select("doc_id", F.filter(stem.stems(F.col("words")), lambda w: w.isin(wanted)).alias("found"))
    return (
        hits.where(F.size("found") > 0)
        .select("doc_id", F.size(F.array_distinct("found")).alias("held"), F.size("found").alias("times"))
        .orderBy(F.desc("held"), F.desc("times"), "doc_id").limit(TOP)
    )


def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around the first hit of each document that holds a term."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    at = F.array_min(F.filter(F.array(*(F.array_position("words", t) for t in TERMS)), lambda p: p > 0))
    start = F.greatest(at - 24, F.lit(1)).cast("int")
    return docs.withColumn("at", at).where("at is not null").select(
        "doc_id", F.concat_ws(" ", F.slice("words", start, 48)).alias("snippet")
    )


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_index(spark, sf_dir)
    stats = index.corpus(index.lookup(TERMS, 1.0), len(TERMS))
    return stats.select(F.posexplode("frequencies").alias("i", "df"), "n", F.round("mean_size", 6).alias("avgdl")).select(
        F.element_at(F.array(*map(F.lit, TERMS)), F.col("i") + 1).alias("term"), F.col("df").cast("long").alias("df"), "n", "avgdl"
    )


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, doc_id)``: the documents that hold a benchmark passage word for word.

    The words of a passage between its first and last stand alone in a document that holds
    it.  Passages are looked up by the hash of the hashes of up to ``MOST_KEYED`` of those, so only
    documents that share them are compared; a passage of one or two words is compared with all.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    flat_of = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    hashed = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w)).alias("h")  # noqa: E731 - each word once
    key = lambda i, n: F.xxhash64(F.lit(n), *(F.get("h", i + k) for k in range(n)))
    passages = items.where("text is not null").select("item_id", flat_of(F.col("text")).alias("passage")).select("item_id", "passage", hashed("passage"))
    size = F.greatest(F.least(F.size("h") - 2, F.lit(MOST_KEYED)), F.lit(0))
    start = F.coalesce(*(F.when(F.col("size") == n, key(F.lit(1), n)) for n in range(MOST_KEYED + 1)))
    wanted = materialize(passages.withColumn("size", size).select("item_id", "passage", "size", start.alias("start")), "wanted")
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # 0 to MOST_KEYED
    flat = docs.select("doc_id", flat_of(F.col("text")).alias("flat"))
    at = lambda n: F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
    grams_of = lambda n: F.transform(at(n), lambda i: key(i, n))
    grams = [grams_of(n) for n in sizes if n]
    every = F.concat(*grams, *([F.array(key(F.lit(0), 0))] if 0 in sizes or not sizes else []))
    starts = flat.select("doc_id", hashed("flat")).select("doc_id", F.explode(every).alias("start"))
    met = materialize(starts.join(wanted.select("start", "item_id"), "start").select("doc_id", "item_id").distinct(), "met")  # narrow, and its size is known
    pairs = flat.join(met, "doc_id").join(wanted.select("item_id", "passage"), "item_id").where(F.contains("flat", "passage"))
    return pairs.select("item_id", "doc_id").distinct()


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each benchmark passage stands, and in which first."""
    found = _passages(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return items.join(found, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_doc")


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage asked for by a few of its words: how often a document that holds it is
    among the best five and is the best, by course and over all; and, of passages that no
    document holds, how many find no document with all their words."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.slice(text.tokens(F.col("text")), 2, ASKED))).alias("term"))
    found = materialize(stored_index(spark, sf_dir).ranked(asked, "item_id", most=5), "ranked")
    pairs = _passages(spark, sf_dir)
    held = pairs.groupBy("item_id").agg(F.min("doc_id").alias("first_doc"))
    course = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("first_doc"), F.col("source").alias("course"))
    good = found.where(F.col("place") <= 5).join(pairs, [found["item_id"] == pairs["item_id"], found["key"] == pairs["doc_id"]], "left_semi")
    best = good.groupBy("item_id").agg(F.min("place").alias("best"))
    complete = found.where("held = of").select("item_id").distinct().withColumn("complete", F.lit(True))
    items = asked.select("item_id").distinct()
    rows = items.join(held, "item_id", "left").join(course, "first_doc", "left").join(best, "item_id", "left").join(complete, "item_id", "left")
    has = F.col("first_doc").isNotNull()
    sums = (F.count_if(has).alias("questions"), F.count_if(F.col("best") <= 5).alias("recalled"), F.count_if(F.col("best") == 1).alias("first"),
            F.count_if(~has).alias("controls"), F.count_if(~has & F.col("complete").isNull()).alias("empty_controls"))
    every = rows.groupingSets([["course"], []], "course").agg(F.grouping("course").cast("int").alias("over_all"), *sums)
    return every.select("over_all", "course", "questions", "recalled", "first", "controls", "empty_controls")


def section_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of a document, how many lines and characters its context has."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    near = retrieval.neighbours(lines, "doc_id", "line_no", "line", AROUND)
    return near.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("context").cast("long").alias("context_chars"))


_TOK = r"""
tok AS (SELECT doc_id, course, kind, regexp_extract_all(lower(body), '[\p{L}\p{N}]+', 0) AS words,
               regexp_extract_all(lower(title), '[\p{L}\p{N}]+', 0) AS head FROM doc)"""
_PLAIN = "doc AS (SELECT doc_id, source AS course, lang AS kind, coalesce(text, '') AS body, '' AS title FROM documents)"
_TITLED = r"""doc AS (SELECT doc_id, source AS course, lang AS kind, split_part(coalesce(text, ''), chr(10), 1) AS title,
       substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS body FROM documents)"""


def section_deeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections: a short one is a heading without text of its own, and brings along what is below it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    size = F.length("line")
    body = F.when(size < 60, F.lit("")).otherwise(F.col("line"))
    below = retrieval.with_deeper(lines.select("doc_id", "line_no", (size % 7).alias("level"), body.alias("body")), "doc_id", "line_no", "level", "body")
    return below.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("level").cast("int").alias("level"), F.md5("context").alias("context_md5"))


def _times_sql(term: str, words: str) -> str:
    parts = term.split(" ")
    if term.endswith("*"):
        return f"len(list_filter({words}, lambda w: starts_with(w, '{term[:-1]}')))"
    if len(parts) == 1:
        return f"len(list_filter({words}, lambda w: w = '{term}'))"
    follow = " AND ".join(f"{words}[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: {follow}))"


def _scored_sql(doc: str, queries: list[list[str]]) -> str:
    """CTEs ending in ``hit(query, doc_id, course, kind, score, held, of)``."""
    rows = ", ".join(f"({q}, '{t}')" for q, own in enumerate(queries) for t in own)
    terms = list(dict.fromkeys(t for own in queries for t in own))
    times = " ".join(f"WHEN '{t}' THEN {_times_sql(t, 'words')} + 3.0 * {_times_sql(t, 'head')}" for t in terms)
    return f"""
WITH {doc}, {_TOK},
sized AS (SELECT *, len(words) + len(head) AS d FROM tok),
corpus AS (SELECT count(*) AS n, avg(d) AS mean_d FROM sized),
term AS (SELECT * FROM (VALUES {rows}) AS v(query, word)),
tf AS (SELECT term.query, term.word, doc_id, course, kind, d, CASE term.word {times} END AS f
       FROM sized CROSS JOIN term),
df AS (SELECT query, word, count(*) AS seen FROM tf WHERE f > 0 GROUP BY ALL),
part AS (SELECT tf.query, doc_id, course, kind,
                greatest(CASE WHEN ln((n - seen + 0.5) / (seen + 0.5)) > 0 THEN ln((n - seen + 0.5) / (seen + 0.5)) ELSE 1e-6 END, 1e-6)
                * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d)) AS s
         FROM tf JOIN df ON tf.query = df.query AND tf.word = df.word CROSS JOIN corpus WHERE f > 0),
size AS (SELECT query, count(*) AS n_terms FROM term GROUP BY query),
hit AS (SELECT part.query, doc_id, course, kind, sum(s) AS score, count(*) AS held, any_value(n_terms) AS n_terms
        FROM part JOIN size ON part.query = size.query GROUP BY part.query, doc_id, course, kind)"""


def _fused_sql(where: str = "true", queries: list[list[str]] | None = None) -> str:
    return _scored_sql(_TITLED, queries or [TERMS, ALTERNATE]) + f""",
listed AS (SELECT *, true AS strict FROM hit WHERE held = n_terms AND {where} UNION ALL SELECT *, false FROM hit WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, strict ORDER BY score DESC, doc_id) AS place FROM listed),
kept AS (SELECT *, max(strict) OVER (PARTITION BY query, doc_id) AS best FROM ranked WHERE place <= 160),
fused AS (SELECT doc_id, any_value(course) AS source, sum(CASE WHEN strict THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END / (60 + place)) AS fused,
                 max(strict) AS complete, count(DISTINCT query) AS matched
          FROM kept WHERE strict = best GROUP BY doc_id)"""


QUERIES = {
    f.__name__: f
    for f in (
        doc_bm25_and, doc_bm25_or, doc_bm25_fielded, search_rrf, search_rrf_capped, search_filtered_kind_course,
        search_status_order, search_stemmed, search_snippet, postings_stats, retrieval_quality, section_neighbors,
        search_phrase, search_prefix, search_call, index_after_changes, retrieval_recall, section_deeper,
    )
} | {"ranked_search": ranked_search}

_STATUS = _fused_sql() + """
SELECT fused.doc_id, availability, complete, round(fused, 10) AS fused FROM (
    SELECT fused.*, CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 0 THEN 'stale' ELSE 'current' END AS availability
    FROM fused LEFT JOIN labels ON fused.doc_id = labels.doc_id) AS fused
ORDER BY availability <> 'current', complete DESC, fused.fused DESC, doc_id LIMIT 20"""

_PASSAGES = r"""flat AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents),
item AS (SELECT item_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS passage FROM benchmark)"""
_BEST = " SELECT doc_id, held::INT AS held, round(score, 6) AS score FROM hit ORDER BY hit.score DESC, doc_id LIMIT 20"

ORACLES = {
    "search_phrase": _scored_sql(_TITLED, [[PHRASE]]) + _BEST,
    "search_prefix": _scored_sql(_PLAIN, [[PREFIX, TERMS[0]]]) + _BEST,
    "search_call": _fused_sql(queries=retrieval.bounded_queries(QUERY, [OTHER_QUERY], TOP)) + """,
stated AS (SELECT fused.*, CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 0 THEN 'stale' ELSE 'current' END AS availability
           FROM fused LEFT JOIN labels ON fused.doc_id = labels.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY availability <> 'current', complete DESC, fused DESC, doc_id) AS nth FROM stated)
SELECT doc_id, source AS course, availability, complete, round(fused, 10) AS fused, matched::INT AS matched, true AS unchanged
FROM best WHERE nth <= 3 ORDER BY availability <> 'current', complete DESC, best.fused DESC, doc_id LIMIT 20""",
    "index_after_changes": r"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+', 0) AS words FROM documents),
word AS (SELECT doc_id, len(words) AS size, unnest(words) AS term FROM tok),
own AS (SELECT doc_id, term, any_value(size) AS size, count(*) AS times FROM word GROUP BY doc_id, term)
SELECT term, count(*) AS documents, sum(times)::BIGINT AS times, sum(size)::BIGINT AS words FROM own GROUP BY term""",
    "retrieval_recall": f"""
WITH {_PASSAGES}, {_TITLED}, {_TOK},
sized AS (SELECT doc_id, words, head, len(words) + len(head) AS d FROM tok),
corpus AS (SELECT count(*) AS n, avg(d) AS mean_d FROM sized),
posted AS (SELECT doc_id, d, term, sum(w) AS f FROM (
    SELECT doc_id, d, unnest(words) AS term, 1.0 AS w FROM sized UNION ALL SELECT doc_id, d, unnest(head), 3.0 FROM sized) GROUP BY doc_id, d, term),
df AS (SELECT term, count(*) AS seen FROM posted GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+', 0)[2:{ASKED + 1}]) AS term FROM benchmark),
many AS (SELECT item_id, count(*) AS n_terms FROM asked GROUP BY item_id),
scored AS (SELECT asked.item_id, doc_id, count(*) AS held, any_value(n_terms) AS n_terms,
        round(sum(greatest(CASE WHEN ln((n - seen + 0.5) / (seen + 0.5)) > 0 THEN ln((n - seen + 0.5) / (seen + 0.5)) ELSE 1e-6 END, 1e-6)
        * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean_d))), 9) AS score
    FROM asked JOIN posted ON asked.term = posted.term JOIN df ON df.term = asked.term JOIN many ON many.item_id = asked.item_id CROSS JOIN corpus
    GROUP BY asked.item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored),
pair AS (SELECT item_id, doc_id, source FROM item JOIN flat ON contains(flat, passage)),
told AS (SELECT many.item_id, (SELECT min_by(source, doc_id) FROM pair WHERE pair.item_id = many.item_id) AS course,
        (SELECT count(*) FROM pair WHERE pair.item_id = many.item_id) AS held_by,
        (SELECT min(place) FROM ranked JOIN pair ON ranked.item_id = pair.item_id AND ranked.doc_id = pair.doc_id WHERE ranked.item_id = many.item_id) AS best,
        (SELECT count(*) FROM ranked WHERE ranked.item_id = many.item_id AND held = n_terms) AS complete FROM many)
SELECT grouping(course)::INT AS over_all, course, count(*) FILTER (held_by > 0) AS questions, count(*) FILTER (best <= 5) AS recalled,
       count(*) FILTER (best = 1) AS first, count(*) FILTER (held_by = 0) AS controls, count(*) FILTER (held_by = 0 AND complete = 0) AS empty_controls
FROM told GROUP BY GROUPING SETS ((course), ())""",
    "doc_bm25_and": _scored_sql(_PLAIN, [BOTH]) + " SELECT doc_id, held::INT AS held, round(score, 6) AS score FROM hit WHERE held = n_terms ORDER BY hit.score DESC, doc_id LIMIT 20",
    "doc_bm25_or": _scored_sql(_PLAIN, [TERMS]) + " SELECT doc_id, held::INT AS held, round(score, 6) AS score FROM hit ORDER BY hit.score DESC, doc_id LIMIT 20",
    "doc_bm25_fielded": _scored_sql(_TITLED, [TERMS]) + " SELECT doc_id, round(score, 6) AS score FROM hit ORDER BY hit.score DESC, doc_id LIMIT 20",
    "search_rrf": _fused_sql() + " SELECT doc_id, round(fused, 10) AS fused, complete, matched::INT AS matched FROM fused ORDER BY complete DESC, fused.fused DESC, doc_id LIMIT 20",
    "search_rrf_capped": _fused_sql() + """
, best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY complete DESC, fused DESC, doc_id) AS nth FROM fused)
SELECT doc_id, source, round(fused, 10) AS fused, complete FROM best WHERE nth <= 3 ORDER BY complete DESC, best.fused DESC, doc_id LIMIT 20""",
    "search_filtered_kind_course": _fused_sql("kind IN ('en', 'fr') AND course IN ('src0', 'src1', 'src2', 'src3', 'src4')")
    + " SELECT doc_id, round(fused, 10) AS fused, complete FROM fused ORDER BY complete DESC, fused.fused DESC, doc_id LIMIT 20",
    "search_status_order": _STATUS,
    "ranked_search": _STATUS,
    "postings_stats": _scored_sql(_PLAIN, [TERMS]) + """
SELECT term.word AS term, coalesce(seen, 0)::BIGINT AS df, n, round(mean_d, 6) AS avgdl
FROM term LEFT JOIN df ON term.word = df.word CROSS JOIN corpus""",
    "retrieval_quality": r"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents),
item AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS passage FROM benchmark)
SELECT item_id, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc
FROM item LEFT JOIN flat ON contains(flat, passage) GROUP BY item_id""",
    "search_snippet": _scored_sql(_PLAIN, [TERMS]) + """
, found AS (SELECT doc_id, words, list_min(list_filter([list_position(words, 'anstou'), list_position(words, 'thinghe'), list_position(words, 'thntwh')], lambda p: p > 0)) AS nth FROM tok)
SELECT doc_id, array_to_string(words[greatest(nth - 24, 1):greatest(nth - 24, 1) + 47], ' ') AS snippet FROM found WHERE nth IS NOT NULL""",
    "section_deeper": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
body AS (SELECT doc_id, line_no, length(line) % 7 AS level, CASE WHEN length(line) < 60 THEN '' ELSE line END AS body FROM lines),
ended AS (SELECT a.doc_id, a.line_no, a.level, a.body, min(b.line_no) AS next
          FROM body AS a LEFT JOIN body AS b ON a.doc_id = b.doc_id AND b.line_no > a.line_no AND b.line_no < a.line_no + 60 AND b.level BETWEEN 1 AND a.level
          GROUP BY ALL),
told AS (SELECT e.doc_id, e.line_no, e.level, string_agg(c.body, chr(10) ORDER BY c.line_no) AS context
         FROM ended AS e JOIN body AS c ON e.doc_id = c.doc_id AND c.line_no >= e.line_no
          AND c.line_no < CASE WHEN e.level > 0 AND trim(e.body) = '' THEN coalesce(e.next, e.line_no + 60) ELSE e.line_no + 1 END
         GROUP BY e.doc_id, e.line_no, e.level)
SELECT doc_id, line_no::BIGINT AS line_no, level::INT AS level, md5(context) AS context_md5 FROM told""",
    "section_neighbors": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no::BIGINT AS line_no,
       (sum(length(line)) OVER near + count(*) OVER near - 1)::BIGINT AS context_chars
FROM lines WINDOW near AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
}
