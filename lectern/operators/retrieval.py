"""Ranked retrieval: fielded BM25, AND and OR strategies, reciprocal-rank fusion, caps.

A query's terms are counted where the text is scanned, so a document is one narrow row
and no postings are exploded; the corpus statistics (number of documents, mean length,
document frequencies) are one row of sums over the same rows, taken before any filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import query_terms, tokens
from lectern.storage import materialize

K1, B = 1.2, 0.75
TITLE_WEIGHT = 3.0
LEAST_IDF = 1e-6
RRF = 60
SOME_WEIGHT = 0.35  # of a hit that holds some of the terms only


def occurrences(words: Column, term: str) -> Column:
    """How often a term, a phrase of several words, or words that begin as ``term*``, stand in
    an array of tokens."""
    parts = term.split(" ")
    if term.endswith("*"):
        return F.size(F.filter(words, lambda w: w.startswith(term[:-1])))
    if len(parts) == 1:
        return F.size(F.filter(words, lambda w: w == term))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - len(parts) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(words, i, len(parts)) == F.array(*map(F.lit, parts))))


def term_counts(docs: DataFrame, key: Sequence[str], terms: Sequence[str], title: str | None = "title", text: str = "text", prefix: bool = False) -> DataFrame:
    """``key..., size, weights array<double>, held array<boolean>`` per document.

    ``weights`` is the fielded frequency of each term: the text counts once, the title
    ``TITLE_WEIGHT`` times.  With ``prefix`` a term is the beginning of a word.  The rows
    are written, so statistics and scores read numbers and no text.
    """
    def count(words: Column, term: str) -> Column:
        return F.size(F.filter(words, lambda w: w.startswith(term))) if prefix else occurrences(words, term)

    def counted(own: Column) -> Column:
        weights = ((count(own["text"], t) + TITLE_WEIGHT * count(own["title"], t)).cast("double") for t in terms)
        return F.struct((F.size(own["text"]) + F.size(own["title"])).alias("size"), F.array(*weights).alias("weights"))

    head = tokens(F.col(title)) if title else F.array().cast("array<string>")
    words = F.array(F.struct(tokens(F.col(text)).alias("text"), head.alias("title")))  # bound once: each text is cut into words once
    narrow = docs.select(*key, F.transform(words, counted)[0].alias("__counts")).select(*key, "__counts.*")
    return materialize(narrow, "counts")


def corpus_statistics(counted: DataFrame, terms: int) -> DataFrame:
    """One row: ``n``, ``mean_size`` and ``frequencies`` (documents that hold each term)."""
    return counted.agg(
        F.count("*").alias("n"),
        F.avg("size").alias("mean_size"),
        F.array(*(F.count_if(F.col("weights")[i] > 0) for i in range(terms))).alias("frequencies"),
    )


def _score(picks: Sequence[int]) -> Column:
    """BM25 of the terms at ``picks``, over a counted row joined to the statistics."""
    norm = K1 * (1 - B + B * F.col("size") / F.col("mean_size"))

    def part(i: int) -> Column:
        seen, f = F.col("frequencies")[i], F.col("weights")[i]
        idf = F.log((F.col("n") - seen + 0.5) / (seen + 0.5))
        return F.when(f > 0, F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + norm)).otherwise(0.0)

    return sum((part(i) for i in picks), F.lit(0.0))


def _held(picks: Sequence[int]) -> Column:
    return F.size(F.filter(F.array(*(F.col("weights")[i] for i in picks)), lambda w: w > 0))


def bm25(counted: DataFrame, statistics: DataFrame, terms: int) -> DataFrame:
    """Rows that hold any term, with ``score`` (higher is better) and the number ``held``."""
    joined = counted.where(F.exists("weights", lambda w: w > 0)).crossJoin(F.broadcast(statistics))  # statistics: one row
    scored = joined.withColumns({"score": _score(range(terms)), "held": _held(range(terms))})
    return scored.drop("weights", "n", "mean_size", "frequencies", "size")


def search(
    docs: DataFrame, key: str, queries: Sequence[Sequence[str]], title: str | None = "title", text: str = "text",
    where: Column | None = None, candidates: int = 160,
) -> DataFrame:
    """Fused hits ``(key, fused, complete, queries array<int>)`` of several queries.

    Each query ranks the documents that hold all its terms, and those that hold any; a
    hit earns ``1 / (RRF + rank)`` from the first list, or ``SOME_WEIGHT`` of that from the
    second if the first does not have it.  ``where`` filters hits on columns of ``docs``
    and leaves the statistics alone.  All queries are counted in one pass.
    """
    terms = list(dict.fromkeys(t for q in queries for t in q))
    counted = term_counts(docs.withColumn("__in", F.lit(True) if where is None else where), [key, "__in"], terms, title, text)
    return fused(counted.where("__in"), corpus_statistics(counted, len(terms)), key, queries, terms, candidates)


def fused(counted: DataFrame, statistics: DataFrame, key: str, queries: Sequence[Sequence[str]], terms: Sequence[str], candidates: int = 160) -> DataFrame:
    """``search`` over rows that are counted: ``(key, size, weights)``, a weight for each of ``terms``."""
    picks = [[terms.index(t) for t in q] for q in queries]
    rows = counted.where(F.exists("weights", lambda w: w > 0)).crossJoin(F.broadcast(statistics))  # one row
    each = F.array(*(
        F.struct(F.lit(n).alias("query"), _score(own).alias("score"), _held(own).alias("held"), F.lit(len(own)).alias("of"))
        for n, own in enumerate(picks)
    ))
    hits = rows.select(key, F.explode(each).alias("hit")).select(key, "hit.*").where("held > 0")
    lists = hits.withColumn("strict", F.explode(F.array(F.lit(True), F.lit(False)))).where("held = of or not strict")
    place = F.row_number().over(W.partitionBy("query", "strict").orderBy(F.desc("score"), key))
    ranked = lists.withColumn("place", place).where(F.col("place") <= candidates)
    kept = ranked.withColumn("best", F.max("strict").over(W.partitionBy(key, "query"))).where("strict = best")
    weight = F.when(F.col("strict"), 1.0).otherwise(SOME_WEIGHT) / (RRF + F.col("place"))
    return kept.groupBy(key).agg(
        F.sum(weight).alias("fused"), F.max("strict").alias("complete"), F.sort_array(F.collect_set("query")).alias("queries")
    )


MOST_ALTERNATES, MOST_CHARACTERS = 4, 512


def bounded_queries(query: str, alternates: Sequence[str] = (), limit: int = 1) -> list[list[str]]:
    """Term lists of a query and its alternates for ``search``.

    At most ``MOST_ALTERNATES`` alternates, each not blank and of at most
    ``MOST_CHARACTERS`` characters, are allowed.  Queries with the same terms in any order
    and case are one; a limit of zero or less asks for nothing.
    """
    if len(alternates) > MOST_ALTERNATES:
        raise ValueError(f"at most {MOST_ALTERNATES} alternate queries")
    if any(not a.strip() or len(a) > MOST_CHARACTERS for a in alternates):
        raise ValueError(f"alternate queries have 1 to {MOST_CHARACTERS} characters")
    if limit <= 0:
        return []
    found = (query_terms(q) for q in (query, *alternates))
    return list({tuple(sorted(t.casefold() for t in terms)): terms for terms in reversed([f for f in found if f])}.values())[::-1]


def recheck(hits: DataFrame, current: DataFrame, key: str, terms: Sequence[str], text: str = "text") -> DataFrame:
    """``hits`` (``key, digest, complete``) held against the ``current`` texts before they are
    ranked: a hit whose text is as it was stays, one that changed is counted anew and may
    become partial, and one without any of the terms, or without a text, goes."""
    now = current.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("__now"), tokens(F.col(text)).alias("__words"))
    joined = hits.join(now, key)
    held = F.size(F.filter(F.array(*(occurrences(F.col("__words"), t) for t in terms)), lambda n: n > 0))
    same = F.col("digest") == F.col("__now")
    checked = joined.withColumn("__held", F.when(same, F.lit(len(terms))).otherwise(held)).where("__held > 0")
    complete = F.when(same, F.col("complete")).otherwise(F.col("__held") == len(terms))
    return checked.withColumn("complete", complete).drop("__now", "__words", "__held")


def capped(hits: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` hits of each group, best first."""
    return hits.withColumn("__place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__place") <= most).drop("__place")


def availability(hits: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """``hits`` with ``availability``: that of their record, or current without one."""
    return hits.join(records, key, "left").withColumn("availability", F.coalesce("availability", F.lit("current")))


def neighbours(sections: DataFrame, document: str, order: str, text: str, around: int) -> DataFrame:
    """Each section with the texts of the ``around`` sections before and after it."""
    frame = W.partitionBy(document).orderBy(order).rowsBetween(-around, around)
    return sections.withColumn("context", F.concat_ws("\n", F.collect_list(text).over(frame)))


MOST_DEEPER, LEVELS = 60, 6  # sections that a heading can bring along, itself included; levels of headings


def with_deeper(sections: DataFrame, document: str, order: str, level: str, text: str, most: int = MOST_DEEPER, levels: int = LEVELS) -> DataFrame:
    """Each section with ``context``: for one without text, the texts of the sections below it,
    up to the next of its own or a higher level, itself and ``most - 1`` others at most; for
    others, its own text.

    ``level`` is 1 for the highest; null or 0 is no heading, which has its own text only and
    ends no other's.  A section looks at ``most - 1`` others whatever its document's length.
    """
    ordered = W.partitionBy(document).orderBy(order)
    after = ordered.rowsBetween(1, most - 1)
    rows = sections.withColumn("__at", F.row_number().over(ordered))
    # where the next heading of each level or a higher one stands, and of these the own level's
    ends = F.array(*(F.min(F.when(F.col(level).between(1, n), F.col("__at"))).over(after) for n in range(1, levels + 1)))
    marked = rows.withColumns({"__ends": ends, "__texts": F.collect_list(F.coalesce(text, F.lit(""))).over(ordered.rowsBetween(0, most - 1))})
    end = F.get("__ends", F.least(F.col(level), F.lit(levels)) - 1)
    count = F.coalesce(end - F.col("__at"), F.size("__texts"))
    empty = (F.col(level) > 0) & (F.trim(F.coalesce(text, F.lit(""))) == "")
    own = F.slice("__texts", F.lit(1), F.when(empty, count).otherwise(1))
    return marked.withColumn("context", F.concat_ws("\n", own)).drop("__at", "__ends", "__texts")
