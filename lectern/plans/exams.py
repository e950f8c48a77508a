"""Queries of mining, questions and outlines over ``documents``, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import predicates
from lectern.operators import mining, practice, questions, sections
from lectern.plans.tables import table

KINDS = ("transcript", "announcement", "discussion", "slides", "pdf", "quiz", "page", "handout")
# words of the texts, and what an instructor says in their place
SPOKEN = ((" that ", " the exam "), (" with ", " make sure you know "), (" from ", " the final results "), (" les ", " our final "), (" mit ", " be comprehensive "))
REPLIES = "\n## Replies\n- **A** (Instructor)\n  the midterm is near\n- **B**\n  is it a quiz\n"
PLAN_MOST = 25


def _spoken(text: Column) -> Column:
    for word, said in SPOKEN:
        text = F.replace(text, F.lit(word), F.lit(said))
    return text


def exam_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as eight kinds of a source's course, some words of them as an instructor's, for
    the hints that a report of each course shows."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    thread = F.concat(F.lit("# Prompt\n"), _spoken(F.col("text")), F.lit(REPLIES))
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("course"), F.col("doc_id").alias("path"), kind.alias("kind"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string").alias("date"),
        F.when(kind == "discussion", thread).otherwise(_spoken(F.col("text"))).alias("text"), (F.col("doc_id") % 3 > 0).alias("trusted"),
    )
    shown = mining.shown_hints(mining.exam_hints(rows))
    fold = F.sha2("excerpt", 256).alias("excerpt")
    return shown.select("course", "bucket", "place", "path", F.col("sec_no").cast("int").alias("sec_no"), F.col("ord").cast("int").alias("ord"), fold, "weight", "found")


def saved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question on each document, in batches of one source, some of them wrong in some way."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    n, words = F.col("doc_id"), F.slice(F.split(F.col("text"), " "), 1, 4)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    quote = F.concat(F.substring(flat, 1, 60), F.when(n % 11 == 0, "§§").otherwise(""))
    rows = docs.select(
        n.alias("question"), F.floor(n / 4).alias("batch"), F.coalesce("source", F.lit("")).alias("plan"),
        F.when(n % 23 == 0, "essay").when(n % 2 == 0, "mcq").otherwise("short_answer").alias("kind"),
        F.when(n % 37 == 0, " ").otherwise(F.coalesce("source", F.lit("none"))).alias("topic"), F.concat(F.lit("What follows "), F.md5("text"), F.lit("?")).alias("prompt"),
        F.element_at(F.array(*map(F.lit, "ABCDE")), (n % 5 + 1).cast("int")).alias("answer"), F.lit("It is written there.").alias("explanation"),
        F.when(n % 41 == 0, "hard").otherwise("recall").alias("difficulty"), words.alias("choices"), (n % 5).cast("int").alias("correct"),
    )
    cited = docs.select(n.alias("question"), n.alias("path"), quote.alias("quote"))
    sources = docs.select(n.alias("path"), "text", (~F.coalesce(F.col("lang") == "fr", F.lit(False))).alias("in_scope"), (F.coalesce("quality", F.lit(1)) == 1).alias("current"))
    found = questions.validated(rows, cited, sources).withColumn("key", F.md5("prompt")).withColumn("size", F.octet_length("prompt"))
    known = found.where("question % 13 = 0").select("plan", "key")
    return questions.saved(found, known, most=3 + 1, plan_most=PLAN_MOST).select("question", "batch", "plan", "state")


def outline_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as outlines, every third line of which begins a module, for module 1."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("## Module 0"), F.floor(i / 3).cast("string"), F.lit(": "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(sections.outline_slice(F.array_join(marked, "\n"), 1), 256).alias("part"))


QUERIES = {f.__name__: f for f in (exam_hints, saved_questions, outline_modules)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(column: str) -> str:
    for word, said in SPOKEN:
        column = f"replace({column}, {_quoted(word)}, {_quoted(said)})"
    return column


# RE2 looks neither ahead nor behind: "final" and the like before a word that means no exam
# are written otherwise first, at the same length, and the pattern is used without its looks ahead.
_BARE = predicates.EXAM_WORDS.replace(rf"(?!\s+(?:{predicates.NOT_AN_EXAM})\b)", "").replace(r"(?!\s+of\b)", "").replace(r"(?!\s+(?:income|review of the literature))", "")
_NEAR = (
    rf"(?i)(\b(?:the|our|your|this|next|upcoming|each) f)i(nal\s+(?:{predicates.NOT_AN_EXAM})\b)",
    rf"(?i)(\b(?:the|next|this|upcoming|our|in-class|unit|first|second|third) t)e(st\s+(?:{predicates.NOT_AN_EXAM})\b)",
    r"(?i)(\bexam)i(nations?\s+of\b)",
    r"(?i)(\b(?:is|are|will be|be)\s+(?:cumulativ|comprehensiv))e(\s+(?:income|review of the literature))",
)
_OTHER = "sentence"
for _pattern in _NEAR:
    _OTHER = rf"regexp_replace({_OTHER}, {_quoted(_pattern)}, '\1~\2', 'g')"
_AT = lambda text, pattern: f"CASE WHEN regexp_matches({text}, {_quoted('(?i)' + pattern)}) THEN length(regexp_extract({text}, {_quoted('(?is)^(.*?)' + pattern)}, 1)) + 1 ELSE 0 END"
_PROMPTS = f"""SELECT source, doc_id, 'discussion' AS bucket, 1 AS sec_no, {_said('text')} AS t FROM documents WHERE doc_id % 8 = 2 AND doc_id % 3 > 0
    UNION ALL SELECT source, doc_id, 'discussion', 2, '- **A** (Instructor)' || chr(10) || 'the midterm is near' FROM documents WHERE doc_id % 8 = 2 AND text IS NOT NULL"""

ORACLES = {
    "exam_hints": rf"""
WITH d AS (
    SELECT source, doc_id, ['transcript','announcement','discussion','slides','pdf','assignment','page','other'][doc_id % 8 + 1] AS bucket, 0 AS sec_no, {_said('text')} AS t
    FROM documents WHERE doc_id % 8 <> 2 UNION ALL {_PROMPTS}),
p AS (SELECT coalesce(source, '') AS course, doc_id AS path, bucket, sec_no, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(t,
    '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(30) || '\2', 'g'), '\n\s*[-*•]\s+', chr(30), 'g'), '\n{{2,}}', chr(30), 'g'), chr(30)), lambda x: trim(x) <> '') AS parts FROM d),
u AS (SELECT course, path, bucket, sec_no, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS ord FROM p),
s AS (SELECT * EXCLUDE raw, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' -*•>') AS sentence FROM u),
n AS (SELECT *, {_OTHER} AS other FROM s WHERE length(sentence) >= 12),
m AS (SELECT *, {_AT('other', _BARE)} AS told, {_AT('sentence', predicates.EMPHASIS)} AS stressed FROM n),
h AS (SELECT *, CASE WHEN told > 0 THEN told ELSE stressed END AS spot, CASE WHEN told > 0 AND stressed > 0 THEN 2 ELSE 1 END AS weight FROM m
      WHERE told > 0 OR (stressed > 0 AND bucket IN ('transcript','announcement','syllabus','page','discussion'))),
w AS (SELECT *, greatest(1, spot - 160) AS lo, least(length(sentence), greatest(1, spot - 160) + 319) AS hi FROM h),
e AS (SELECT *, CASE WHEN length(sentence) <= 320 THEN sentence ELSE CASE WHEN lo > 1 THEN '…' ELSE '' END || trim(substr(sentence, lo, hi - lo + 1))
      || CASE WHEN hi < length(sentence) THEN '…' ELSE '' END END AS excerpt FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY course, trim(regexp_replace(lower(excerpt), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) ORDER BY path, sec_no, ord) AS nth_text FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY course, bucket) AS found, CASE WHEN bucket = 'announcement' THEN path % 28 END AS recent FROM o WHERE nth_text = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY course, bucket ORDER BY recent DESC NULLS LAST, CASE WHEN bucket <> 'announcement' THEN weight END DESC NULLS LAST, path, sec_no, ord) AS nth FROM r)
SELECT course, bucket, row_number() OVER (PARTITION BY course, bucket ORDER BY recent DESC NULLS LAST, path, sec_no, ord)::INT AS place, path, sec_no::INT AS sec_no,
       ord::INT AS ord, sha256(excerpt) AS excerpt, weight::INT AS weight, found FROM k WHERE nth <= 150""",
    "saved_questions": rf"""
WITH d AS (SELECT doc_id AS n, coalesce(source, '') AS plan, source, lang, coalesce(text, '') AS t, coalesce(quality, 1) AS quality FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS flat, list_slice(string_split(t, ' '), 1, 4) AS choices FROM d),
c AS (SELECT *, list_transform(choices, lambda x: lower(trim(x))) AS folded, substr(flat, 1, 60) || CASE WHEN n % 11 = 0 THEN '§§' ELSE '' END AS quote FROM f),
q AS (SELECT *, regexp_replace(lower(trim(quote)), '\*\*|__|`', '', 'g') AS said, CASE WHEN n % 23 = 0 THEN 'kind' WHEN n % 37 = 0 OR trim(source) = '' THEN 'topic' WHEN n % 41 = 0 THEN 'difficulty'
    WHEN n % 2 = 0 AND (len(choices) < 2 OR n % 5 >= len(choices)) THEN 'choices'
    WHEN n % 2 = 0 AND len(list_filter(choices, lambda x: trim(x) = '' OR length(x) > 2000)) > 0 THEN 'choice'
    WHEN n % 2 = 0 AND len(list_distinct(folded)) < len(folded) THEN 'choices_not_distinct' END AS form FROM c),
v AS (SELECT n, n // 4 AS batch, plan, md5('What follows ' || md5(t) || '?') AS key, coalesce(form,
    CASE WHEN length(regexp_replace(said, '[^\p{{L}}\p{{N}}]', '', 'g')) < 2 OR NOT contains(regexp_replace(lower(flat), '\*\*|__|`', '', 'g'), said) THEN 'evidence'
         WHEN lang = 'fr' THEN 'outside_scope' WHEN quality <> 1 THEN 'outdated_source' END) AS error FROM q),
g AS (SELECT *, coalesce(error, CASE WHEN count(*) OVER (PARTITION BY batch) > 4 THEN 'batch_too_large' WHEN count(error) OVER (PARTITION BY batch) > 0 THEN 'batch_refused' END) AS refused FROM v),
held AS (SELECT DISTINCT plan, key FROM v WHERE n % 13 = 0),
x AS (SELECT *, refused IS NULL AND (plan, key) NOT IN (SELECT (plan, key) FROM held) AND row_number() OVER (PARTITION BY plan, key ORDER BY refused IS NOT NULL, batch, n) = 1 AS fresh FROM g),
b AS (SELECT plan, batch, sum(count(*) FILTER (fresh)) OVER (PARTITION BY plan ORDER BY batch) AS grown FROM x GROUP BY plan, batch),
y AS (SELECT b.plan, batch, grown + coalesce(had, 0) > {PLAN_MOST} AS too_many FROM b LEFT JOIN (SELECT plan, count(*) AS had FROM held GROUP BY plan) h ON b.plan = h.plan)
SELECT n AS question, batch, x.plan, coalesce(refused, CASE WHEN too_many THEN 'plan_full' END, CASE WHEN fresh THEN 'added' ELSE 'duplicate' END) AS state
FROM x JOIN y USING (plan, batch)""",
    "outline_modules": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
m AS (SELECT doc_id, array_to_string(list_transform(x, lambda s, i: CASE WHEN (i - 1) % 3 = 2 THEN '## Module 0' || ((i - 1) // 3) || ': ' || s ELSE s END), chr(10)) AS t FROM l),
p AS (SELECT doc_id, string_split(chr(10) || t, chr(10) || '## ') AS parts FROM m),
f AS (SELECT doc_id, parts[1] AS head, list_filter(parts[2:], lambda s: regexp_matches(s, '^Module 0*1:'))[1] AS part FROM p)
SELECT doc_id, sha256(coalesce(regexp_replace(substr(head, 2) || chr(10) || '## ' || part, '^\s+|\s+$', '', 'g') || chr(10), '')) AS part FROM f""",
}
