import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import mixing, tokens
from lectern.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Documents before each stage, and the last result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), "stage"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "hilbert_packing"]
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    letters = {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
    assert set(after) == letters and all(after[i] == before[i] for i in after)


def test_language_stage_rejects(spark, odd):
    kept = corpus_pipeline.language_id(spark, odd, "")
    assert {11, 3, 4, 5}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns == odd.columns


def test_exact_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    best = {}
    for i, r in before.items():
        digest = hashlib.sha256(r.text.encode()).digest()
        best[digest] = max(best.get(digest, i), i)
    assert set(after) == set(best.values())


def test_near_stage(spark, stages):
    """All pairs by brute force: what is alike in 0.8 of five-word shingles becomes one, and
    what goes has a partner that is."""
    before, after = rows(stages[2]), rows(stages[3])
    shingles = {}
    for i, r in before.items():
        words = r.text.encode().lower().split()
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    alike = lambda a, b: len(a & b) / len(a | b)
    ids = sorted(before)
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if alike(shingles[a], shingles[b]) >= 0.8]
    linked = {i for p in links for i in p}
    assert set(before) - set(after) <= linked
    assert sum(a in after and b in after for a, b in links) <= 0.1 * len(links)


def test_mixing_stage(stages):
    before = stages[3].collect()
    word = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])
    sizes, taken, had, got = Counter(), Counter(), {r.doc_id: word(r.text) for r in before}, Counter()
    for r in before:
        sizes[r.source] += word(r.text)
    for r in stages[4].collect():
        taken[r.source] += word(r.text)
        got[r.doc_id] += word(r.text)
    target = {r.source: r.target for r in mixing.mixing_plan(stages[3]).select("source", "target").distinct().collect()}
    assert abs(sum(taken.values()) - sum(sizes.values())) <= mixing.BLOCK_WORDS * len(sizes)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    assert all(got[i] <= 3 * had[i] for i in got)


def test_mixed_texts_are_spans_of_their_documents(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = stages[4].collect()
    assert all(r.text.strip() and r.text.strip() in before[r.doc_id] for r in after)
    cut = Counter(r.source for r in after if r.text != before[r.doc_id])
    assert all(n <= 3 for n in cut.values())  # of a source, what the ends of its last range meet
    assert sum(cut.values()) < len(after) // 4


def test_packing_stage(stages):
    path = tokens.vocabulary()
    want = Counter()
    for r in stages[4].collect():
        want[(r.doc_id, len(tokens.token_ids(r.text, path)))] += 1
    got, fill = Counter(), Counter()
    for r in stages[5].withColumn("crc", F.crc32("ids")).collect():
        assert zlib.crc32(bytes(r.ids)) == r.crc and len(r.ids) == 4 * r.length
        got[(r.doc_id, r.doc_tokens)] += r.length
        fill[r.sequence_id] += r.length
    assert got == Counter({(i, n): n * times for (i, n), times in want.items()})
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_run_gives_the_last_stage(spark, sf, stages):
    pick = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "sequence_id", "offset").collect())
    assert pick(corpus_pipeline.run(spark, sf)) == pick(stages[-1])


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_odd_and_empty_tables(spark, request, table):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, docs.count()
        docs = materialize(stage(spark, docs, ""), "stage")
        if name != "hilbert_packing":
            assert docs.columns == columns
        if name in ("language_id", "exact_dedup", "simhash_near_dedup"):
            assert docs.count() <= before
        assert (docs.count() > 0) == (table == "odd")


def test_language_stage_takes_the_wanted(spark):
    rows = [(i, "der hund und die katze sind im haus", "de", "a", 1) for i in range(8)] + [(10 + i, "the dog and the cat are in the house", "en", "a", 1) for i in range(8)]
    docs = spark.createDataFrame([*rows, (30, "the cat and the dog", None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.language_id(spark, docs, "", wanted=("en",)).collect()
    assert {r.doc_id for r in kept} == {*range(10, 18), 30} and {r.lang for r in kept} == {"en"}
