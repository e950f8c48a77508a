import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import query_terms
from lectern.operators import records, retrieval
from lectern.operators.index import InvertedIndex
from lectern.plans import retrieval as plans
from lectern.storage import fresh_path

WORDS = "bond price yield curve bonded the a duration convexity".split()


def some(rng, keys):
    return [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 3))), " ".join(rng.choices(WORDS, k=rng.randint(0, 12))), rng.choice(["s1", "s2", None])) for k in keys]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, title string, text string, stamp string")


def built(spark, rows):
    index = InvertedIndex(spark, fresh_path(spark, "index"), "string", buckets=4)
    index.build(frame(spark, rows), "path", F.col("stamp"))
    return index


def content(index):
    postings = index._living(index.postings()).select("term", "key", "size", "at", "head").collect()
    sizes = index.documents().select("key", "size", "stamp").collect()
    return sorted(map(tuple, postings)), sorted(map(tuple, sizes), key=repr), tuple(index.statistics().first())


@pytest.fixture(scope="module")
def rows():
    return [*some(random.Random(1), [f"d{i}" for i in range(40)]), ("nothing", None, None, None), ("blank", "", " - ", "s1")]


def test_lookup_counts_as_the_scan_does(spark, rows):
    terms = ["bond", "the", "price yield", "bond*", "none", "bond bond", "a du*"]
    index, docs = built(spark, rows), frame(spark, rows)
    counted = retrieval.term_counts(docs, ["path"], terms[:-1])
    found = index.lookup(terms)
    want = {r.path: (r.size, list(r.weights)) for r in counted.collect()}
    got = {r.key: (r.size, list(r.weights)[:-1]) for r in found.collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(not any(v[1]) for k, v in want.items() if k not in got)
    stats = index.corpus(found, len(terms)).first()
    assert (stats.n, round(stats.mean_size, 9), list(stats.frequencies)[:-1]) == tuple(
        round(v, 9) if isinstance(v, float) else v for v in retrieval.corpus_statistics(counted, len(terms) - 1).first()
    )
    plain = {k: f"{t or ''}|{x or ''}".split("|") for k, t, x, _ in rows}
    begun = {k: sum((3 if part == 0 else 1) * sum(a == "a" and b.startswith("du") for a, b in zip(own.split(), own.split()[1:], strict=False)) for part, own in enumerate(parts)) for k, parts in plain.items()}
    assert {r.key: r.weights[-1] for r in found.collect() if r.weights[-1]} == {k: n for k, n in begun.items() if n}


def test_a_change_gives_what_a_new_index_gives(spark, rows):
    rng = random.Random(2)
    index, now = built(spark, rows), rows
    for step in range(3):
        kept = [r for r in now if rng.random() > 0.2]
        changed = {r[0] for r in kept if rng.random() < 0.3}
        texts = dict((r[0], r) for r in some(rng, changed))
        new = [r if r[0] not in changed else (*texts[r[0]][:3], {"s1": "s2", "s2": None, None: "s1"}[r[3]]) for r in kept]
        new += some(rng, [f"new{step}-{i}" for i in range(5)])
        counts = index.update(frame(spark, new), "path", F.col("stamp"))
        assert counts == {"added": 5, "updated": len(changed), "removed": len(now) - len(kept)}
        assert content(index) == content(built(spark, new))
        assert index.update(frame(spark, new), "path", F.col("stamp")) == {"added": 0, "updated": 0, "removed": 0}  # null stamps are stamps
        now = new
    dead = index.postings().count()
    index.compact([0, 1])
    assert content(index) == content(built(spark, now)) and index.postings().count() < dead
    index.compact()
    assert index.postings().count() == len(content(index)[0])
    assert {r.term for r in index.words_from(["bond"]).collect()} <= {"bond", "bonded"}


def test_all_documents_can_go_and_come_back(spark, rows):
    index = built(spark, rows)
    assert index.update(frame(spark, rows).limit(0), "path", F.col("stamp"))["removed"] == len(rows)
    assert index.lookup(["bond"]).count() == 0 and index.statistics().first().n == 0
    assert index.update(frame(spark, rows), "path", F.col("stamp"))["added"] == len(rows)
    assert content(index) == content(built(spark, rows))


def test_a_query_reads_its_buckets_and_no_text(spark, sf):
    plans.stored_index(spark, sf)
    plan = plans.doc_bm25_and(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "documents.parquet" not in plan
    assert "term IN" in plan or "In(term" in plan


def test_many_queries_at_once_rank_as_one_by_one(spark, rows):
    index = built(spark, rows)
    asked = spark.createDataFrame([("q1", "bond"), ("q1", "yield"), ("q1", "yield"), ("q2", "the"), ("q3", "none"), ("q3", None)], "q string, term string")
    got = index.ranked(asked, "q")
    for query, terms in (("q1", ["bond", "yield"]), ("q2", ["the"])):
        found = index.lookup(terms)
        one = retrieval.bm25(found, index.corpus(found, len(terms)), len(terms)).orderBy(F.desc(F.round("score", 9)), "key").collect()
        own = got.where(F.col("q") == query).orderBy("place").collect()
        assert [(r.key, r.held) for r in own] == [(r.key, r.held) for r in one]
        assert all(abs(a.score - b.score) < 1e-8 for a, b in zip(own, one, strict=True))
    assert got.where("q = 'q3'").count() == 0


def test_ranked_keeps_the_best_and_the_best_complete_ones(spark, rows):
    index = built(spark, rows)
    asked = spark.createDataFrame([("q1", "bond"), ("q1", "yield"), ("q2", "the"), ("q3", "none"), ("q4", "a"), ("q4", "none")], "q string, term string")
    every = [tuple(r) for r in index.ranked(asked, "q").collect()]
    for most in (1, 3):
        kept = [tuple(r) for r in index.ranked(asked, "q", most=most).collect()]
        assert {r for r in kept if r[-1] <= most} == {r for r in every if r[-1] <= most}
        assert {r[0] for r in kept if r[3] == r[4]} == {r[0] for r in every if r[3] == r[4]}
        assert {r[:-1] for r in kept} <= {r[:-1] for r in every} and len(kept) <= 4 * 2 * most


def test_passages_of_all_lengths_are_found_without_dealing_texts(spark, tmp_path):
    docs = [(1, "a b c d e f g h"), (2, "xa b  c\td e f gx"), (3, "b"), (4, ""), (5, None), (6, "a b c a b c"), (7, "c d e f")]
    items = [(0, "a b c d e f g"), (1, "b"), (2, ""), (3, "a b"), (4, "a b c"), (5, "c d e f"), (6, None), (7, "a b c a b c"), (8, "b c d e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = plans._passages(spark, str(tmp_path))
    flat = {d: " ".join((t or "").split()) for d, t in docs}
    assert {tuple(r) for r in found.collect()} == {(i, d) for i, p in items if p is not None for d, t in flat.items() if p in t}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "met-" in "".join(found.inputFiles()) and "Generate explode" not in plan


def test_terms_of_a_query_keep_their_star():
    assert query_terms('show me "bond Price" of conv* the') == ["bond price", "conv*"]


def test_files_with_null_stamps_stay(spark):
    old = spark.createDataFrame([("a", None, "chunk a"), ("b", "1", "chunk b")], "path string, stamp string, chunk string")
    files = spark.createDataFrame([("a", None), ("b", "1"), ("c", None)], "path string, stamp string")
    got = records.incremental_index(old, files, "path", "stamp", lambda f: f.withColumn("chunk", F.lit("new")))
    assert sorted((r.path, r.chunk) for r in got.collect()) == [("a", "chunk a"), ("b", "chunk b"), ("c", "new")]


def test_a_heading_without_text_brings_what_is_below(spark):
    rows = [("d", 0, 1, ""), ("d", 1, 2, " "), ("d", 2, 3, "a"), ("d", 3, 0, "b"), ("d", 4, 2, "c"), ("d", 5, 1, "e"), ("d", 6, 9, ""), ("d", 7, None, "f"), ("e", 0, 2, "")]
    got = retrieval.with_deeper(spark.createDataFrame(rows, "doc string, n int, level int, body string"), "doc", "n", "level", "body")
    assert {(r.doc, r.n): r.context for r in got.collect()} == {
        ("d", 0): "\n \na\nb\nc", ("d", 1): " \na\nb", ("d", 2): "a", ("d", 3): "b", ("d", 4): "c", ("d", 5): "e", ("d", 6): "\nf", ("d", 7): "f", ("e", 0): "",
    }
    short = retrieval.with_deeper(spark.createDataFrame(rows, "doc string, n int, level int, body string"), "doc", "n", "level", "body", most=2)
    assert short.where("doc = 'd' and n = 0").first().context == "\n "


def test_an_index_without_changes_joins_no_tombstones_and_large_ones_have_more_files(spark, rows):
    index = built(spark, rows)
    assert "Join" not in index._living(index.postings())._jdf.queryExecution().toString()
    assert index._slices(0) == 4 and index._slices(6 * 10**9) >= 60  # a file's postings are sorted in memory


def test_postings_are_shuffled_as_batches_of_many(spark):
    docs = spark.range(300).selectExpr("concat('k', id) AS path", "'the bond' AS title", "concat('the the price ', id) AS text", "'s' AS stamp")
    index = InvertedIndex(spark, fresh_path(spark, "index"), "string", buckets=4)
    index.build(docs, "path", F.col("stamp"))
    found = {(r.term, r.key): (r.size, r["at"], r["head"]) for r in index.postings().collect()}
    assert len(found) == 300 * 4 and found["the", "k7"] == (6, [0, 1], [0]) and found["bond", "k7"] == (6, [], [1]) and found["7", "k7"] == (6, [3], [])
    # as it is shuffled: batches of a part, not a row for each word of a text
    shuffled = index._posted(index._named(docs, "path", F.col("stamp"), "title", "text"), 0, 4, False)._jdf.queryExecution().toString()
    assert "rows#" in shuffled and "posexplode" not in shuffled and "collect_list" not in shuffled


def test_texts_of_one_key_are_one_document(spark):
    index = built(spark, [("k", "bond", "price price", "s1"), ("k", None, "price yield", "s1"), ("m", "the", "yield", "s2")])
    found = {(r.term, r.key): (sorted(r["at"]), sorted(r["head"])) for r in index.postings().collect()}
    assert found == {("bond", "k"): ([], [0]), ("price", "k"): ([0, 0, 1], []), ("yield", "k"): ([1], []), ("the", "m"): ([], [0]), ("yield", "m"): ([0], [])}
    assert index.statistics().first()["n"] == 3


def test_packed_postings_come_back_part_by_part(monkeypatch):
    import pyarrow as pa

    from lectern.operators import index as stored

    monkeypatch.setattr(stored, "BLOCK_POSTINGS", 5)
    rows = [{"part": i * 7 % 3, "term": f"w{i // 2}", "key": None if i == 4 else i, "at": [i] * (i % 3), "head": []} for i in range(14)]
    kind = pa.schema([("part", pa.int32()), ("term", pa.string()), ("key", pa.int64()), ("at", pa.list_(pa.int32())), ("head", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 3], kind) for i in range(0, 14, 3)] + [pa.RecordBatch.from_pylist([], kind)]
    sent = list(stored._resent(iter(batches)))
    assert len(sent) == 3 and all(len(set(b.column(0).to_pylist())) == b.num_rows <= 3 for b in sent)
    got = {p: [r for b in sent for q in range(b.num_rows) if b.column(0)[q].as_py() == p for d in stored._dealt([b.slice(q, 1)]) for r in d.to_pylist()] for p in range(3)}
    assert got == {p: [{k: v for k, v in r.items() if k != "part"} for r in rows if r["part"] == p] for p in range(3)}
