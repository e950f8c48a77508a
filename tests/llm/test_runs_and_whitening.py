import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_runs, periodic_runs, queries, whitening
from lectern.storage import shared_dir

WORD = re.compile(periodic_runs.WORD)


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# periodic runs


def plain_runs(words, shortest=6, exponent=4):
    """Every stretch that agrees with itself ``p`` words on, of one stretch the smallest ``p``."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i - start + p >= max(shortest, exponent * p):
                found.setdefault((start, i - start + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_words(rng):
    kind, n = rng.random(), rng.randint(0, 60)
    if kind < 0.4:
        return rng.choices("abcd"[: rng.randint(1, 3)], k=n)
    if kind < 0.7:
        words = (rng.choices("abcd", k=rng.randint(1, 9)) * 60)[:n]
        if words:
            words[rng.randrange(n)] = "z"
        return words + words[: rng.randint(0, n)]
    half = [w for _ in range(6) for w in rng.choices("ab", k=rng.randint(1, 3)) * rng.randint(1, 6)]
    return half + [rng.choice("xy")] + half


@pytest.mark.parametrize(("shortest", "exponent"), [(6, 4), (2, 2), (5, 3)])
def test_runs_are_those_of_a_plain_search(shortest, exponent):
    rng = random.Random(shortest)
    for _ in range(400):
        texts = [odd_words(rng) for _ in range(rng.randint(1, 4))]
        for words, (n, runs, kept) in zip(texts, periodic_runs.runs_of([" ".join(t) for t in texts], shortest, exponent), strict=True):
            assert n == len(words)
            assert runs == sorted(runs, key=lambda r: (r[0], r[2]))
            assert sorted(runs) == plain_runs(words, shortest, exponent)
            assert kept == plain_kept(words, runs)


def test_runs_of_a_long_text_with_long_periods():
    words = ["x"] + [f"w{i}" for i in range(5000)] * 5 + ["y", "a", "a", "a", "a", "a", "a", "b"] * 2
    ((_, runs, kept),) = periodic_runs.runs_of([" ".join(words)])
    assert runs == [(1, 25_000, 5000), (25_002, 6, 1), (25_010, 6, 1)]
    assert kept == plain_kept(words, runs)


def test_fewer_than_two_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.arange(9), exponent=1)


def test_runs_query_against_a_plain_version(spark, sf):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d.doc_id]
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))))
        assert r.collapsed_sha256 == sha(plain_kept(words, runs))
        with_runs += bool(runs)
    assert with_runs > len(docs) // 20


def test_runs_of_odd_rows(spark, odd, empty):
    got = periodic_runs.periodic_runs(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        words = WORD.findall(r.doc.text or "")
        assert r.n_words == len(words) and r.doc.whole in ("w", "p", None)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(words)
    (long,) = {tuple(map(tuple, r.runs)) for r in got if r.doc.doc_id == 6}
    assert long == ((0, 200_000, 5),)
    assert periodic_runs.periodic_runs(empty).count() == 0


# line runs


def plain_lines(texts, at_least):
    def key(line):
        return line.strip(line_runs.BLANKS).translate(str.maketrans(line_runs._UPPER, line_runs._LOWER))

    held = Counter(k for t in texts for k in {key(line) for line in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [line for line in lines if held[key(line)] < at_least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_lines(rng, n):
    common = [f" Common line {i}\t" for i in range(12)]
    return ["\n".join(rng.choices([*common, "", "  ", "own line", "OWN LINE ", "É", "é"], k=rng.randint(0, 9)) + [f"line {rng.randint(0, n)}"]) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 6])
def test_lines_whatever_the_batches(spark, batches):
    rng = random.Random(batches)
    texts = [*some_lines(rng, 150), None, "", "\n", "\n\n", "Common line 1"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, n long")
    got = line_runs.drop_frequent_lines([docs.where(F.col("doc_id") % batches == b) for b in range(batches)]).orderBy("doc.doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.kept) for r in got] == plain_lines(texts, 10)
    assert sum(r.n_dropped for r in got) > 100


def test_runs_are_merged_by_level_and_settled_once(spark):
    store = line_runs.LineRuns(spark, at_least=3, fanout=2, buckets=4)
    for b in range(7):
        store.add(spark.createDataFrame([(f"every\nonly {b}\nhalf {b // 4}",)], "text string"))
        assert all(len(level) < 2 for level in store.levels)
    assert len(store.levels) == 3
    frequent = store.frequent().collect()
    assert sorted(r.n for r in frequent) == [3, 3, 3]  # every line, and both halves
    held = sum(spark.table(name).where("not settled").count() for level in store.levels for name in level)
    assert held == 7 + 1  # the lines of one batch, and a merged row of half 1 from before it was settled
    store.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_batch_meets_the_runs_without_shuffling_them(spark):
    store = line_runs.LineRuns(spark, at_least=2, buckets=8)
    store.add(spark.createDataFrame([("a\nb",), ("a\nc",)], "text string"))
    own = spark.createDataFrame([(1, 2, 3)], "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    plan = store.unsettled(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 1
    store.close()


def test_lines_stay_in_the_engine(spark, sf):
    plan = line_runs.drop_frequent_lines([spark.read.parquet(f"{sf}/documents.parquet")])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def test_lines_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op12_line_runs(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_of_odd_rows(spark, odd, empty):
    got = line_runs.drop_frequent_lines([odd], at_least=3).collect()
    want = plain_lines([r.doc.text for r in got], 3)
    assert len(got) == odd.count() and [(r.n_lines, r.n_dropped, r.kept) for r in got] == want
    assert sum(r.n_dropped for r in got) == 4  # the text of four rows
    assert line_runs.drop_frequent_lines([empty]).count() == 0
    assert line_runs.drop_frequent_lines([empty, odd, empty], at_least=3).count() == len(got)


def test_a_line_of_every_document_is_dealt(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\nown "), F.col("id") % 1500).alias("text"))
    got = line_runs.drop_frequent_lines([docs]).groupBy("n_lines", "n_dropped").count().collect()
    assert [tuple(r) for r in got] == [(2, 1, 3000)]


def test_deliveries_read_every_file_once(spark):
    path = f"{shared_dir(spark)}/lines-in-files"
    spark.range(100).select("id", F.col("id").cast("string").alias("text")).repartition(5).write.mode("overwrite").parquet(path)
    parts = line_runs.deliveries(spark.read.parquet(path), 3)
    assert len(parts) == 3 and sorted(r.id for p in parts for r in p.collect()) == list(range(100))


# whitening


def plain_whitening(rows, scale=64, shift=1_000_000):
    """Exact integers, fractions rounded once, and numpy over the fit list."""
    good = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: tuple(int(np.floor(scale * np.float64(c))) + shift for c in v) for k, v in good}
    listed = sorted(set(x.values()))
    n, dims = len(listed), len(listed[0])
    sums = [sum(v[d] for v in listed) for d in range(dims)]
    deviation = {k: sum((n * v[d] - sums[d]) ** 2 for d in range(dims)) for k, v in x.items()}
    centred = np.array([[float(Fraction(n * v[d] - sums[d], n)) for d in range(dims)] for v in listed])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    place = {v: i for i, v in enumerate(listed)}
    return n, deviation, values[::-1], centred @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-30)), {k: place[v] for k, v in x.items()}


def check_whitening(got, rows, components=16):
    n, deviation, values, white, place = plain_whitening(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_key) == set(deviation)
    for c in range(1, components + 1):
        mine = np.array([by_key[k][c].whitened for k in place])
        want = np.array([white[i][c - 1] for i in place.values()])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6  # either sign, the same for all
    for k, own in by_key.items():
        assert len(own) == components
        for c, r in own.items():
            assert (r.n, int(r.deviation)) == (n, deviation[k]) and r.identity_error < 1e-8
            assert abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9


def test_whitening_query_against_a_plain_version(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitening(got.collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5) * [1, 2, 3, 4, 1e-1]]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies are fitted once
    rows += [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [1.0, float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf")] * 5)]
    docs = spark.createDataFrame([(k, v, 1, "w") for k, v in rows], "vec_id long, embedding array<double>, x int, whitened string").repartition(3)
    check_whitening(whitening.whiten(docs).collect(), rows, 5)
    short = spark.createDataFrame([(1, [1.0]), (2, []), (3, [1.0, 2.0]), (4, [2.0, 5.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id for r in whitening.whiten(short).collect()} == {3, 4}  # vectors of fewer entries go
    assert {r.component for r in whitening.whiten(short).collect()} == {1}  # two rows lie on a line
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id or 0 for r in whitening.whiten(nulls).collect()) == [0, 2]


def test_whitening_beyond_longs_is_exact(spark):
    rows = [(i, [1e14 * (i % 7) + i, float(i * i), -3e15]) for i in range(40)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(docs).collect()}
    assert got == plain_whitening(rows)[1]
