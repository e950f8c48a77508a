import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import chunks, components, exact_dedup, language, mixing, queries, sieve, simhash, toxicity
from lectern.storage import materialize


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# exact deduplication


def test_exact_duplicates_match_grouping(spark, odd):
    got = exact_dedup.exact_duplicates(odd, digest_all=True).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    size = Counter(t for _, t in texts)
    best = {t: max((i for i, x in texts if x == t and i is not None), default=None) for t in size}
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    assert len(got) == len(texts)
    assert all(r.group_size == size[digest[r.text_sha256]] and r.keep_id == best[digest[r.text_sha256]] for r in got)
    assert Counter(digest[r.text_sha256] for r in got if r.kept) == Counter(dict.fromkeys(size, 1))


def test_rows_found_unique_never_enter_the_grouping(spark):
    """With a prefix level that lets nothing through, equal texts stay apart: the levels decide."""
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_duplicates(docs, digest_all=True).collect()} == {1: 2, 2: 2, 3: 1}
    real = exact_dedup.surviving_prefixes
    exact_dedup.surviving_prefixes = lambda d, t="text": real(d, t).where("false")
    try:
        assert all(r.group_size == 1 and r.text_sha256 for r in exact_dedup.exact_duplicates(docs, digest_all=True).collect())
    finally:
        exact_dedup.surviving_prefixes = real


def test_large_groups_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 3)
    rows = [(i, f"text {i % 5 if i < 60 else i}") for i in range(100)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=True).collect()
    size, best = Counter(t for _, t in rows), {t: max(i for i, x in rows if x == t) for _, t in rows}
    assert len(got) == 100 and all((r.group_size, r.keep_id) == (size[dict(rows)[r.doc_id]], best[dict(rows)[r.doc_id]]) for r in got)


def test_exact_duplicates_digest_only_survivors(spark, odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert any(r.text_sha256 is None for r in got)
    assert all(r.group_size == 1 and r.kept for r in got if r.text_sha256 is None)


def test_drop_exact_duplicates_keeps_columns(spark, odd, empty):
    got = exact_dedup.drop_exact_duplicates(odd)
    assert got.columns == odd.columns
    texts = [r.text or "" for r in got.collect()]
    assert Counter(texts) == Counter(dict.fromkeys({r.text or "" for r in odd.collect()}, 1))
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_sieve_never_loses_a_key(spark):
    rows = spark.range(2000).withColumn("v", F.col("id") % 7)
    losers = rows.where("id % 3 = 0").select(F.col("id").alias("k"))
    assert {r.id for r in sieve.without(rows, losers, {"k": F.col("id")}).collect()} == {i for i in range(2000) if i % 3}


# SimHash


def plain_fingerprint(text, words):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", found) if w]
    if not found:
        return 0
    grams = [found[i : i + words] for i in range(len(found) - words + 1)] or [found]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "ÀB cD e f g", "a b c", "x y z w " * 70_000, "a\x0bb\x0cc d"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text, 3)


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [0, 2])
def test_simhash_links_are_those_of_all_pairs(spark, radius):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = [b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(12)]
    fps += [0, (1 << 64) - 1, 1 << 63, 0]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    root = {r.node: r.root for r in components.components(simhash.links(frame, radius)).collect()}
    want = plain_components(fps, radius)
    groups, mine = defaultdict(set), defaultdict(set)
    for i, f in enumerate(signed):
        groups[want[i]].add(i)
        mine[root.get(f, f)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_query_is_that_of_all_pairs(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(rows)
    fps = [plain_fingerprint(rows[i], 3) for i in ids]
    root, groups = plain_components(fps, 2), defaultdict(list)
    for i, r in zip(ids, root, strict=True):
        groups[r].append(i)
    want = {i: (f"{fp:016x}", min(groups[r])) for i, fp, r in zip(ids, fps, root, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_ball(spark, sf).collect()}
    assert got == want


def test_components_of_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(7000, 7000), (None, 5)]
    got = dict(pairs(components.components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)} | {7000: 7000}


def test_components_of_stars_take_no_round_and_grow_by_links(spark, monkeypatch):
    from lectern.llm import components

    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda rows, name: written.append(name) or write(rows, name))
    frame = lambda edges: spark.createDataFrame(edges, "u long, v long")
    old = [(2, 1), (3, 1), (3, 1), (5, 5), (11, 10), (21, 20), (22, 20)]
    roots = write(components.components(frame(old)), "roots")
    assert dict(pairs(roots, "node", "root")) == {1: 1, 2: 1, 3: 1, 5: 5, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    assert written == ["edges"]
    for links in ([], [(3, 2)], [(22, 11), (30, 21)], [(0, 3), (41, 40), (42, 41), (22, 0)], [(11, 3), (22, 11), (5, 22), (50, 5)]):
        every = dict(pairs(components.components(frame(old + links)), "node", "root"))
        assert dict(pairs(components.extended(roots, frame(links)), "node", "root")) == every


def test_simhash_components_odd_rows(spark, odd, empty):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {1, 3, 6, None} <= {r.doc_id for r in kept.collect()}
    assert simhash.similar_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_similar_components_find_edited_copies(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows, near = [], 0
    for i in range(120):
        words = [word() for _ in range(400)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.integers(0, 400, 5):  # five words of 400 differ: a similarity of about 0.88
            words[at] = word()
        rows.append((2 * i + 1, " ".join(words)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, rows[2][1])]
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert len(found) == len(rows) and got[1002] == 2 and got[1000] == got[1001] == 1000
    near = sum(got[2 * i + 1] == 2 * i for i in range(120))
    assert near >= 114 and all(got[2 * i] == 2 * i for i in range(120))


def test_similar_components_write_few_tables(spark, monkeypatch):
    """Sets of shingles pass one exchange and buckets that are read once are not written: each
    file costs an executor a process or more where Hadoop's native code is missing."""
    rng = np.random.default_rng(31)
    text = lambda n: [str(w) for w in rng.integers(0, 10_000, n)]
    base = [text(60) for _ in range(10)]
    rows = [(2 * i, " ".join(w)) for i, w in enumerate(base)] + [(2 * i + 1, " ".join([*w, "more"])) for i, w in enumerate(base)]
    names, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name="table": names.append(name) or write(df, name))
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(d, d - d % 2) for d, _ in rows}
    assert "sets" not in names and names.count("mixed") == 1 and "alike" in names


def test_similar_components_exactly(spark):
    """With ``exact``, the components of all pairs at 0.8 or more by brute force."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 + i, t) for i, t in enumerate([None, "", " ", "one two", "one two", "a b c d e", "a b c d e f"])]
    for i in range(12):
        text = rng.choices(words, k=60)
        for k in range(12):  # from a few to a third of the shingles differ
            own = list(text)
            for _ in range(k // 3):
                own[rng.randrange(60)] = rng.choice(words)
            rows.append((i * 20 + k, " ".join(own)))
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_components(docs, exact=True).collect()} == root
    wider = {r.doc_id: r.component_id for r in simhash.similar_components(docs, piece=24, check_far=16, along=64).collect()}
    assert all(root[i] == root[c] for i, c in wider.items()) and len(set(wider.values())) <= len(set(root.values())) + 2


def test_similar_components_check_the_shingles(spark):
    """What is alike in 0.7 of its shingles stays two, what is alike in 0.8 becomes one."""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rng, rows, want = np.random.default_rng(5), [], {}
    for i in range(200):
        words = [word() for _ in range(404)]
        other = [*words[: -44 if i % 2 else -72], *(word() for _ in range(44 if i % 2 else 72))]
        sets = [{tuple(w[k : k + 5]) for k in range(400)} for w in (words, other)]
        want[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert all(0.795 < s < 0.805 if i % 2 else 0.69 < s < 0.71 for i, s in want.items())
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r.component_id for r in found}
    linked = [i for i in want if got[2 * i + 1] == 2 * i]
    alike = [i for i in want if want[i] >= 0.8]
    assert all(want[i] >= 0.8 for i in linked) and len(alike) >= 90 and len(linked) >= 0.96 * len(alike)


def test_similar_components_within_a_family(spark):
    """Near copies among many documents that share a long passage are found past strangers with lesser ids."""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rng, rows, n = np.random.default_rng(6), [], 600
    passage = [word() for _ in range(300)]
    for i in range(n):
        own = [word() for _ in range(100)]
        rows.append((i, " ".join(passage + own)))  # alike in 0.6
        if i >= n - 150:
            own[-19:] = [word() for _ in range(19)]
            rows.append((10_000 + i, " ".join(passage + own)))  # alike in 0.9
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert all(got[i] == i for i in range(n))
    assert sum(got[10_000 + i] == i for i in range(n - 150, n)) == 150


def test_similar_components_miss_no_link(spark):
    """By default too, in a family of texts that are just alike, nearly alike or strangers to its least ones."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base, rows = rng.choices(words, k=300), []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(300), 5 if i < 200 else 6):  # alike in about 0.7; a third have a partner at about 0.8
            own[at] = rng.choice(words)
        rows.append((i, " ".join(own)))
        if i >= 200:
            for at in rng.sample(range(300), 6):
                own[at] = rng.choice(words)
            rows.append((1000 + i, " ".join(own)))
    rows = [(i, t) for i, (_, t) in enumerate(sorted(rows))]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in rows]
    root, linked = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                linked += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert linked > 20 and len(set(root)) > 20
    odd = [simhash.parities(np.fromiter(own, np.uint64)).view(np.uint64) for own in sets]
    assert all(np.bitwise_count(odd[0] ^ o).sum() <= len(sets[0] ^ s) for o, s in zip(odd, sets, strict=True))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(root))


# mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return {s: float(v) for s, v in fixed.items()}
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, level * w[s])) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixing_plan(docs).withColumn("taken", mixing.taken_words()).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and sum(p.words for p in r.pieces) == r.taken
        spans = sorted((p.epoch, p.start, p.words) for p in r.pieces)
        assert all(a[0] < b[0] or a[1] + a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    want = plain_targets(sizes)
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in want)
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in want)
    again = mixing.mixing_plan(docs.repartition(5)).withColumn("taken", mixing.taken_words())
    assert sorted(pairs(again, "doc_id", "taken")) == sorted((r.doc_id, r.taken) for r in rows)


def test_mixing_caps_and_null_source(spark):
    rows = [(i, "w " * 400, "big") for i in range(60)] + [(100, "w " * 500, "Zsmall"), (101, "w " * 700, None), (102, None, "empty"), (103, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixing_plan(docs).withColumn("taken", mixing.taken_words()).collect()
    want = plain_targets({"Zsmall": 500, "big": 24_000, "empty": 0, None: 700})
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert {r.doc_id: r.taken for r in got if r.doc_id in (100, 102, 103)} == {100: 1500, 102: 0, 103: 0}


def test_mixing_shards_are_disjoint_draws_of_the_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 0), (3, 5)], "place int, quota long")
    leaves = mixing.split_quotas(quotas, 8).collect()
    sums, shard = Counter(), Counter()
    for r in leaves:
        assert r.blocks >= 0
        sums[r.place] += r.blocks
        shard[r.shard] += r.blocks
    assert [sums[i] for i in range(4)] == [1000, 37, 0, 5]
    assert sum(shard.values()) == 1042 and max(shard.values()) - min(shard.values()) <= 1


def test_the_tree_deals_the_shards(spark, sf, monkeypatch):
    """Words by shard are those of the tree's leaves, and another tree deals them anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = lambda: sorted((r.doc_id, tuple(sorted(map(tuple, r.pieces)))) for r in mixing.mixing_plan(docs).collect())
    before = pieces()
    blocks = Counter(p[0] for _, own in before for p in {(s, rank) for s, rank, *_ in own})
    assert len(blocks) == mixing.SHARDS and max(blocks.values()) < 1.5 * min(blocks.values())
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda q, shards: real(q, shards).withColumn("shard", shards - 1 - F.col("shard")))
    after = pieces()
    assert before != after and [(i, sum(p[4] for p in own)) for i, own in before] == [(i, sum(p[4] for p in own)) for i, own in after]


def test_hypergeometric_follows_the_distribution(spark):
    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    cast = lambda v: F.lit(v).cast("long")
    got = Counter(r[0] for r in grid.select(mixing.hypergeometric(F.col("u"), cast(50), cast(20), cast(10))).collect())
    for k in range(11):
        p = math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(got[k] / 4000 - p) < 1e-3


def test_mixed_documents(spark, odd, empty):
    got = mixing.mixed_documents(odd)
    plan = mixing.mixing_plan(odd).select(F.sum(mixing.taken_words())).first()[0]
    assert got.columns == odd.columns
    words = got.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD))), F.count_if(F.length("text") != F.col("n_chars"))).first()
    assert tuple(words) == (plan, 0)
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixing_plan(empty).count() == 0


# content-defined chunks


def test_chunks_cover_text_and_resist_shifts():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    ends = chunks.chunk_ends(data)
    assert ends[-1] == len(data) and (np.diff(np.concatenate([[0], ends])) > 0).all()
    own = lambda d: {d[a:b] for a, b in zip([0, *chunks.chunk_ends(d)[:-1]], chunks.chunk_ends(d), strict=True)}
    assert len(own(data) & own(b"inserted words" + data)) > 0.98 * len(ends)
    assert len(chunks.chunk_ends(b"")) == 0 and chunks.chunk_ends(b"ab").tolist() == [2]


def test_rolling_hash_by_definition():
    data = np.frombuffer(b"some bytes to roll over, and a few more of them", np.uint8)
    for i, h in enumerate(chunks.rolling(data)):
        want = 0
        for b in data[max(0, i - chunks.WINDOW + 1) : i + 1]:
            want = ((want << 32 // chunks.WINDOW) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        assert want == h


def test_repeated_passages_finds_planted_ones(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(55) for _ in range(30)]
    rows = [(i, f"{text(80)} {passage[i % 30]} {text(60)}") for i in range(60)] + [(1000 + i, text(200)) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " ".join(["word"] * 10))]
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id for r in got.collect()}
    assert len(found & set(range(60))) >= 57 and found <= set(range(60))
    texts = dict(rows)
    for r in got.collect():
        span = texts[r.doc_id].encode()[r.start : r.start + r.length]
        assert span in passage[r.doc_id % 30].encode() or len(span) <= len(passage[0].encode()) * 2
        assert r.first_doc_id in (r.doc_id, r.doc_id - 30)
    cut = {r.doc_id: r.text for r in chunks.cut_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(cut[i]) < len(texts[i]) for i in found if i >= 30) and all(cut[i] == texts[i] for i in range(30))


def plain_repeats(texts, n):
    """Ids of texts with a window of n words that another one holds."""
    first, found = {}, set()
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        for k in range(len(words) - n + 1):
            j = first.setdefault(tuple(words[k : k + n]), i)
            found |= {i, j} if i != j else set()
    return found


def test_blocks_leave_no_trace():
    rng = np.random.default_rng(3)
    text = "".join(chr(c) for c in rng.integers(97, 700, 4000)) + " " + "a" * 2000 + " x y" * 300
    want = chunks.chunks_of(text)
    for block in (5, 90, 1001):
        got = chunks.chunks_of(text, block)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and got[2] == want[2]
    assert want[1].sum() == len(text.encode().split())


def test_repeated_passages_are_those_of_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {rows[i].doc_id for i in plain_repeats([r.text for r in rows], chunks.LEAST_WORDS)}
    got = chunks.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} <= want and len({r.doc_id for r in got}) >= 0.95 * len(want)
    text = {r.doc_id: (r.text or "").encode() for r in rows}
    for r in got:
        assert r.copies > 1 and (r.kept or text[r.doc_id][r.start : r.start + r.length] in b"\0".join(text.values()))


def test_repeated_passages_length(spark):
    """Passages of 51 words count and those of 50 do not, whatever stands around them."""
    rng = np.random.default_rng(19)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        passage = text(51 if i % 2 else 50)
        rows += [(2 * i, f"{text(40)} {passage} {text(30)}"), (2 * i + 1, f"{passage} {text(50)}" if i % 3 else f"{text(70)} {passage}")]
    found = {r.doc_id for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long = {d for i in range(60) if i % 2 for d in (2 * i, 2 * i + 1)}
    assert found <= long and len(found) >= 0.95 * len(long)


def test_cut_leaves_each_passage_once(spark):
    """Documents B, A B and A B, repeated rows and null ids: no passage is lost."""
    rng = np.random.default_rng(23)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c = text(120), text(120), text(150)
    rows = [(1, b), (2, f"{a} {b}"), (3, f"{a} {b}"), (4, c), (4, c), (None, f"{text(60)} {c}"), (None, c), (5, text(90)), (6, None), (7, "")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    cut = chunks.cut_repeated(docs)
    left = [r.text or "" for r in cut.collect()]
    assert len(left) == len(rows) and cut.columns == docs.columns
    for passage in (a, b, c):
        core = passage[80:-80]
        assert sum(core in t for t in left) == 1
    assert sum(map(len, left)) < sum(len(t or "") for _, t in rows) - len(a) - len(b) - 2 * len(c)


def test_windows_of_a_common_passage_settle_by_one_a_run(spark, monkeypatch):
    """Copies of near copies, whose runs are all short: one window settles a run, and all are found."""
    rng = np.random.default_rng(29)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    common, family = [word() for _ in range(300)], []
    for i in range(20):
        own = list(common)
        for k in range(2 * i, 300, 40):  # so the rows that first hold its chunks change
            own[k] = word()
        family.append(" ".join(own))
    rows = [(i, family[i % 20]) for i in range(120)]
    made, write = {}, chunks.materialize
    monkeypatch.setattr(chunks, "materialize", lambda df, name="table": made.setdefault(name, write(df, name)))
    chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    windows = made["windows"].where("run >= 0")
    looked_up = windows.where("lead").count() + windows.where("not lead").join(made["open"], ["row_no", "run"], "left_semi").count()
    assert windows.where("lead").count() == windows.select("row_no", "run").distinct().count()
    assert 0 < looked_up < windows.join(made["shared"], "window").count() / 5
    every = {tuple(r) for r in windows.join(made["shared"], "window").select("row_no", "run").distinct().collect()}
    assert every and {tuple(r) for r in made["verified"].collect()} == every


def test_repeated_passages_odd_rows(spark, odd, empty):
    got = chunks.repeated_passages(odd).collect()
    assert {6, 7} <= {r.doc_id for r in got} and chunks.repeated_passages(empty).count() == 0


# language


def test_language_held_out_accuracy(spark, sf):
    got = queries.op8_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_language_odd_rows(spark, odd, empty):
    model = language.fit(odd)
    found = odd.select("doc_id", "text", language.identify(spark, model, F.col("text")).alias("x")).collect()
    for r in found:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.x.lang == "und") != letters and (letters or r.x.score == 0)
    nothing = language.fit(empty)
    assert odd.select(language.identify(spark, nothing, F.col("text"))["lang"].alias("l")).distinct().collect()[0].l == "und"
    assert empty.select(language.identify(spark, model, F.col("text"))).count() == 0


def plain_language(text, counts, docs_of):
    """Naive Bayes by definition: hashed n-grams of a text between two spaces, counts of dicts."""
    def grams(t):
        codes = [ord(c) for c in "  " + t.lower() + "  "]
        for at in range(len(codes) - 2):
            for n in language.ORDERS:
                h = n
                for c in codes[at : at + n]:
                    h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                yield h & (language.BUCKETS - 1)

    if text is None:
        return Counter(grams(counts)) if isinstance(counts, str) else None
    found = list(grams(text))
    total = {k: sum(c.values()) + 0.5 * language.BUCKETS for k, c in counts.items()}
    logit = {
        k: sum(math.log((c[g] + 0.5) / total[k]) for g in found) * min(1, language.CERTAIN_GRAMS / len(found)) + math.log(docs_of[k] / sum(docs_of.values()))
        for k, c in counts.items()
    }
    best = max(logit, key=lambda k: (logit[k], k))
    return best, 1 / sum(math.exp(v - logit[best]) for v in logit.values())


def test_language_is_that_of_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60 and length(text) < 3000")
    model, rows = language.fit(docs), docs.collect()
    counts, docs_of = defaultdict(Counter), Counter()
    for r in rows:
        counts[r.lang].update(plain_language(None, r.text, None))
        docs_of[r.lang] += 1
    pred, score = model.scores([r.text for r in rows])
    for r, p, s in zip(rows, pred, score, strict=True):
        want = plain_language(r.text, counts, docs_of)
        assert p == want[0] and abs(s - want[1]) < 1e-3


def test_more_languages_than_the_model_holds(spark):
    rows = [(i, f"text {i}", f"l{i % 9}" if i < 90 else "rare") for i in range(93)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs, most=4).languages == ["l0", "l1", "l2", "l3"] and "rare" in language.fit(docs).languages


def test_language_score_does_not_depend_on_the_batch(spark, odd):
    model = language.fit(odd)
    texts = [r.text for r in odd.collect()]
    together, alone = model.scores(texts), [model.scores([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])


# toxicity


def test_decoding_restores_obfuscated_words():
    words = "idiot stupid trash loser clown the and hello moron".split()
    count = Counter(p for w in words for p in (a + b for a, b in zip("^" + w, w + "$", strict=False)))
    letters = toxicity.Letters({k: v * 50 for k, v in count.items()})
    assert letters.restore("1d10t") == ["idiot"] and letters.restore("stuuuupid!!!") == ["stupid"]
    assert letters.restore("i.d.i.o.t") == ["idiot"] and letters.restore("tr@sh,") == ["trash"] and letters.restore("l0ser") == ["loser"]
    assert letters.restore("id*ot") == ["idiot"] and letters.restore("ss-tt-uu-pp-ii-dd") == ["stupid"] and letters.restore("iiddiioott") == ["idiot"]
    assert letters.restore("idi\u043et") == ["idiot"] and letters.restore("mo\u200bron") == ["moron"] and letters.restore("ｌｏｓｅｒ") == ["loser"]
    assert letters.restore("hello") == ["hello"] and letters.restore("12345") == []


def test_spaced_letters_and_surrounding_signs():
    words = "idiot stupid trash loser clown the and hello moron such a is so ass thing".split()
    count = Counter(p for w in words for p in (a + b for a, b in zip("^" + w, w + "$", strict=False)))
    letters = toxicity.Letters({k: v * 50 for k, v in count.items()})
    assert letters.decode("alosersuch", True) == "a loser such" and letters.decode("idiotloser", True) == "idiot loser"
    assert "a" in letters.restore("a$$") and {w[:2] for w in letters.restore("a$$")} == {"a", "as"}
    assert letters.restore("@$$")[0].startswith("as") and letters.restore("the$$$") and letters.restore("$100") == letters.restore("!!!") == []
    assert letters.restore("x" * 60 + "1d10t" + "y" * 60) and letters.decode("1d10t" * 20) == "idiot" * 20


def test_toxicity_is_that_of_plain_sums(spark):
    train = [(i, f"plain words number {i} here", 0) for i in range(60)] + [(100 + i, f"you 1diot numb3r {i} s t u p i d", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int"))

    def plain(text):
        """Words token by token, without memory; runs of single letters once more as words."""
        tokens, found, single, last = (text or "").lower().split(), [], [], ""
        for t in [*tokens, "longer"]:
            if len(t) == 1:
                single.append(t)
            else:
                found += model.letters.decode("".join(single), True).split() if len(single) >= 3 else []
                single = []
            if 1 < len(t) <= toxicity.SHORT and last and last.isalpha() and t.isalpha() and model.letters.parted(last, t):
                found.append(last + t)
            last = t if 1 < len(t) <= toxicity.SHORT else ""
        found += [w for t in tokens for w in model.letters.restore(t)]
        hits = Counter(f for w in found for f in toxicity.features(w))
        z = model.bias + sum(model.weights[model.keep[f]] * math.log1p(n * toxicity.TYPICAL / (len(tokens) + 100)) for f, n in hits.items() if f in model.keep)
        return 1 / (1 + math.exp(-z))

    texts = [t for _, t, _ in train[::7]] + ["i d i o t", "you st up id", "", None, "1d1ot$$$ plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", toxicity.toxicity(spark, model, F.col("t")).alias("s")).collect()
    assert all(abs(r.s - plain(r.t)) < 1e-9 for r in got)
    small = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int"), fit_toxic=20, fit_clean=20, fit_entries=50)
    assert 0 <= small.scores(["you idiot"], toxicity.Reader(small.letters, small.keep))[0] <= 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)


def test_letters_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "xyz xyz"), (None, "xw"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    counts = toxicity.fit(docs, labels).letters.counts
    assert counts["xy"] == 2 and counts["xw"] == 1 and counts["^x"] == 3 and counts["ab"] == 2


def test_toxicity_spaced_letters_and_odd_rows(spark, odd, empty):
    train = [(i, f"plain words number {i} here", 0) for i in range(40)] + [(100 + i, f"you idiot number {i} here", 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    texts = spark.createDataFrame([("i d i o t number here",), ("you 1d1ot",), ("plain words",), ("",), (None,)], "t string")
    hidden, leet, plain, blank, null = (r[0] for r in texts.select(toxicity.toxicity(spark, model, F.col("t"))).collect())
    assert hidden > 0.5 and leet > 0.5 and plain < 0.5 and blank == null and 0 <= blank < 0.5
    scores = [r[0] for r in odd.select(toxicity.toxicity(spark, model, F.col("text"))).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    none = toxicity.fit(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert odd.select(toxicity.toxicity(spark, none, F.col("text")).alias("s")).where("s > 0.01").count() == 0


def test_materialize_reads_back(spark, odd):
    assert materialize(odd).count() == odd.count()
