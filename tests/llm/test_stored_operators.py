import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import hilbert, packing, permutation_index, queries, tokens, training_order, warc
from lectern.storage import fresh_path

PATH = tokens.vocabulary()


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(PATH)


# tokens


@pytest.mark.parametrize(
    "text", ["", "a b  c\n\n d\t\te \x85 x y 'll've 12ab３４ 𝟘", "<|endoftext|> x", " " * 5000 + "a", "b" * 30_000, "日本語 é́ ​ ﻿", "\n" * 1999 + "a"]
)
def test_ids_are_those_of_tokenizers(slow, text):
    assert tokens.token_ids(text, PATH).tolist() == [*slow.encode(text, add_special_tokens=False).ids, tokens.END]


def test_ids_of_documents(slow, spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert tokens.token_ids(r.text, PATH).tolist()[:-1] == slow.encode(r.text, add_special_tokens=False).ids


# packing


def check_packing(rows, ids_of):
    """Pieces cover each document once, and fill sequences without gaps or padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_packing(queries.op1_hilbert_packing(spark, sf).collect(), {r.doc_id: tokens.token_ids(r.text, PATH) for r in docs})


def test_packing_odd_rows(spark, odd, empty):
    total = sum(len(tokens.token_ids(r.text, PATH)) for r in odd.collect())
    got = packing.pack_along_curve(odd).collect()
    assert sum(r.length for r in got) == total
    assert packing.pack_along_curve(empty).count() == 0


def test_packing_puts_equal_texts_side_by_side(spark):
    rows = [(i, f"text of kind {i % 7} " * 30) for i in range(70)]
    got = packing.pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string"), length=1 << 20).orderBy("sequence_id", "offset").collect()
    kinds = [r.doc_id % 7 for r in got if r.start == 0]
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) == 6


def test_packing_follows_the_curve(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r.doc_id: tokens.token_ids(r.text, PATH) for r in docs}
    key = dict(zip(ids, packing.curve_keys(list(ids.values())).tolist(), strict=True))
    rows = sorted(queries.op1_hilbert_packing(spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [key[r.doc_id] for r in rows if r.start == 0]
    assert order == sorted(order)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_neighbours_touch(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# training order


@pytest.mark.parametrize("count", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_permutation(count):
    slots = training_order.permuted(np.arange(count), count)
    assert sorted(slots) == list(range(count))


def plain_slot(index, count, key=training_order.KEY):
    """The keyed Feistel network on plain integers, walked until it is below the count."""
    half = max(1, -(-max(1, count - 1).bit_length() // 2))
    mask, word = (1 << half) - 1, (1 << 64) - 1
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, training_order.ROUNDS)]
    while True:
        left, right = index >> half, index & mask
        for k in keys:
            x = (right + k) & word
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & word
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & word
            left, right = right, left ^ ((x ^ (x >> 31)) & mask)
        index = (left << half) | right
        if index < count:
            return index


@pytest.mark.parametrize("count", [1, 5, 300])
def test_slots_are_those_of_the_plain_network(count):
    assert training_order.permuted(np.arange(count), count).tolist() == [plain_slot(i, count) for i in range(count)]


def test_records_hold_the_ids_of_their_slot(spark, sf):
    """One scan task: sequence i is the i-th cut of all ids, stands in the plain slot, and has its checksum."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.rdd.getNumPartitions() == 1
    ids = np.concatenate([tokens.token_ids(r.text, PATH) for r in docs.collect()]).astype("<u2")
    cuts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
    want = {plain_slot(i, len(cuts)): zlib.crc32(np.pad(c, (0, 2048 - len(c))).tobytes()) for i, c in enumerate(cuts)}
    assert {r.slot: r.record_crc32 for r in queries.op9_training_order(spark, sf).collect()} == want


def test_shards_round_trip(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).unionByName(odd, allowMissingColumns=True)
    manifest, index = training_order.materialise_order(docs, length=64, shard=50)
    read = {r.slot: np.frombuffer(r.ids, "<u2") for r in training_order.read_shards(manifest).collect()}
    assert sorted(read) == list(range(len(read)))
    parts = {}
    for r in index.collect():
        at = 0
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.start, read[r.slot][at : at + p.length]))
            at += p.length
        assert at == r.n and not read[r.slot][at:].any()
    total = 0
    for r in docs.groupBy("doc_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts")).collect():
        own = sorted(tokens.token_ids(t, PATH).tobytes() for t in r.texts)
        total += sum(map(len, own))
        if len(own) == 1:
            got = np.concatenate([p for _, p in sorted(parts[r.doc_id], key=lambda p: p[0])])
            assert got.astype(np.frombuffer(own[0], tokens.token_ids("", PATH).dtype).dtype).tobytes() == own[0]
        else:
            whole = np.concatenate([p for _, p in parts[r.doc_id]])
            assert sorted(whole) == sorted(np.concatenate([tokens.token_ids(t, PATH) for t in r.texts]))
    some = {r.slot for r in training_order.read_shards(manifest, 37, 171).collect()}
    assert some == set(range(37, min(171, len(read))))
    assert training_order.read_shards(training_order.materialise_order(empty)[0]).count() == 0


def test_training_order_query(spark, sf):
    rows = queries.op9_training_order(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(tokens.token_ids(r.text, PATH)) for r in docs}


# WARC

PAGES = [(1, "http://a/1", "<p>x</p>" * 40), (2, "http://a/2", "short"), (3, None, "<p>x</p>" * 40), (4, "http://a/4\r\nX: y", None), (5, "u", "short"), (0, "z", "<p>x</p>" * 40)]


def test_warc_round_trip(spark, tmp_path):
    rows = [*PAGES, (None, "n", "é" * 200), (7, "s", "é" * 200), (7, "s", "é" * 200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op5_warc_salvage(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    bodies = {}
    for i, _, html in rows:
        bodies.setdefault(i, (html or "").encode())
    for r in got:
        assert r.payload_bytes == len(bodies[r.page_id]) and r.payload_digest == hashlib.sha256(bodies[r.page_id]).hexdigest()
    kinds = sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == [
        (-1, "revisit", 7), (0, "response", None), (1, "revisit", 0), (2, "response", None), (3, "revisit", 0),
        (4, "response", None), (5, "response", None), (7, "response", None), (7, "revisit", 7),
    ]


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string, digest string")).count() == 0


def record(n, body=b"<p>some page</p>" * 20):
    return warc.page_record(n, "http://a/", body, hashlib.sha256(body).hexdigest(), None, False)


def test_salvage_recovers_after_damage():
    members = [gzip.compress(record(i, b"<p>page %d</p>" % i * 30)) for i in range(6)]
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 0x55
    data = b"".join([members[0], members[1], bytes(bad), b"junk", members[3], members[4][:40], members[5]])
    found = list(warc.salvage(data))
    ids = [f["warc-record-id"] for _, _, f, _, _ in found if f]
    assert ids == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 5)]
    assert [(o, n) for o, n, f, _, _ in found if f is None] == [
        (len(members[0]) + len(members[1]), len(bad) + 4), (len(data) - len(members[5]) - 40, 40)
    ]
    assert sum(n for _, n, *_ in found) == len(data)


@pytest.mark.parametrize("damage", ["length", "digest", "truncated", "version"])
def test_salvage_plain_records(damage):
    first = record(1)
    if damage == "length":
        first = first.replace(b"Content-Length: 4", b"Content-Length: 9", 1) if b"Content-Length: 4" in first else first[:-9]
    elif damage == "digest":
        first = first.replace(b"<p>some", b"<p>Some", 1)
    elif damage == "truncated":
        first = first[: len(first) // 2]
    else:
        first = b"WORC" + first[4:]
    found = list(warc.salvage(first + record(2) + record(3)))
    assert [f["warc-record-id"] for _, _, f, _, _ in found if f] == ["<urn:x-page:2>", "<urn:x-page:3>"]
    assert [(o, n) for o, n, f, _, _ in found if f is None] == [(0, len(first))]
    assert not list(warc.salvage(b""))


def test_round_trip_of_a_long_url(spark):
    urls = {1: "data:text/html," + "x" * 100_000, 2: "http://a/?q=" + "é" * 400_000, 3: "http://a/"}
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in urls.items()], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert {r.record_id: r.uri for r in got if r.kind == "record"} == {f"<urn:x-page:{i}>": u for i, u in urls.items()}
    assert len(got) == 3


def test_page_ids_of_any_characters(spark, tmp_path):
    ids = ["a>b", " edge ", "", "x\r\ny", "50%", "a+b", "日本", "<urn:x-page:1>", None]
    rows = [(i, f"http://a/\x01{n}", f"page {n} " * 40, "extra") for n, i in enumerate(ids)] + [("copy", None, "page 1 " * 40, "extra")]
    spark.createDataFrame(rows, "page_id string, url string, html string, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in queries.op5_warc_salvage(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(ids, ("response", None)) | {"copy": ("revisit", " edge ")}
    uris = {r.uri for r in warc.round_trip(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()}
    assert "http://a/%010" in uris


def test_salvage_a_member_whose_first_record_is_damaged():
    member = gzip.compress(b"XARC" + record(1)[4:] + record(2) + record(3))
    found = list(warc.salvage(gzip.compress(record(0)) + member + gzip.compress(record(4))))
    assert [f["warc-record-id"] for _, _, f, _, _ in found if f] == [f"<urn:x-page:{i}>" for i in (0, 2, 3, 4)]
    gaps = [why for _, _, f, _, why in found if f is None]
    assert len(gaps) == 1 and "inside the member" in gaps[0]


def test_read_archives_logs_gaps(spark):
    folder = fresh_path(spark, "damaged")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(warc.plan_pages(pages).coalesce(1), folder).collect()[0].archive
    local = archive.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    third = sorted((r.offset, r.length) for r in warc.read_archives(spark, [archive]).collect())[2]
    data[third[0] + third[1] // 2] ^= 0xFF
    open(local, "wb").write(data)
    rows = warc.read_archives(spark, [archive]).collect()
    gaps = [r for r in rows if r.kind == "gap"]
    assert [(g.offset, g.length) for g in gaps] == [third]
    assert sum(r.kind == "record" for r in rows) == 29


# nearest neighbours


def plain_nearest(rows, k, every):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q, a in usable.items():
        if q % every == 0:
            score = {i: a @ b / np.linalg.norm(a) / np.linalg.norm(b) for i, b in usable.items() if i != q}
            out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(350, None), (400, [0.0] * 8), (450, [float("nan")] * 8), (500, [1.0]), (550, [None] * 8), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in permutation_index.nearest_neighbours(table, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == plain_nearest(rows, 5, 50)


@pytest.mark.parametrize("share", [1.0, 0.3])
def test_index_over_many_segments(spark, share):
    """More vectors than are always compared, in clusters, over segments and query blocks."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 8))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.3 * rng.standard_normal(8)]) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    found = permutation_index.nearest_neighbours(table, every=50, share=share, least=16, segment=500, block=7)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = plain_nearest(rows, 5, 50)
    assert set(got) == set(want)
    if share == 1:
        assert got == want
    else:
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, segment int, vector string"
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [1.0, 1.0], 1, "x"), (2, [0.0, 2.0], 1, "x")], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in permutation_index.nearest_neighbours(few).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert permutation_index.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0


def test_recall_of_random_vectors(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((6000, 64)).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for r in permutation_index.nearest_neighbours(table).groupBy("query_id").agg(F.collect_set("vec_id").alias("near")).collect():
        score = unit @ unit[r.query_id]
        score[r.query_id] = -9
        hits += len(set(np.argsort(-score)[:5].tolist()) & set(r.near))
    assert hits >= 0.9 * 5 * 120
