"""A page store that is busy, closed, cut off or growing."""

import json

import pytest

from lectern.sources.paged import PagedJson, PagedReader
from lectern.sources.patience import Answer, Patience, Refused


def asked(answers, **how):
    """What comes of answers given in turn (an exception is raised), and the waits between."""
    waits, now, left = [], [0.0], iter(answers)

    def sleep(s):
        waits.append(s)
        now[0] += s

    def send():
        answer = next(left)
        if isinstance(answer, Exception):
            raise answer
        return answer

    patience = Patience(sleep=sleep, clock=lambda: now[0], chance=lambda: 0.0, **how)
    try:
        return patience.json(send), waits
    except Refused as e:
        return e.kind, waits


OK = Answer(body=b'{"items": []}')


@pytest.mark.parametrize(
    ("answers", "waits"),
    [
        ([OK], []),
        ([Answer(429), Answer(429), OK], [5.0, 10.0]),
        ([Answer(403, b"Rate Limit Exceeded"), OK], [5.0]),
        ([Answer(503), OSError(), OK], [1.0, 2.0]),
        ([Answer(503, headers={"retry-after": "7"}), Answer(503, headers={"Retry-After": "soon"}), OK], [7.0, 2.0]),
        ([Answer(503, headers={"Retry-After": "0"}), OK], [0.2]),
        ([Answer(body=b'{"ite'), OK], [1.0]),
        ([Answer(body=b'{"items": []}', headers={"X-Rate-Limit-Remaining": "99.5"})], [1.5]),
        ([Answer(body=b'{"items": []}', headers={"X-Rate-Limit-Remaining": "30"})], [4.0]),
    ],
)
def test_waits(answers, waits):
    assert asked(answers) == ({"items": []}, waits)


@pytest.mark.parametrize(
    ("answers", "kind", "tries"),
    [
        ([Answer(401, b"Invalid access token.")], "signed_out", 1),
        ([Answer(401, headers={"WWW-Authenticate": "Bearer"})], "signed_out", 1),
        ([Answer(401, b"user not authorized")], "forbidden", 1),
        ([Answer(403)], "forbidden", 1),
        ([Answer(404)], "missing", 1),
        ([Answer(400)], "failed", 1),
        ([Answer(500)] * 5, "failed", 5),
        ([OSError()] * 5, "failed", 5),
        ([Answer(body=b"[1,")] * 3, "failed", 3),
    ],
)
def test_refusals(answers, kind, tries):
    got, waits = asked(answers)
    assert (got, len(waits)) == (kind, tries - 1)


def test_budget_of_seconds():
    assert asked([Answer(429), Answer(429), OK], seconds=12.0) == ("out_of_time", [5.0])
    assert asked([Answer(body=b"", headers={"X-Rate-Limit-Remaining": "0"})], seconds=3.0) == ("out_of_time", [])
    assert asked([Answer(body=b"")]) == (None, [])


def store(folder, **listings):
    for listing, pages in listings.items():
        (folder / listing).mkdir(exist_ok=True)
        for n, ids in enumerate(pages, 1):
            body = {"items": [{"id": i} for i in ids], "next": n + 1 if n < len(pages) else None}
            (folder / listing / f"{n}.json").write_text(json.dumps(body))


def test_refused_listings_are_rows(spark, tmp_path):
    store(tmp_path, good=[[1], [2]], closed=[[3]], half=[[4], [5]], loop=[[6]])
    (tmp_path / "half" / "2.json").write_text('{"items": [')
    (tmp_path / "loop" / "1.json").write_text('{"items": [{"id": 6}], "next": 1}')
    (tmp_path / "gone").mkdir()

    class Busy(PagedJson):
        """Every page is busy once, one listing is closed, no wait takes time."""

        @classmethod
        def name(cls):
            return "busy_pages"

        def reader(self, schema):
            class Reader(PagedReader):
                def send(self, listing, page):
                    if listing == "closed":
                        return Answer(403)
                    known = self.__dict__.setdefault("known", set())
                    if (listing, page) not in known:
                        known.add((listing, page))
                        return Answer(429)
                    return super().send(listing, page)

                def patience(self):
                    return Patience(self.seconds, self.tries, sleep=lambda s: None)

            return Reader(self.options, schema)

    spark.dataSource.register(Busy)
    reader = spark.read.format("busy_pages").option("path", f"file://{tmp_path}")
    rows = reader.schema("listing string, id long, cursor string, error string").load()
    got = sorted(((r.listing, r.id, r.cursor, r.error) for r in rows.collect()), key=str)
    assert got == sorted([
        ("good", 1, "1", None), ("good", 2, "2", None), ("closed", None, "1", "forbidden"), ("gone", None, "1", "missing"),
        ("half", 4, "1", None), ("half", None, "2", "failed"), ("loop", 6, "1", None),
    ], key=str)
    part = reader.schema("listing string, id long, cursor string, error string").option("pages", 1).load().where("listing = 'good'")
    assert sorted((r.id, r.cursor, r.error) for r in part.collect() if r.id) == [(1, "1", None)]
    assert [(r.cursor, r.error) for r in part.collect() if not r.id] == [("2", "more_pages")]
    with pytest.raises(Exception, match="forbidden|missing|failed"):
        reader.schema("listing string, id long").load().collect()


def test_stream_is_admitted_and_goes_on(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    store(pages, a=[[1], [2], [3], [4], [5]], b=[[10]])
    spark.dataSource.register(PagedJson)
    batches = []

    def run(**options):
        stream = spark.readStream.format("paged_json").schema("listing string, id long").option("path", f"file://{pages}").options(**options).load()
        query = stream.writeStream.foreachBatch(lambda rows, n: batches.append(sorted(r.id for r in rows.collect())))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(pages_per_trigger=2)
    assert [len(b) for b in batches] == [2, 2, 2] and sorted(sum(batches, [])) == [1, 2, 3, 4, 5, 10]
    batches.clear()
    store(pages, a=[[1], [2], [3], [4], [5], [6]], b=[[10], [11]])
    run(pages_per_trigger=10)
    assert sorted(sum(batches, [])) == [6, 11]
