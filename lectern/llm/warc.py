"""WARC archives: a writer, and a reader that salvages what damaged archives still hold.

Writing: each task writes gzip members to archives of its own, under names that no other
attempt uses, and gives a manifest row for each; only archives of a finished manifest
count, so a lost or repeated task leaves files that nobody reads.

Reading: a record counts if all its checks hold (member checksum, version line, header
fields, length, end marks, digests).  After a failed check the reader looks for the next
place where a gzip member or a version line begins and holds the checks again; the bytes
in between are reported as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import sieve
from lectern.storage import fresh_path, materialize

LEAST_PAYLOAD = 100  # smaller payloads are never revisits
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_STEP, _BATCH = 1 << 20, 8 << 20
FIELDS = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _clean(value: object) -> str:
    """A header value: control characters, and blanks at the ends, are percent-encoded."""
    text = str(value if value is not None else "")
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: quote(m[0]), text)


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def encode_record(head: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record; ``head`` without the length and the block's digest."""
    head = head | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _urn(page_id: object) -> str:
    """A record's name, from which ``page_of`` gives the page id back, whatever it holds."""
    return "<urn:x-no-page>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='', errors='surrogatepass')}>"


def page_of(name: str, kind: str) -> Column:
    """The page id, of a Spark type, in a column of record names; null where there is none."""
    found = F.regexp_extract(name, "<urn:x-page:([^>]*)>", 1)
    return F.when(F.col(name).startswith("<urn:x-page:"), F.url_decode(found)).cast(kind)


def page_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """A page as a response, or as a revisit that holds the headers only."""
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url), "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to)}
    return encode_record(head, _http(len(payload)) + (b"" if revisit else payload))


def plan_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, revisit, refers_to)`` per page.

    Of equal payloads of at least ``LEAST_PAYLOAD`` bytes the one with the smallest page
    id is the response.  Null payloads are empty; a null page id ranks after all others;
    of rows that agree in id and payload the first is the response.  Payloads are only
    shuffled for pages that may have a copy.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    stored = materialize(
        pages.select(F.monotonically_increasing_id().alias("row_no"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
        .withColumn("digest", F.sha2("payload", 256)),
        "pages",
    )
    first = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row_no")
    groups = materialize(
        stored.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "copies",
    )
    marked = sieve.mark(stored, sieve.build(groups, F.col("digest")), F.col("digest"), "maybe")
    nobody = F.lit(None).cast(groups.schema["first"].dataType)
    some = marked.where("maybe").join(groups, "digest", "left").select("page_id", "url", "payload", "digest", "row_no", "first")
    rows = marked.where("not maybe").select("page_id", "url", "payload", "digest", "row_no", nobody.alias("first")).unionByName(some)
    revisit = F.coalesce(F.col("first.row_no") != F.col("row_no"), F.lit(False))
    return rows.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub(r"^file:/*", "file:///", path))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned pages below ``folder``; the manifest ``(archive, records, bytes)``.

    ``folder`` is shared by all executors and of a kind that pyarrow can write.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, done = TaskContext.get(), None, []
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, payload, digest, revisit, refers = (batch.column(i)[row].as_py() for i in range(6))
                if out is None:
                    target = f"{folder}/pages-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    system, path = _open(target)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, size, count = system.open_output_stream(path, compression=None), 0, 0
                member = gzip.compress(page_record(page, url, payload, digest, refers, revisit), 6, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((target, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((target, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    columns = planned.select(F.col("page_id").cast("string"), "url", "payload", "digest", "revisit", F.col("refers_to").cast("string"))
    return materialize(columns.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def _member(data: memoryview, at: int) -> tuple[int, bytes] | None:
    """End and content of the gzip member at ``at``, if its checksum and length hold."""
    inflate, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and pos < len(data):
            parts.append(inflate.decompress(data[pos : pos + _STEP]))
            pos += _STEP
    except zlib.error:
        return None
    return (min(pos, len(data)) - len(inflate.unused_data), b"".join(parts)) if inflate.eof else None


def _digest_holds(named: str | None, block: bytes) -> bool:
    kind, _, value = (named or "").partition(":")
    if kind == "sha256":
        return hashlib.sha256(block).hexdigest() == value.lower()
    if kind == "sha1":
        raw = hashlib.sha1(block, usedforsecurity=False).digest()
        return value.upper() == base64.b32encode(raw).decode() or value.lower() == raw.hex()
    return True  # an algorithm this reader does not know proves nothing


def _head(data: bytes | memoryview, at: int) -> bytes:
    """The header at ``at`` with the empty line that ends it, looked for in growing blocks;
    nothing if no such line or another record's begin comes first."""
    size = 1 << 16
    while True:
        block = bytes(data[at : at + size])
        end = block.find(b"\r\n\r\n")
        following = _VERSION.search(block, 1, end if end >= 0 else len(block))
        if following and block[following.start() - 2 : following.start()] == b"\r\n":
            return b""
        if end >= 0:
            return block[: end + 4]
        if at + size >= len(data):
            return b""
        size *= 4


def parse_record(data: bytes | memoryview, at: int = 0) -> tuple[int, dict[str, str], bytes] | str:
    """End, header fields and block of the record at ``at``, or the check that failed."""
    head = b""
    if _VERSION.match(data, at):
        head = _head(data, at)
    end = len(head) - 4
    if end < 0:
        return "no version line or end of header"
    fields: dict[str, str] = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, mark, value = line.decode("utf-8", "replace").partition(":")
        if not mark:
            return "header line without a colon"
        fields[name.strip().lower()] = value.strip()
    if any(f not in fields for f in FIELDS) or not re.fullmatch(r"\d{1,15}", fields["content-length"]):
        return "a required field is missing"
    start = at + end + 4
    stop = start + int(fields["content-length"])
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        return "no end mark where the length puts it"
    block = bytes(data[start:stop])
    if not _digest_holds(fields.get("warc-block-digest"), block):
        return "block digest"
    if fields["warc-type"] in ("response", "resource") and not _digest_holds(fields.get("warc-payload-digest"), payload_of(fields, block)[0]):
        return "payload digest"
    return stop + 4, fields, block


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload of a record, and the length that its HTTP header gives (or its own)."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, mark, body = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d{1,15})\s*$", head)
    return (body, int(told[1]) if told else len(body)) if mark else (block, len(block))


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """Records ``(offset, length, fields, block, "")`` and gaps ``(offset, length, None,
    b"", reason)`` of an archive, in order; together they cover every byte of it."""
    view, at, gap, why = memoryview(data), 0, None, ""
    while at < len(data):
        found: list[tuple[int, int, dict[str, str] | None, bytes, str]] = []
        if data[at : at + 3] == MAGIC:
            member = _member(view, at)
            if member is None:
                failed = "gzip member"
            else:
                end, content = member
                whole, inner = parse_record(content), 0
                if isinstance(whole, tuple) and whole[0] == len(content):
                    found, failed = [(at, end - at, whole[1], whole[2], "")], ""
                else:  # several records in one member, or a bad one: salvage its content
                    inside = list(salvage(content)) if _VERSION.search(content) else []
                    found = [(at, end - at, f, b, r and f"{r}, inside the member at +{o}") for o, _, f, b, r in inside]
                    failed = "" if any(f for _, _, f, _, _ in found) else "record in a valid member"
        else:
            whole = parse_record(view, at)
            failed = whole if isinstance(whole, str) else ""
            if not failed:
                end = whole[0]
                found = [(at, end - at, whole[1], whole[2], "")]
        if failed:
            if gap is None:
                gap, why = at, failed
            following = _BEGIN.search(view, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", why
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", why


SCHEMA = (
    "archive string, kind string, offset long, length long, warc_type string, record_id string, refers_to string, "
    "uri string, date string, payload_digest string, http_length long, payload binary, reason string"
)


def _records(batches: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` for archives and their contents."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    rows: list[tuple] = []
    held = 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for archive, content in batches:
        for offset, length, fields, block, reason in salvage(content):
            if fields is None:
                rows.append((archive, "gap", offset, length, *[None] * 8, reason))
            else:
                payload, told = payload_of(fields, block)
                get = fields.get
                rows.append((
                    archive, "record", offset, length, get("warc-type"), get("warc-record-id"), get("warc-refers-to"),
                    get("warc-target-uri"), get("warc-date"), get("warc-payload-digest"), told, payload, None,
                ))
                held += len(payload)
            if held >= _BATCH or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, held = [], 0
    if rows:
        yield batch_of(rows)


def read_archives(spark: SparkSession, archives: str | list[str]) -> DataFrame:
    """Records (``kind`` record) and quarantined byte gaps (``kind`` gap) of archives, with
    ``reason`` for gaps.  ``archives`` are paths, folders or patterns.  An archive is read by
    one task and held in its memory, so it is below 2 GiB; no archives give no rows; an
    empty archive has none."""
    if not archives:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").load(archives).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _records((a, c.as_py() or b"") for b in batches for a, c in zip(b.column(0).to_pylist(), b.column(1), strict=True))

    return files.mapInArrow(run, SCHEMA)


def read_manifest(manifest: DataFrame, most_tasks: int = 10_000) -> DataFrame:
    """As ``read_archives``, for the archives that a manifest of ``write_archives`` lists:
    the tasks open them, and the driver learns only how many there are."""
    tasks = max(1, min(manifest.count(), most_tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def contents() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for archive in batch.column(0).to_pylist():
                    system, path = _open(archive)
                    with system.open_input_stream(path, compression=None) as file:
                        yield archive, file.read()

        yield from _records(contents())

    return manifest.select("archive").repartition(tasks).mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page to archives in the shared folder and read the archives back.

    An empty table writes no archive and gives no rows; columns other than the three are
    not read.  Null ids, and ids and URLs of any length and characters, come back as they
    were, but for control characters and blanks at the ends of a URL, which come back
    percent-encoded.
    """
    return read_manifest(write_archives(plan_pages(pages, page_id, url, html), fresh_path(pages.sparkSession, "warc")))
