"""File sources: kinds by name, Markdown with front matter, notebooks, archives, delimited text."""

from __future__ import annotations

import csv
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of each kind.
KINDS = {
    "media": "mp4 mov m4v mkv webm avi mp3 m4a wav aac flac ogg", "image": "png jpg jpeg gif webp bmp tif tiff heic",
    "pdf": "pdf epub", "slides": "pptx", "document": "docx", "spreadsheet": "xlsx xlsm", "csv": "csv tsv",
    "notebook": "ipynb", "web": "html htm", "archive": "zip", "legacy": "doc ppt xls rtf odt odp",
    "text": "txt md py r java c cpp js sql tex json xml yaml yml log",
}
MEMBERS, MEMBER_BYTES = 2_000, 1 << 30  # of an archive at most
TEXT_BYTES = 2 << 20
SHOWN_ROWS, SHOWN_COLUMNS = 300, 60


def kind_of(path: Column, content_type: Column | None = None) -> Column:
    """The kind of a file by its ending, else by its content type, else unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lower(F.coalesce(content_type if content_type is not None else F.lit(""), F.lit("")))
    out = None
    for kind, endings in KINDS.items():
        test = ending.isin(endings.split())
        out = F.when(test, kind) if out is None else out.when(test, kind)
    for part, kind in {"pdf": "pdf", "image/": "image", "video/": "media", "audio/": "media", "html": "web", "zip": "archive", "text/": "text"}.items():
        out = out.when(F.contains(mime, F.lit(part)), kind)
    return out.otherwise("unknown")


def markdown_files(spark: SparkSession, root: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """``(path, text)`` of Markdown below ``root``; hidden folders, asset folders and those in
    ``skipped`` are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/*", "/")
    below = F.expr(f"substring(path, length('{root.removeprefix('file://').rstrip('/')}') + 2)")
    parts = F.split("path", "/")
    rows = rows.select(path.alias("path"), F.col("value").alias("text")).withColumn("path", below)
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | F.endswith(p, F.lit(".assets")) | p.isin(*skipped or ("",)))
    return rows.where(~hidden)


def front_matter(text: Column) -> tuple[Column, Column]:
    """Front matter as a map, and the body.  Quoted values are read as JSON strings; of a
    repeated key the first counts; the map is null without front matter."""
    head = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---\n?", 1)
    entries = F.filter(F.split(head, "\n"), lambda line: line.rlike(r"^[A-Za-z_][\w-]*:\s?"))
    name = lambda line: F.regexp_extract(line, r"^([^:]+):", 1)

    def value(line: Column) -> Column:
        raw = F.regexp_extract(line, r"^[^:]+:\s*(.*)$", 1)
        quoted = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        return F.when(raw.rlike(r'^".*"$'), F.coalesce(quoted, F.regexp_replace(raw, r'^"(.*)"$', "$1"))).otherwise(raw)

    names = F.array_distinct(F.transform(entries, name))
    first = F.transform(names, lambda k: F.struct(k, value(F.filter(entries, lambda line: name(line) == k)[0])))
    return F.when(head != "", F.map_from_entries(first)), F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n?", "")


def emit_front_matter(meta: Column) -> Column:
    """Front matter of a map, by key."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def notebook_cells(notebooks: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, cell_no, cell_type, source)`` of every cell that is not empty."""
    schema = "cells array<struct<cell_type: string, source: array<string>>>"
    one = "cells array<struct<cell_type: string, source: string>>"
    rows = notebooks.select(key, F.from_json(text, schema).alias("n"), F.from_json(text, one).alias("o"))
    cells = rows.select(key, F.posexplode("n.cells").alias("cell_no", "cell"), F.col("o.cells").alias("plain"))
    source = F.coalesce(F.array_join("cell.source", ""), F.get("plain", F.col("cell_no"))["source"])
    return cells.select(key, "cell_no", F.col("cell.cell_type").alias("cell_type"), F.trim(source).alias("source")).where("source <> ''")


def zip_members(spark: SparkSession, paths: str | list[str], most: int = MEMBERS, most_bytes: int = MEMBER_BYTES) -> DataFrame:
    """``(archive, member, size, content, error)`` of zip files.

    ``error`` says why there is no content: the archive is unreadable, has more than ``most``
    members or more than ``most_bytes``; a member's name leaves the archive, it is encrypted,
    or it is damaged.  An archive without error has null there."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = ["archive", "member", "size", "content", "error"]

    def members(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            yield path, None, None, None, "unreadable archive"
            return
        infos = [i for i in archive.infolist() if not i.is_dir()]
        if len(infos) > most or sum(i.file_size for i in infos) > most_bytes:
            yield path, None, None, None, "too many members" if len(infos) > most else "too large"
            return
        for info in infos:
            name, data, error = info.filename.replace("\\", "/"), None, None
            if name.startswith("/") or ".." in name.split("/"):
                error = "leaves the archive"
            elif info.flag_bits & 1:
                error = "encrypted"
            else:
                try:
                    data = archive.read(info)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
                    error = "damaged member"
            yield path, name, info.file_size, data, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in members(path, content.as_py() or b""):
                    rows.append(row)
                    held += len(row[3] or b"")
                    if held > 8 << 20:
                        yield batch_of()
                        rows, held = [], 0
        if rows:
            yield batch_of()

    return files.mapInArrow(run, "archive string, member string, size long, content binary, error string")


def delimited_tables(
    files: DataFrame, key: str, text: str, most_rows: int = SHOWN_ROWS, most_columns: int = SHOWN_COLUMNS, most_characters: int = TEXT_BYTES
) -> DataFrame:
    """``(key, row_no, cells, delimiter, rows, columns, cut)`` of delimited texts; the delimiter of
    each is found from its first lines.  At most ``most_rows`` rows and ``most_columns``
    columns show; ``rows`` and ``columns`` are how many there are, and ``cut`` says whether
    the text was longer than ``most_characters`` and its end not read."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, body in zip(batch[key], batch[text], strict=True):
                cut, body = len(body or "") > most_characters, (body or "")[:most_characters]
                try:
                    mark = csv.Sniffer().sniff(body[:4096], ",\t;|").delimiter
                except csv.Error:
                    mark = ","
                shown, rows, columns = [], 0, 0
                for cells in csv.reader(io.StringIO(body), delimiter=mark):
                    rows, columns = rows + 1, max(columns, len(cells))
                    if rows <= most_rows:
                        shown.append(cells[:most_columns])
                if shown:
                    same = {"delimiter": mark, "rows": rows, "columns": columns, "cut": cut}
                    yield pd.DataFrame({key: [own] * len(shown), "row_no": range(len(shown)), "cells": shown} | {k: [v] * len(shown) for k, v in same.items()})

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, row_no int, cells array<string>, delimiter string, rows long, columns int, cut boolean")


# The language that a code file's ending is fenced with, where it is not the ending itself.
FENCES = {"py": "python", "js": "javascript", "md": "markdown", "yml": "yaml", "txt": ""}


def text_files(spark: SparkSession, root: str, most: int = TEXT_BYTES) -> DataFrame:
    """``(path, language, text, cut)`` of text and code below ``root``: the first ``most``
    characters as a fenced block, and whether there are more."""
    endings = KINDS["text"].replace(" ", ",")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{endings}}}").text(root, wholetext=True)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*(F.lit(v) for pair in FENCES.items() for v in pair))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("language", F.coalesce(F.element_at(named, ending), ending))
    body = F.concat(F.lit("```"), "language", F.lit("\n"), F.regexp_replace(F.substring("value", 1, most), r"\s+$", ""), F.lit("\n```"))
    return rows.select("path", "language", body.alias("text"), (F.length("value") > most).alias("cut"))


def json_store(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The entries of JSON files, an object or array a file; a file that is no JSON gives one
    row whose ``_corrupt_record`` holds it, if the schema names that column."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def folder_listing(entries: DataFrame, name: str = "name", is_folder: str = "is_folder") -> DataFrame:
    """Entries of a folder in the order they are shown: folders first, then by name without
    case; hidden ones and asset folders are left out."""
    hidden = F.startswith(F.col(name), F.lit(".")) | (F.col(is_folder) & F.endswith(F.col(name), F.lit(".assets")))
    return entries.where(~hidden).orderBy(~F.col(is_folder), F.lower(name), name)


def write_if_changed(rows: DataFrame, folder: str, key: str, content: str) -> DataFrame:
    """Append the rows whose content is not the newest that ``folder`` has for their key;
    the rows that were written."""
    from lectern.storage import materialize

    spark = rows.sparkSession
    fresh = rows.select(key, content, F.sha2(F.col(content), 256).alias("digest"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.parquet(folder).groupBy(key).agg(F.max("version").alias("version"), F.max_by("digest", "version").alias("had"))
        joined = fresh.join(old, key, "left").where("had is null or had <> digest")
        fresh = joined.select(key, content, "digest", (F.coalesce("version", F.lit(0)) + 1).alias("version"))
    else:
        fresh = fresh.withColumn("version", F.lit(1))
    changed = materialize(fresh, "changed")
    if not changed.isEmpty():
        changed.write.mode("append").parquet(folder)
    return changed


def canonical_json(value: object) -> str:
    """JSON with sorted keys, for digests."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
