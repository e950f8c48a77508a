"""Discussion threads: nested replies of any depth as ordered rows, and rows as a nested list."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FIELDS = (
    "position int, depth int, path array<int>, id string, parent string, author_id string, author string, "
    "message string, created_at string, deleted boolean, error string"
)
NO_REPLIES, UNREADABLE = "_No replies yet._", "_Couldn't read the replies._"


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def _entries(view: dict) -> Iterator[dict]:
    """A thread's replies, each before its answers; late ones that the tree lacks come last."""
    people = {str(p.get("id")): p.get("display_name") for p in view.get("participants") or [] if isinstance(p, dict)}
    seen: set = set()
    position = 0
    tops = [e for e in view.get("view") or [] if isinstance(e, dict)]
    for late in (False, True):
        if late:
            first = len(tops)
            tops = [e for e in view.get("new_entries") or [] if isinstance(e, dict) and e.get("id") not in seen]
        else:
            first = 0
        open_ = [(e, [first + n], None) for n, e in enumerate(tops)][::-1]
        while open_:
            entry, path, parent = open_.pop()
            own, author = _text(entry.get("id")), _text(entry.get("user_id"))
            seen.add(entry.get("id"))
            yield {
                "position": position, "depth": len(path) - 1, "path": path, "id": own, "parent": parent, "author_id": author,
                "author": people.get(author), "message": _text(entry.get("message")), "created_at": _text(entry.get("created_at")),
                "deleted": bool(entry.get("deleted")), "error": None,
            }
            position += 1
            answers = [e for e in entry.get("replies") or [] if isinstance(e, dict)]
            open_ += [(e, [*path, n], own) for n, e in enumerate(answers)][::-1]


def replies(threads: DataFrame, key: str, body: str) -> DataFrame:
    """A row for each reply of each thread, in the order of reading.

    ``body`` is JSON ``{view: [{id, user_id, message, created_at, deleted, replies: [...]}], participants:
    [{id, display_name}], new_entries: [...]}``, nested as deep as it likes.  ``position`` counts from 0,
    ``path`` holds the number of a reply among its siblings at each depth.  A thread is read where it is,
    in one pass without a shuffle.  A null or empty ``body`` has no rows; one that is no such JSON, or
    nested beyond what the parser takes, has one row with ``error`` and no position.
    """
    schema = StructType([threads.schema[key], *StructType.fromDDL(FIELDS)])
    target = to_arrow_schema(schema)
    blank = dict.fromkeys(schema.names)

    def read(own: object, text: str) -> Iterator[dict]:
        try:
            view = json.loads(text)
        except (ValueError, RecursionError):
            view = None
        if isinstance(view, dict):
            yield from ({key: own, **row} for row in _entries(view))
        else:
            yield blank | {key: own, "error": "unreadable"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(read(row[key], row["__body"])), schema=target)

    said = threads.where(F.trim(F.col(body)) != "").select(F.col(key), F.col(body).alias("__body"))
    return said.mapInArrow(run, schema)


def _line(instructor: Column) -> Column:
    """A reply as list item, indented by its depth; further lines of a message stand below it."""
    indent = F.repeat(F.lit("  "), F.col("depth"))
    who = F.concat(F.coalesce("author", F.lit("Someone")), F.when(instructor, " (Instructor)").otherwise(""))
    day = F.coalesce(F.concat(F.lit(" · "), F.substring("created_at", 1, 10)), F.lit(""))
    head = F.concat(indent, F.lit("- **"), who, F.lit("**"), day, F.lit(":"))
    message = F.regexp_replace(F.coalesce("message", F.lit("")), r"^\s+|\s+$", "")
    lines = F.transform(F.split(message, r"\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    below = F.array_join(F.transform(lines, lambda x: F.when(x == "", "").otherwise(F.concat(indent, F.lit("  "), x))), "\n")
    return (
        F.when(F.col("deleted"), F.concat(indent, F.lit("- _(deleted reply)_"))).when(message == "", head)
        .when(F.size(lines) == 1, F.concat(head, F.lit(" "), message)).otherwise(F.concat(head, F.lit("\n"), below))
    )


def render(threads: DataFrame, rows: DataFrame, key: str, instructors: DataFrame | None = None) -> DataFrame:
    """``threads`` with ``markdown``: their replies as one nested list.

    ``instructors`` (author_id) are named as such.  A thread without rows says that there are no
    replies, one that could not be read says so.  A thread's replies came in one row and become one.
    """
    marked = rows.withColumn("__teaches", F.lit(False))
    if instructors is not None:
        known = instructors.select("author_id").distinct().withColumn("__known", F.lit(True))
        marked = rows.join(known, "author_id", "left").withColumn("__teaches", F.coalesce("__known", F.lit(False)))
    lines = marked.select(key, F.struct("position", _line(F.col("__teaches")).alias("line")).alias("l"), "error")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.col("l")))), lambda x: x["line"]), "\n")
    said = lines.groupBy(key).agg(F.when(F.max("error").isNotNull(), UNREADABLE).otherwise(whole).alias("markdown"))
    return threads.join(said, key, "left").withColumn("markdown", F.coalesce("markdown", F.lit(NO_REPLIES)))
