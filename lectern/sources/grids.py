"""Tables in HTML as rows of a grid, with cells that span rows or columns in every place they cover."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MOST_COLUMNS, MOST_ROWS = 50, 200  # fixed values: as far as a cell may span
UNSEEN = {"script", "style", "template"}
FIELDS = "table_no int, row_no int, col_no int, text string, header boolean, repeated boolean"


class _Cells(HTMLParser):
    """Tables as lists of rows of ``[parts, header, columns, rows]`` cells; inner tables are tables too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[tuple[list[list[list]], list[list]]] = []  # a table and its open cell, if any
        self.unseen = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.unseen += tag in UNSEEN
        if tag == "table":
            self.tables.append([])
            self.open.append((self.tables[-1], []))
        elif self.open and tag in ("tr", "td", "th"):
            rows, cell = self.open[-1]
            cell.clear()
            if tag == "tr" or not rows:
                rows.append([])
            if tag != "tr":
                fields = dict(attrs)
                try:
                    wide, high = int(fields.get("colspan", 1)), int(fields.get("rowspan", 1))
                except (TypeError, ValueError):
                    wide = high = 1
                rows[-1].append([[], tag == "th", max(1, min(wide, MOST_COLUMNS)), max(1, min(high, MOST_ROWS))])
                cell.append(rows[-1][-1])

    def handle_endtag(self, tag: str) -> None:
        self.unseen -= tag in UNSEEN and self.unseen > 0
        if self.open and tag in ("td", "th", "tr"):
            self.open[-1][1].clear()
        elif self.open and tag == "table":
            self.open.pop()

    def handle_data(self, data: str) -> None:
        for _, cell in self.open:
            if cell and not self.unseen and data.strip():
                cell[0][0].append(" ".join(data.split()))


def _placed(rows: list[list[list]]) -> Iterator[dict]:
    """Cells at their places: a cell's text stands in its first column of each row it spans, its
    other columns are blank."""
    hanging: dict[int, list] = {}  # column: rows left, text
    for row_no, row in enumerate(rows):
        place, coming = 0, {}

        def put(text: str, header: bool, repeated: bool) -> dict:
            return {"row_no": row_no, "col_no": place, "text": text, "header": header, "repeated": repeated}  # noqa: B023

        for parts, header, wide, high in row:
            while place in hanging:
                yield put(hanging[place][1], header, True)
                place += 1
            text = " ".join(parts)
            for n in range(wide):
                if high > 1:
                    coming[place] = [high - 1, "" if n else text]
                yield put("" if n else text, header, n > 0)
                hanging.pop(place, None)
                place += 1
        for column in sorted(c for c in hanging if c >= place):
            yield put(hanging[column][1], False, True)
            place += 1
        hanging = {c: [left - 1, text] for c, (left, text) in hanging.items() if left > 1} | coming


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, table_no, row_no, col_no, text, header, repeated)``: a row for each place in the grid
    of each table of a page, all numbered from 0.

    ``repeated`` places are covered by a cell that begins elsewhere.  Spans that are no numbers are
    one.  Tables within tables come after the one around them, whose cell holds their text as well.
    Null or empty pages, and tables without cells, have no rows.  A page is read where it is, in
    one pass without a shuffle.
    """
    schema = StructType([pages.schema[key], *StructType.fromDDL(FIELDS)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = _Cells()
                reader.feed(row["__html"])
                reader.close()
                found = [{key: row[key], "table_no": n, **cell} for n, rows in enumerate(reader.tables) for cell in _placed(rows)]
                yield pa.RecordBatch.from_pylist(found, schema=target)

    return pages.where(F.col(html) != "").select(F.col(key), F.col(html).alias("__html")).mapInArrow(run, schema)


def as_markdown(grid: DataFrame, key: str) -> DataFrame:
    """``(key, table_no, markdown)`` of ``html_tables``: the first row heads the table."""
    cell = F.struct("col_no", F.replace("text", F.lit("|"), F.lit(r"\|")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["t"]), " | ")
    rows = grid.groupBy(key, "table_no", "row_no").agg(F.concat(F.lit("| "), joined, F.lit(" |")).alias("line"), F.count("*").cast("int").alias("n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.min_by("n", "row_no")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda r: r["line"])
    return rows.groupBy(key, "table_no").agg(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n").alias("markdown"))
