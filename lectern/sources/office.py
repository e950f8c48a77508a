"""Office files as sectioned text: paragraphs of documents, slides in order, sheets as tables.

The files are zip archives of XML; the standard library reads them, a batch at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from lectern.sources.equations import MATH, in_words
from lectern.sources.files import SHOWN_COLUMNS, SHOWN_ROWS

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id to member name, for the relations of ``part``."""
    folder, _, name = part.rpartition("/")
    try:
        tree = ElementTree.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.get("Id", ""): f"{folder}/{r.get('Target', '')}".replace(f"{folder}//", "") for r in tree}


def _resolved(archive: zipfile.ZipFile, part: str, kind: str) -> list[str]:
    """Member names of the relations of ``part`` that are of a ``kind``, steps up followed."""
    folder, _, name = part.rpartition("/")
    try:
        tree = ElementTree.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return []
    out = []
    for relation in tree:
        if relation.get("Type", "").endswith(f"/{kind}"):
            steps = [] if relation.get("Target", "").startswith("/") else folder.split("/")
            for step in relation.get("Target", "").strip("/").split("/"):
                steps = steps[:-1] if step == ".." else [*steps, step]
            out.append("/".join(steps))
    return out


def table_text(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table; short rows are filled up, line ends are spaces."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(" ".join(c.split()).replace("|", "\\|") for c in [*row, *[""] * (width - len(row))]) + " |" for row in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _said(block: ElementTree.Element, letters: str) -> str:
    """A paragraph's text with its equations where they stand."""
    out, inside = [], set()
    for el in block.iter():
        if el in inside:
            continue
        if el.tag in (f"{MATH}oMathPara", f"{MATH}oMath"):
            inside.update(el.iter())
            out.append(in_words(el))
        elif el.tag == letters:
            out.append(el.text or "")
    return "".join(out).strip()


def document_text(archive: zipfile.ZipFile) -> str:
    """Paragraphs, headings and tables in order; a table in a cell is part of the cell's text."""
    lines, inside = [], set()
    for block in ElementTree.fromstring(archive.read("word/document.xml")).iter():
        if block in inside:
            continue
        if block.tag == f"{WORD}tbl":
            inside.update(block.iter())
            cells = [[" ".join(_said(p, f"{WORD}t") for p in cell.iter(f"{WORD}p")) for cell in row.findall(f"{WORD}tc")] for row in block.findall(f"{WORD}tr")]
            lines.append(table_text(cells))
        elif block.tag == f"{WORD}p":
            text, style = _said(block, f"{WORD}t"), block.find(f"{WORD}pPr/{WORD}pStyle")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{WORD}val", "")) if style is not None else None
            lines.append(f"{'#' * int(level[1])} {text}" if level and text else text)
    return "\n\n".join(line for line in lines if line)


def _number(text: str) -> str:
    try:
        return f"{float(text):.6g}"
    except ValueError:
        return text


def chart_text(archive: zipfile.ZipFile, part: str) -> str:
    """A chart's kind and title, and its series as a table: by category, or by points."""
    plot = ElementTree.fromstring(archive.read(part)).find(f"{CHART}chart")
    if plot is None:
        return ""
    kinds = [el for el in plot.iter() if el.tag.startswith(CHART) and el.tag.endswith("Chart")]
    title = "".join(t.text or "" for head in plot.findall(f"{CHART}title") for t in head.iter(f"{DRAW}t")).strip()
    first = f"Chart ({kinds[0].tag[len(CHART):-5].lower() if kinds else 'chart'}){': ' + title if title else ''}"

    def points(series: ElementTree.Element, role: str) -> dict[int, str]:
        found = series.find(CHART + role)
        return {} if found is None else {int(x.get("idx", "0")): x.findtext(f"{CHART}v", "") for x in found.iter(f"{CHART}pt")}

    every = [s for kind in kinds for s in kind.findall(f"{CHART}ser")]
    names = [points(s, "tx").get(0) or s.findtext(f"{CHART}tx/{CHART}v") or f"Series {n}" for n, s in enumerate(every, 1)]
    if any(s.find(f"{CHART}xVal") is not None for s in every):
        rows = [["Series", "x", "y"]]
        for name, series in zip(names, every, strict=True):
            x, y = points(series, "xVal"), points(series, "yVal")
            rows += [[name, _number(x.get(at, "")), _number(y.get(at, ""))] for at in sorted(x.keys() | y.keys())]
    else:
        values = [points(s, "val") for s in every]
        labels = {at: name for s in every for at, name in points(s, "cat").items()}
        places = sorted(set(labels).union(*values))
        rows = [["Category", *names], *([labels.get(at, ""), *(_number(v.get(at, "")) for v in values)] for at in places)]
    return f"{first}\n\n{table_text(rows)}" if len(rows) > 1 else first


def slides_text(archive: zipfile.ZipFile) -> str:
    """Slides in the order of the show: their lines, tables, charts and speaker notes."""
    main = "ppt/presentation.xml"
    targets, out = _targets(archive, main), []
    for number, mark in enumerate(ElementTree.fromstring(archive.read(main)).iter(f"{SLIDE}sldId"), 1):
        part = targets[mark.get(LINK, "")]
        tree, lines, tables, inside = ElementTree.fromstring(archive.read(part)), [], [], set()
        for el in tree.iter():
            if el in inside:
                continue
            if el.tag == f"{DRAW}tbl":
                inside.update(el.iter())
                tables.append(table_text([[" ".join(_said(p, f"{DRAW}t") for p in c.iter(f"{DRAW}p")) for c in row.findall(f"{DRAW}tc")] for row in el.findall(f"{DRAW}tr")]))
            elif el.tag == f"{DRAW}p":
                lines.append(_said(el, f"{DRAW}t"))
        lines = [line for line in lines if line]
        title = lines[0] if lines else ""
        head = f"## [Slide {number}] {title}".rstrip() + (" (hidden slide)" if tree.get("show") == "0" else "")
        block = ["\n".join([head, *lines[1:]]), *tables, *(chart_text(archive, c) for c in _resolved(archive, part, "chart"))]
        for member in _resolved(archive, part, "notesSlide"):
            # the body of the notes, and neither the page number nor the picture of the slide
            shapes = ElementTree.fromstring(archive.read(member)).iter(f"{SLIDE}sp")
            bodies = [s for s in shapes if (kind := s.find(f".//{SLIDE}ph")) is not None and kind.get("type") == "body"]
            noted = [line for s in bodies for p in s.iter(f"{DRAW}p") if (line := _said(p, f"{DRAW}t"))]
            block += ["Speaker notes:", "\n".join(noted)] if noted else []
        out.append("\n\n".join(x for x in block if x))
    return "\n\n".join(out)


def sheets_text(archive: zipfile.ZipFile) -> str:
    """Sheets as rows of cells, then their formulas; what is left out for size is said."""
    try:
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
    except KeyError:
        shared = []
    targets, out = _targets(archive, "xl/workbook.xml"), []
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
        rows, formulas, height, width = [], [], 0, 0
        for row in ElementTree.fromstring(archive.read(targets[sheet.get(LINK, "")])).iter(f"{SHEET}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{SHEET}c"):
                letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                value = cell.find(f"{SHEET}v")
                text = "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if value is None else value.text or ""
                cells[at - 1] = shared[int(text)] if cell.get("t") == "s" and text else text
                if (formula := cell.findtext(f"{SHEET}f")) and len(rows) < SHOWN_ROWS and at <= SHOWN_COLUMNS:
                    formulas.append(f"- {cell.get('r')}: `={formula}`")
            height, width = height + bool(cells), max(width, max(cells, default=-1) + 1)
            if len(rows) < SHOWN_ROWS and cells:
                rows.append(" | ".join(cells.get(i, "") for i in range(min(max(cells) + 1, SHOWN_COLUMNS))))
        block = [f"## [Sheet: {sheet.get('name')}]", *rows]
        if width > SHOWN_COLUMNS:
            block.append(f"\n(Showing the first {SHOWN_COLUMNS} of {width} columns; the original file has the rest.)")
        if height > len(rows):
            block.append(f"\n(Showing the first {len(rows)} of {height} rows.)")
        if formulas:
            block += ["", "Formulas (cell: formula):", "", *formulas]
        out.append("\n".join(block))
    return "\n\n".join(out)


READERS = {"document": document_text, "slides": slides_text, "spreadsheet": sheets_text}


def office_text(files: DataFrame, key: str, kind: str, content: str) -> DataFrame:
    """``(key, text, error)`` of office files by their kind; damaged ones, and kinds without a reader, have an error."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, what, data in zip(batch[key], batch[kind], batch[content], strict=True):
                try:
                    rows.append((own, READERS[what](zipfile.ZipFile(io.BytesIO(data or b""))), None))
                except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((own, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[key, "text", "error"])

    return files.select(key, kind, content).mapInPandas(run, schema)
