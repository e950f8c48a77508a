"""Names, labels and places: what is safe in a file name, on one line, or on a grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_NAME, MOST_BYTES = 110, 200
# Names that some file systems keep for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{port}{n}" for port in ("COM", "LPT") for n in range(1, 10)))
# Letters that converters write as one sign, and signs that are no letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "\u00ad": "", "\u200b": ""}
ROWS, COLUMNS = ("top", "middle", "bottom"), ("left", "centre", "right")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _fitting(name: Column, most: Column, most_bytes: Column) -> Column:
    """The longest beginning of ``name`` of so many characters and bytes, without blanks and dots at its end."""
    sizes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.length(name), most)))
    size = F.array_max(F.filter(sizes, lambda k: F.octet_length(F.substr(name, F.lit(1), k)) <= most_bytes))
    return F.regexp_replace(F.substr(name, F.lit(1), size), r"[. ]+$", "")


def safe_name(name: Column, most: int = MOST_NAME, most_bytes: int = MOST_BYTES) -> Column:
    """A name for a file: signs that file systems refuse are blanks, spacing is single, dots and
    blanks at the ends go; a name kept for a device gets an underscore, nothing is ``untitled``.
    One of over ``most`` characters or ``most_bytes`` bytes is cut between characters, before an
    extension of eight characters or fewer.  Letters stay composed or not, as they are."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f\x{2028}\x{2029}]', " ")
    bare = F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), r"^[. ]+|[. ]+$", "")
    named = F.coalesce(F.nullif(bare, F.lit("")), F.lit("untitled"))
    device = lambda n: F.upper(F.substring_index(n, ".", 1)).isin(*RESERVED)
    parted = lambda n: F.struct(n.alias("name"), F.regexp_extract(n, r"^.+(\.[^.]{1,8})$", 1).alias("end"))

    def cut(p: Column) -> Column:
        stem = F.substr(p["name"], F.lit(1), F.length(p["name"]) - F.length(p["end"]))
        short = F.concat(_once(stem, lambda s: _fitting(s, most - F.length(p["end"]), most_bytes - F.octet_length(p["end"]))), p["end"])
        return F.when((F.length(p["name"]) > most) | (F.octet_length(p["name"]) > most_bytes), short).otherwise(p["name"])

    whole = _once(named, lambda n: F.when(device(n), F.concat(F.lit("_"), n)).otherwise(n))
    return F.coalesce(F.nullif(_once(_once(whole, parted), cut), F.lit("")), F.lit("untitled"))


def without_controls(text: Column) -> Column:
    """A text without control characters other than tab and line feed."""
    return F.regexp_replace(text, r"[\p{Cntrl}&&[^\t\n]]", "")


def inline(text: Column) -> Column:
    """A text on one line."""
    return F.trim(F.regexp_replace(without_controls(F.coalesce(text, F.lit(""))), r"\s+", " "))


def clean_text(text: Column) -> Column:
    """A converter's text in plain form: ligatures as letters, words that a line end parts joined, all
    line ends as line feeds, no other control characters but tabs, no blanks before line ends, at most one blank line, none at the ends, and a
    sign ``#`` at the start of a line marked as no heading.  Null is empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    out = F.regexp_replace(out, r"(?U)(\w)-\n([a-z])", "$1$2")
    lines = F.regexp_replace(out, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", "\n")
    lines = F.regexp_replace(F.regexp_replace(without_controls(lines), r"(?U)[\s&&[^\n]]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?Umd)^([\s&&[^\n]]*)#", r"$1\\#"), r"(?U)^\s+|\s+$", "")


def window_around(text: Column, at: Column, most: int = 320) -> Column:
    """At most ``most`` characters around place ``at`` (from 0), with an ellipsis where some are left out."""
    start = F.greatest(F.lit(0), at - most // 2)
    end = F.least(F.length(text), start + most)
    cut = F.trim(F.substring(text, start.cast("int") + 1, (end - start).cast("int")))
    some = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(some)


def region(x: Column, y: Column) -> Column:
    """The part of a page, of three by three, that a point with coordinates from 0 to 1 is in."""
    nth = lambda c: F.least(F.greatest(F.floor(c * 3), F.lit(0)), F.lit(2)).cast("int") + 1
    name = lambda names, c: F.element_at(F.array(*map(F.lit, names)), nth(c))
    return F.concat_ws(" ", name(ROWS, y), name(COLUMNS, x))


def first_wins(entries: Column) -> Column:
    """A map of an array of ``(key, value)`` structs; of equal keys the first counts."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter(entries, lambda e: e["key"] == k)[0]["value"])))
