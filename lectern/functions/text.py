"""Text expressions: tokens, folds, locators, sentences, ranges of unit numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

# Words that a query of two or more words does without.
STOP_WORDS = (
    "a an and are as at be by can could did do does for from had has have how i if in into is it its me my of on or our "
    "please should so than that the their them then there these this those to was were what when where which who why "
    "will with would you your about explain tell show find give list"
).split()

# Typographic signs and the plain signs that they fold to.
QUOTE_SIGNS = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ",
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order; stop words go where two or more words are left
    to choose from and one of them is no stop word.  ``"quoted words"`` stay together, and
    ``word*`` keeps its star: it stands for the words that begin so."""
    import re

    found = [(m[1], m[2]) for m in re.finditer(r'"([^"]+)"|([^\W_]+\*?)', query.lower())]
    terms = [" ".join(re.findall(r"[^\W_]+", phrase)) if phrase else word for phrase, word in found]
    terms = [t for t in dict.fromkeys(terms) if t]
    useful = [t for t in terms if t not in STOP_WORDS]
    return useful if len(terms) > 1 and useful else terms


def simple_fold(text: Column) -> Column:
    """Lower case with every run of other signs than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def quote_fold(text: Column) -> Column:
    """What a quotation is compared by: typographic signs, emphasis marks, link targets,
    case and spacing do not count."""
    out = F.translate(text, "".join(QUOTE_SIGNS), "".join(QUOTE_SIGNS.values()))
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"\*\*|__|`", "")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def evidence_size(folded: Column) -> Column:
    """Letters and digits in a folded quotation."""
    return F.length(F.regexp_replace(folded, r"[^\p{L}\p{N}]", ""))


def norm_locator(locator: Column) -> Column:
    """Locator as it is compared: no brackets, marks or trailing colon, one spacing, lower case."""
    out = F.regexp_replace(locator, r"^[#\s]+|[\[\]*`]", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"[:.\s]+$", "")))


def course_of(path: Column) -> Column:
    """The first two segments of a path of three or more, else null."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.slice(parts, 1, 2)))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(~bad & ~path.contains("\\") & ~path.contains("\u0000"), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences of a text: split after an end mark and space, at bullets and at blank lines."""
    parts = F.split(F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"\n\s*[-*•]\s+|\n\s*\n|(?<=[.!?])\s+(?=[\"'(0-9\p{Lu}])")
    trimmed = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(trimmed, lambda s: s != "")


def truncated(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last an ellipsis where some are left out."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…")))


def unit_numbers(text: Column, kinds: str = "slides?|pages?|pp?") -> Column:
    """Numbers that references such as ``Slides 4-6, 9`` or ``[S12]`` name, in order.

    A range counts up to 500 units and only if it ascends.
    """
    lists = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{kinds})\.?\s*(\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–]\s*\d+)?)*)"), F.lit(1))
    short = F.regexp_extract_all(text, F.lit(r"\[[SP](\d{1,6}(?:[-–]\d{1,6})?)\]"), F.lit(1))
    spans = F.split(F.concat_ws(",", lists, short), r"\s*,\s*")

    def numbers(span: Column) -> Column:
        ends = F.split(span, r"\s*[-–]\s*")
        low, high = ends[0].try_cast("int"), F.coalesce(F.get(ends, F.lit(1)).try_cast("int"), ends[0].try_cast("int"))
        return F.when(low.isNotNull() & (high >= low) & (high - low < 500), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, numbers))))


def iso_time(text: Column) -> Column:
    """A timestamp from ISO 8601 text; a date where the time is unusable; else null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 1, 10)))


def clock(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def percent(score: Column, possible: Column) -> Column:
    """100 score / possible, to one decimal; null where nothing was possible."""
    return F.round(F.try_divide(score * 100.0, F.nullif(possible, F.lit(0.0))), 1)


# Formats of lines that are there for the tool and not for the reader.
PLUMBING = (
    r"(?m)^> Some pages or slides are visual \(see the '> Visual content' markers\)\.[^\n]*\n?",
    r"(?m)^Original file: [^\n]+\n",
)
# Fixed value: format of a visual note, of which the reasons stay.
VISUAL_LINE = r"(?m)^> Visual content: (.+?)\. View (?:the (?:page|slide) image for exact details|it directly)\.[ \t]*$"
# Fixed value: format of a link to an extracted picture, of which the name stays.
ASSET_LINK = r"\[(Slide \d+ image \d+[^\]\n]*)\]\((?:[^)\s]*\.assets/[^)\s]+)\)"


def reading_view(text: Column) -> Column:
    """A text for reading: no plumbing, short visual notes and picture links, one blank line."""
    out = text
    for pattern in PLUMBING:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, VISUAL_LINE, "> Visual: $1"), ASSET_LINK, "$1")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def markdown_row(*columns: Column) -> Column:
    """Columns as a row of a Markdown table; bars and line breaks are escaped."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
