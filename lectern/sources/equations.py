"""Equations of office files as one line of plain text: fractions as a/b, powers with ^, lower marks with _.

A tree of equation elements is read from its leaves up, so its depth does not matter.
"""

from __future__ import annotations

import re
from itertools import accumulate
from xml.etree.ElementTree import Element

MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

# What stands before each part of an element, the part, and whether it is put in brackets.
FORMS = {
    "f": (("", "num", True), ("/", "den", True)),
    "sSub": (("", "e", True), ("_", "sub", True)),
    "sSup": (("", "e", True), ("^", "sup", True)),
    "sSubSup": (("", "e", True), ("_", "sub", True), ("^", "sup", True)),
    "sPre": (("_", "sub", True), ("^", "sup", True), ("", "e", True)),
    "func": (("", "fName", False), ("", "e", True)),
    "limLow": (("", "e", False), ("_", "lim", True)),
    "limUpp": (("", "e", False), ("^", "lim", True)),
    "bar": (("bar", "e", True),),
}
# The signs of elements that name none.
SIGNS = {"nary": "∫", "acc": "̂", "groupChr": "⏟", "begChr": "(", "endChr": ")", "sepChr": "|"}
ONE_SIGN = re.compile(r"[\w.′'*∞]+|.")  # fixed value: what needs no brackets
CLOSING = {"(": ")", "[": "]", "{": "}"}


def bracketed(text: str) -> str:
    """``text`` in brackets, unless it is one word or sign, or in brackets already."""
    text = text.strip()
    depth = list(accumulate((c in "([{") - (c in ")]}") for c in text))
    whole = len(text) > 1 and CLOSING.get(text[0]) == text[-1] and 0 not in depth[:-1]
    return text if whole or ONE_SIGN.fullmatch(text) else f"({text})"


def linear(root: Element) -> str:
    """The text of ``root``; parts that are missing leave nothing but the stroke of a fraction."""
    done: dict[Element, str] = {}
    for el in reversed(list(root.iter())):
        done[el] = _joined(el, done)
    return done[root]


def _joined(el: Element, done: dict[Element, str]) -> str:
    name = el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""

    def part(role: str) -> str | None:
        found = el.find(MATH + role)
        return None if found is None else done[found]

    def sign(of: str) -> str:
        own = el.find(f"{MATH}{name}Pr/{MATH}{of if of.endswith('Chr') and of != name else 'chr'}")
        return SIGNS[of] if own is None else own.get(f"{MATH}val", SIGNS[of])

    every = lambda role: [done[x] for x in el.findall(MATH + role)]
    if name == "t":
        return el.text or ""
    if name.endswith("Pr"):
        return ""
    if name in FORMS:
        given = [(mark, part(role), closed) for mark, role, closed in FORMS[name]]
        return "".join(
            mark + (bracketed(text) if closed else text) if text is not None else mark * (name in ("f", "bar", "limLow", "limUpp"))
            for mark, text, closed in given
        )
    if name == "nary":
        bounds = "".join(mark + bracketed(text) for mark, role in (("_", "sub"), ("^", "sup")) if (text := part(role)) and text.strip())
        return f"{sign(name)}{bounds} {part('e') or ''}".rstrip()
    if name == "rad":
        degree = (part("deg") or "").strip()
        return f"{'root' + bracketed(degree) if degree else '√'}({part('e') or ''})"
    if name == "d":
        return sign("begChr") + sign("sepChr").join(every("e")) + sign("endChr")
    if name in ("acc", "groupChr"):
        inner = part("e")
        return ("" if inner is None else bracketed(inner)) + sign(name)
    if name == "eqArr":
        return "; ".join(every("e"))
    if name == "mr":
        return ", ".join(every("e"))
    if name == "m":
        return f"[{'; '.join(every('mr'))}]"
    return "".join(done[x] for x in el)


def equation_text(el: Element) -> str:
    """All equations in ``el``, each on one line, with semicolons between them."""
    found = [el] if el.tag == f"{MATH}oMath" else el.iter(f"{MATH}oMath")
    return "; ".join(text for text in (" ".join(linear(x).split()) for x in found) if text)


def in_words(el: Element) -> str:
    """An equation as it stands in the text of a document."""
    text = equation_text(el)
    return f" [equation: {text}] " if text else " [equation] "
