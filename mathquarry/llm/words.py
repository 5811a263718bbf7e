"""Words of a text and terms of a formula, as the problems define them."""

from __future__ import annotations

import re
import unicodedata
from xml.parsers import expat

import regex

REFERENCE = re.compile(r"<fid\b[^>]*>", re.I)
ASCII_WORD = re.compile(r"[a-z0-9]{2,}")
WORD = regex.compile(r"[\p{L}\p{N}]{2,}", regex.V0)
FORMAT = regex.compile(r"\p{Cf}+", regex.V0)


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null.

    Formula references go (each separates words), the text is brought to NFKC,
    characters of category Cf are dropped, letters lowered; words are the
    longest runs of letters and digits, two or more long.
    """
    if not text:
        return []
    if "<" in text:
        text = REFERENCE.sub(" ", text)
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower())


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def content_terms(xml: str | None) -> list[str]:
    """``opr:``, ``sym:`` and ``num:`` terms of content MathML in the order their elements end or first child begins.

    None for null, blank and not well-formed markup; an element without text
    has no ``sym:`` or ``num:`` term.
    """
    if not xml or not xml.strip():
        return []
    out: list[str] = []
    stack: list[list] = []  # [name, children so far, texts]

    def start(name, _):
        name = _local(name)
        if stack:
            top = stack[-1]
            if top[0] == "apply" and not top[1]:
                out.append("opr:" + name)
            top[1] += 1
        stack.append([name, 0, []])

    def end(_):
        name, _, texts = stack.pop()
        if name in ("ci", "cn"):
            text = "".join(texts).strip()
            if text:
                out.append(("sym:" if name == "ci" else "num:") + text)
        if stack:
            stack[-1][2] += texts

    def data(text):
        if stack:
            stack[-1][2].append(text)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, UnicodeEncodeError, ValueError):
        return []
    return out
