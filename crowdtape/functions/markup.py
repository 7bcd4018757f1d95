"""Reading links, text, picture labels and times out of stored page markup."""

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# What a tag holds before its end: a ">" within quotes does not end it.
_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')"""


# A character reference, or what lies between references.
_PIECES = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"
# Numbers that stand for no character.
_NO_CHARACTER = "\ufffd"


def _numbered(code: Column) -> Column:
    """The character of a number; those that browsers read as Windows-1252 included."""
    windows = [bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)]
    known = (code > 0) & (code < 0xD800) | (code > 0xDFFF) & (code <= 0x10FFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(0x80, 0x9F), F.get(F.array(*map(F.lit, windows)), (code - 0x80).cast("int"))).when(
        known, character).otherwise(F.lit(_NO_CHARACTER))


def _number(digits: Column, base: int) -> Column:
    """The number that digits spell; more digits than any character has are out of range."""
    bare = F.regexp_replace(digits, "^0+", "")
    short = F.when(F.length(bare) <= 7, F.conv(F.concat(F.lit("0"), bare), base, 10).cast("long"))
    return F.coalesce(short, F.lit(0x110000).cast("long"))


def unescaped(text: Column, attribute: bool = False) -> Column:
    """Character references as the characters they stand for, each once: ``&amp;lt;`` becomes ``&lt;``.

    By number, decimal or hexadecimal, or by any name that HTML 5 knows; in text, names that may lack their
    semicolon are known without it where no letter or digit follows, in an ``attribute`` ("?a=1&copy=2") they are not.
    What is no reference stays as it is, and a non-breaking space becomes a blank.
    """
    known = {name: to for name, to in html5.items() if name.endswith(";") or not attribute}
    names = F.from_json(F.lit(json.dumps(known)), "map<string,string>")

    def one(piece: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(piece, "^&#([0-9]+);?$", 1), F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);?$", 1)
        named = F.coalesce(F.try_element_at(names, F.substring(piece, 2, 64)), piece)
        return F.when(~piece.startswith("&"), piece).when(decimal != "", _numbered(_number(decimal, 10))).when(
            hexadecimal != "", _numbered(_number(hexadecimal, 16))).otherwise(named)

    read = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), one), "")
    return F.translate(F.when(text.contains("&"), read).otherwise(text), "\u00a0", " ")


def _attributes(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute, in double quotes, single quotes or none."""
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{_INSIDE}*?\s{attribute}\s*=\s*{value}"), F.lit(1))
    return F.transform(found, lambda quoted: unescaped(F.regexp_replace(quoted, r"""(?s)^(["'])(.*)\1$""", "$2"), attribute=True))


def hrefs(html: Column) -> Column:
    """Targets of the page's anchors, in order."""
    return _attributes(html, "a", "href")


def picture_labels(html: Column) -> Column:
    """Alternative texts of the pictures, which is where pages put emoji."""
    return _attributes(html, "img", "alt")


def times(html: Column) -> Column:
    """Machine-readable times as timestamps; unreadable ones are NULL."""
    return F.transform(_attributes(html, "time", "datetime"), lambda t: F.try_to_timestamp(t))


def visible_text(html: Column) -> Column:
    """Text between the tags, without scripts, styles and comments, blanks collapsed."""
    hidden = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"
    text = F.regexp_replace(F.regexp_replace(html, hidden, " "), rf"</?[a-zA-Z]{_INSIDE}*+>", " ")
    text = unescaped(F.regexp_replace(text, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
