"""Finding, removing and naming emoji."""

import unicodedata

from pyspark.sql import Column, functions as F

# The Unicode ``Emoji`` property without the ASCII keycap bases, as hex ranges.
EMOJI_RANGES = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699
269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4
26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734
2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C
2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202
1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587
1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3
1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7
1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""


def _class_of(ranges: str) -> str:
    return "".join(
        "-".join(rf"\x{{{end}}}" for end in item.split("-")) for item in ranges.split()
    )


_BASE = f"[{_class_of(EMOJI_RANGES)}]"
# One pictograph with its variation selector or skin tone, and an optional tag sequence.
_PICTOGRAPH = rf"{_BASE}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]?(?:[\x{{E0020}}-\x{{E007E}}]+\x{{E007F}})?"
# A flag, a keycap, or pictographs joined by zero-width joiners.
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]{2}"
    r"|[0-9#*]\x{FE0F}?\x{20E3}"
    rf"|{_PICTOGRAPH}(?:\x{{200D}}{_PICTOGRAPH})*"
)
# A test of few ranges that is cheap on ordinary text and true wherever an emoji can begin or a keycap
# can end; the look-ahead in front of EMOJI spares most positions the long class above.
MAYBE_EMOJI = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAFF}]"
_FAST_EMOJI = rf"(?=[0-9#*]|{MAYBE_EMOJI})(?:{EMOJI})"

# Emoji lie in two stretches of the code space; names are looked up by offset into them.
_LOW = (0x203C, 0x3299)
_HIGH = (0x1F004, 0x1FAFF)


def extract_emoji(text: Column) -> Column:
    """Array of the emoji in the text, in order."""
    return F.when(text.rlike(MAYBE_EMOJI), F.regexp_extract_all(text, F.lit(_FAST_EMOJI), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def remove_emoji(text: Column) -> Column:
    return F.when(text.rlike(MAYBE_EMOJI), F.regexp_replace(text, _FAST_EMOJI, "")).otherwise(text)


def character_name(code: int) -> str:
    """Lower-case Unicode name of a code point, empty where there is none."""
    return unicodedata.name(chr(code), "").lower()


def _names(first: int, last: int) -> Column:
    # One literal, split once by constant folding, so each lookup is an array access.
    names = "\n".join(character_name(code) for code in range(first, last + 1))
    return F.split(F.lit(names), "\n")


# Regional indicators, which spell a flag's country, and what only joins or styles other characters.
_INDICATORS = (0x1F1E6, 0x1F1FF)
_JOINERS = "[\u200d\ufe0e\ufe0f\u20e3]"


def emoji_name(emoji: Column) -> Column:
    """Name of a whole emoji: ``flag`` and its two letters, or the names of its characters, in order.

    So a joined emoji is named by its parts and a skin tone by its modifier; joiners and styles have no name.
    """
    parts = F.regexp_extract_all(F.regexp_replace(emoji, _JOINERS, ""), F.lit("(?s)."), F.lit(0))
    letters = F.transform(parts, lambda part: F.char((F.ascii(part) - _INDICATORS[0] + ord("a")).cast("int")))
    names = F.array_join(F.array_compact(F.transform(parts, _character_name)), " ")
    return F.when(F.ascii(emoji).between(*_INDICATORS), F.concat(F.lit("flag "), F.array_join(letters, ""))).otherwise(
        F.when(F.length(names) > 0, names))


def _character_name(emoji: Column) -> Column:
    code = F.ascii(emoji)
    return (
        F.when(code.between(*_LOW), F.get(_names(*_LOW), code - _LOW[0]))
        .when(code.between(*_HIGH), F.get(_names(*_HIGH), code - _HIGH[0]))
        .when(code == 0xA9, F.lit(character_name(0xA9)))
        .when(code == 0xAE, F.lit(character_name(0xAE)))
        .when(code < 0x80, F.concat(F.lit("keycap "), F.substring(emoji, 1, 1)))
    )


def emoji_names(emoji: Column) -> Column:
    """Names of an array of emoji, in order. No shuffle and no join: the name table is a constant."""
    return F.transform(emoji, emoji_name)
