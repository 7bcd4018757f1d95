"""From raw post text to clean word tokens, as column expressions."""

import re
import string
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from crowdtape.functions import patterns
from crowdtape.functions.emoji import remove_emoji
from crowdtape.functions.stemming import stem_tokens
from crowdtape.session import share_package
from crowdtape.functions.words import stop_words as default_stop_words


def _latin_bases() -> dict[str, str]:
    """Accented Latin letter -> its ASCII base, from the Unicode decompositions."""
    bases = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            bases[chr(code)] = base
    return bases


# Latin letters without a decomposition, and their ASCII spellings.
_PLAIN_LETTERS = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i"}
_SPELLED_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}

_BASES = {**_latin_bases(), **_PLAIN_LETTERS}
_MARKS = "".join(chr(code) for code in range(0x300, 0x370))


# Every blank that separates words, as the pattern class BLANK lists them.
_BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)


def strip_diacritics(text: Column, blank_out: str = "") -> Column:
    """Latin letters without their marks; ``blank_out`` characters become blanks in the same pass."""
    spelled = text
    for letter, spelling in _SPELLED_LETTERS.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(spelling))
    # Characters without a partner in the second list are deleted, which takes the combining marks out.
    return F.translate(
        spelled, blank_out + "".join(_BASES) + _MARKS, " " * len(blank_out) + "".join(_BASES.values())
    )


def remove_entities(text: Column) -> Column:
    """Delete links, user names, hashtags and digits. The look-ahead skips most positions at once."""
    return F.regexp_replace(text, rf"(?=[hw@#\p{{Nd}}])(?:{patterns.ENTITY})", "")


def collapse_blanks(text: Column, collapse: str = " ") -> Column:
    return F.regexp_replace(text, patterns.BLANK_RUN, collapse)


def glue_entities(text: Column) -> Column:
    """Delete entities and runs of blanks alike, which glues the words on both sides of a run.

    Some stored results rely on this.
    """
    return F.regexp_replace(text, f"{patterns.ENTITY}|{patterns.BLANK_RUN}", "")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{patterns.BLANK}]+"), "")


def with_words(posts: DataFrame, text: str = "text", name: str = "words",
               words_to_remove: list[str] | None = None, glue: bool = False) -> DataFrame:
    """Posts with an array of clean word tokens.

    Lower case; links, user names, hashtags, digits and emoji out; ASCII punctuation to blanks;
    diacritics off; stop words out; what is left of symbols out. Only text that still holds a symbol
    after that needs the slower word-boundary removal, since there a stop word may touch a symbol.
    The steps are columns of their own, so that none is computed more than once.
    """
    remove = default_stop_words() if words_to_remove is None else words_to_remove
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    bare = glue_entities(lowered) if glue else remove_entities(lowered)
    plain = strip_diacritics(remove_emoji(F.col("_bare")), blank_out=string.punctuation + _BLANKS)
    kept = F.array_remove(F.split("_plain", " "), "")
    symbols = F.col("_plain")
    if remove:
        kept = F.filter(kept, lambda word: ~word.isin(remove))
        alternatives = "|".join(re.escape(word) for word in remove)
        boundary = rf"(?<![{patterns.WORD}])(?:{alternatives})(?![{patterns.WORD}])"
        symbols = F.regexp_replace(symbols, boundary, " ")
    symbol_free = split_words(F.regexp_replace(symbols, patterns.SYMBOL, ""))
    return (
        posts.withColumn("_bare", bare)
        .withColumn("_plain", plain)
        .withColumn(name, F.when(F.col("_plain").rlike(patterns.SYMBOL), symbol_free).otherwise(kept))
        .drop("_bare", "_plain")
    )


def clean_posts(posts: DataFrame, text: str = "text", words_to_remove: list[str] | None = None,
                glue: bool = False, stem: bool = True) -> DataFrame:
    """Posts with ``words`` (clean tokens) and ``tokens`` (their stems), both arrays."""
    cleaned = with_words(posts, text, "words", words_to_remove, glue)
    if stem:
        share_package(cleaned.sparkSession)
    return cleaned.withColumn("tokens", stem_tokens("words") if stem else F.col("words"))


def with_clean_text(cleaned: DataFrame) -> DataFrame:
    """The two text columns of a cleaned post table in place of its arrays."""
    return cleaned.withColumns({
        "cleaned_stem_text": F.array_join("tokens", " "),
        "cleaned_nonstem_text": F.array_join("words", " "),
    }).drop("tokens", "words")


def chunk_text(text: Column, size: int) -> Column:
    """Array of consecutive pieces of ``size`` characters, the last one shorter; empty text gives none."""
    pieces = F.ceil(F.length(text) / F.lit(size)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))
    )
    return F.when(pieces > 0, cut).otherwise(F.array().cast("array<string>"))
