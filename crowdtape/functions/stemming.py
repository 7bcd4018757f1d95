"""English stemming by the published Snowball "English" (Porter 2) rules."""

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

# Words the rules do not apply to, and their stems.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
# Words that are finished once their plural ending is off.
FINISHED_SINGULARS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Ending -> replacement, applied inside R1.
DERIVED_ENDINGS = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
SECOND_ENDINGS = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
# Endings deleted inside R2.
DELETED_ENDINGS = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
]

_VOWEL = "[aeiouy]"
_OTHER = "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_LONG_PREFIX = re.compile("gener|commun|arsen")
_SHORT_END = re.compile(f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$")
_HAS_VOWEL = re.compile(_VOWEL)
_DOUBLED = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _ending_pattern(endings) -> re.Pattern:
    return re.compile("(?:" + "|".join(sorted(endings, key=len, reverse=True)) + ")$")


_DERIVED = _ending_pattern(DERIVED_ENDINGS)
_SECOND = _ending_pattern(SECOND_ENDINGS)
_DELETED = _ending_pattern(DELETED_ENDINGS)
_POSSESSIVE = re.compile(r"'s'$|'s$|'$")
_PLURAL = re.compile(r"(?:sses|ied|ies|us|ss|s)$")
_PARTICIPLE = re.compile(r"(?:eedly|eed|edly|ed|ingly|ing)$")


def _region_start(word: str, start: int) -> int:
    match = _REGION.search(word, start)
    return match.end() if match else len(word)


def _singular(word: str) -> str:
    match = _PLURAL.search(word)
    if not match or match[0] in ("us", "ss"):
        return word
    if match[0] == "sses":
        return word[:-2]
    if match[0] in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if _HAS_VOWEL.search(word[:-2]) else word


def _base_form(word: str, r1: int) -> str:
    match = _PARTICIPLE.search(word)
    if not match:
        return word
    if match[0].startswith("eed"):
        return word[: match.start()] + "ee" if match.start() >= r1 else word
    stump = word[: match.start()]
    if not _HAS_VOWEL.search(stump):
        return word
    if stump.endswith(("at", "bl", "iz")):
        return stump + "e"
    if _DOUBLED.search(stump):
        return stump[:-1]
    return stump + "e" if r1 >= len(stump) and _SHORT_END.search(stump) else stump


def _derived(word: str, r1: int) -> str:
    match = _DERIVED.search(word)
    if not match or match.start() < r1:
        return word
    before = word[: match.start()]
    if match[0] == "ogi" and not before.endswith("l"):
        return word
    if match[0] == "li" and before[-1:] not in set("cdeghkmnrt"):
        return word
    return before + DERIVED_ENDINGS[match[0]]


def _second(word: str, r1: int, r2: int) -> str:
    match = _SECOND.search(word)
    if not match or match.start() < (r2 if match[0] == "ative" else r1):
        return word
    return word[: match.start()] + SECOND_ENDINGS[match[0]]


def _deleted(word: str, r2: int) -> str:
    match = _DELETED.search(word)
    if not match or match.start() < r2 or (match[0] == "ion" and word[match.start() - 1] not in "st"):
        return word
    return word[: match.start()]


def _last_letter(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1]))):
        return word[:-1]
    if word.endswith("ll") and at >= r2:
        return word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    # A y that acts as a consonant is written Y until the end; each one decides the next.
    word = re.sub("^y", "Y", word)
    word = re.sub("([aeiouy])y", r"\1Y", word)
    prefix = _LONG_PREFIX.match(word)
    r1 = prefix.end() if prefix else _region_start(word, 0)
    r2 = _region_start(word, r1)
    word = _singular(_POSSESSIVE.sub("", word))
    if word in FINISHED_SINGULARS:
        return word
    word = _base_form(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _second(_derived(word, r1), r1, r2)
    return _last_letter(_deleted(word, r2), r1, r2).replace("Y", "y")


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stems of a column of token arrays: every distinct word of an Arrow batch is stemmed once."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string())
    starts = pc.subtract(tokens.offsets, tokens.offsets[0])
    return pa.ListArray.from_arrays(starts, stems.take(words.indices), mask=tokens.is_null())


