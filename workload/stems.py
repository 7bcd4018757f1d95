"""The published stemming rules in SQL: one column a step, over the distinct words."""

from crowdtape.functions import stemming

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def _one_of(endings) -> str:
    return "(" + "|".join(endings) + ")$"


def _replaced(endings: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{ending}' THEN '{new}'" for ending, new in endings.items()) + " END"


def _listed(words) -> str:
    return "(" + ", ".join(f"'{word}'" for word in words) + ")"


def _region(rest: str) -> str:
    """Length up to behind the first letter that follows a vowel without being one; all of it if there is none."""
    return f"coalesce(nullif(length(regexp_extract({rest}, '^.*?{_VOWEL}{_OTHER}')), 0), length({rest}))"


def _step(name: str, source: str, endings, result: str) -> str:
    """``x`` by one rule; the rule reads the ending ``e`` that it found and the ``stump`` before it."""
    return f"""{name} AS (SELECT w, r1, r2, finished, CASE WHEN finished OR e = '' THEN x ELSE {result} END AS x
        FROM (SELECT *, left(x, length(x) - length(e)) AS stump
            FROM (SELECT *, regexp_extract(x, '{_one_of(endings)}') AS e FROM {source})))"""


# Words have no apostrophes here: cleaning has taken them off.
STEMS = [
    "vocabulary AS MATERIALIZED (SELECT DISTINCT unnest(words) AS w FROM plain)",
    f"""marked AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '({_VOWEL})y', '\\1Y', 'g') AS x FROM vocabulary
        WHERE length(w) > 2 AND w NOT IN {_listed(stemming.IRREGULAR)})""",
    f"""first_region AS (SELECT *, CASE WHEN regexp_matches(x, '^(gener|commun|arsen)')
        THEN length(regexp_extract(x, '^(gener|commun|arsen)')) ELSE {_region("x")} END AS r1, false AS finished FROM marked)""",
    f"regions AS (SELECT *, r1 + {_region('substr(x, r1 + 1)')} AS r2 FROM first_region)",
    _step("singular", "regions", ["sses", "ied", "ies", "us", "ss", "s"], f"""
        CASE WHEN e = 'sses' THEN stump || 'ss' WHEN e IN ('us', 'ss') THEN x
            WHEN e IN ('ied', 'ies') THEN stump || CASE WHEN length(x) > 4 THEN 'i' ELSE 'ie' END
            WHEN regexp_matches(left(x, length(x) - 2), '{_VOWEL}') THEN stump ELSE x END"""),
    f"""checked AS (SELECT * REPLACE (x IN {_listed(sorted(stemming.FINISHED_SINGULARS))} AS finished) FROM singular)""",
    _step("base_form", "checked", ["eedly", "eed", "edly", "ed", "ingly", "ing"], f"""
        CASE WHEN e IN ('eedly', 'eed') THEN CASE WHEN length(stump) >= r1 THEN stump || 'ee' ELSE x END
            WHEN NOT regexp_matches(stump, '{_VOWEL}') THEN x
            WHEN regexp_matches(stump, '(at|bl|iz)$') THEN stump || 'e'
            WHEN regexp_matches(stump, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(stump, length(stump) - 1)
            WHEN r1 >= length(stump) AND regexp_matches(stump, '{_SHORT}') THEN stump || 'e' ELSE stump END"""),
    _step("last_y", "base_form", ["[yY]"], f"""
        CASE WHEN length(x) > 2 AND regexp_matches(stump, '{_OTHER}$') THEN stump || 'i' ELSE x END"""),
    _step("derived", "last_y", stemming.DERIVED_ENDINGS, f"""
        CASE WHEN length(stump) < r1 OR e = 'ogi' AND right(stump, 1) <> 'l'
            OR e = 'li' AND NOT regexp_matches(stump, '[cdeghkmnrt]$') THEN x
        ELSE stump || {_replaced(stemming.DERIVED_ENDINGS)} END"""),
    _step("second", "derived", stemming.SECOND_ENDINGS, f"""
        CASE WHEN length(stump) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN x
        ELSE stump || {_replaced(stemming.SECOND_ENDINGS)} END"""),
    _step("deleted", "second", stemming.DELETED_ENDINGS, """
        CASE WHEN length(stump) < r2 OR e = 'ion' AND NOT regexp_matches(stump, '[st]$') THEN x ELSE stump END"""),
    _step("last_letter", "deleted", ["e", "l"], f"""
        CASE WHEN e = 'e' AND (length(stump) >= r2 OR length(stump) >= r1 AND NOT regexp_matches(stump, '{_SHORT}'))
            OR e = 'l' AND right(stump, 1) = 'l' AND length(stump) >= r2 THEN stump ELSE x END"""),
    f"""stems AS MATERIALIZED (SELECT w, replace(x, 'Y', 'y') AS stem FROM last_letter
        UNION ALL SELECT w, CASE w {" ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stemming.IRREGULAR.items())} ELSE w END
        FROM vocabulary WHERE length(w) <= 2 OR w IN {_listed(stemming.IRREGULAR)})""",
    """words AS MATERIALIZED (SELECT p.id, coalesce(s.words, []) AS words FROM plain p LEFT JOIN (
        SELECT id, list(stem ORDER BY i) AS words
        FROM (SELECT id, unnest(words) AS w, unnest(range(len(words))) AS i FROM plain) JOIN stems USING (w)
        GROUP BY id) s USING (id))""",
]
