"""The language of a text by its commonest words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words of each language.
COMMON = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf", "den", "von", "zu", "im", "für", "wird", "dem", "auch"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "are", "on", "be", "this", "which", "by", "from"],
    "es": ["el", "los", "las", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se", "no", "es", "como", "más", "al"],
    "fr": ["le", "les", "des", "et", "est", "une", "dans", "du", "que", "pour", "pas", "sur", "au", "avec", "ce", "qui", "par", "plus"],
    "it": ["il", "lo", "gli", "di", "e", "che", "un", "una", "per", "con", "non", "del", "della", "sono", "è", "nel", "più", "alla"],
}
_SPLIT = r"[^\p{L}]+"


def language_of(text: Column, common: dict[str, list[str]] = COMMON) -> Column:
    """The language with most of its common words in the text, the first of equal ones in order of their names; 'unknown' without any, or
    for a null or blank text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT)
    hits = [F.struct(F.size(F.filter(words, _within(ws))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(sorted(common.items()))]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")


def _within(words: list[str]):
    return lambda w: w.isin(words)


def sql(table: str, key: str, text: str, common: dict[str, list[str]] = COMMON) -> str:
    """The same in SQL."""
    q = lambda ws: ", ".join(f"'{w}'" for w in ws)
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({q(ws)}))) AS n_{lang}" for lang, ws in sorted(common.items()))
    best = "greatest(" + ", ".join(f"n_{lang}" for lang in sorted(common)) + ")"
    cases = " ".join(f"WHEN n_{lang} = {best} THEN '{lang}'" for lang in sorted(common))
    return f"SELECT {key}, CASE WHEN {best} = 0 THEN 'unknown' {cases} END AS lang FROM (SELECT {key}, {counts} FROM (SELECT {key}, regexp_split_to_array(lower(coalesce({text}, '')), '{_SPLIT}') AS w FROM {table}))"
