"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from . import vocab


def clean_boilerplate(c: Column) -> Column:
    """Lines of four or more rules, dots or blanks out, runs of blanks to one, three or more line ends to two, zero-width
    signs out. Null stays null."""
    c = F.regexp_replace(c, "[​‌‍﻿]", "")
    c = F.regexp_replace(c, r"(?m)^[ \t\-_=.]{4,}$", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def slug(filename: Column) -> Column:
    """The document id of a file name: lower case, everything but a-z, 0-9, dot and underscore to an underscore."""
    return F.regexp_replace(F.lower(filename), r"[^a-z0-9_.]", "_")


def stem_slug(filename: Column) -> Column:
    """The slug of the name without its extension; letters beyond ASCII stay."""
    return F.regexp_replace(F.lower(F.regexp_replace(filename, r"\.[^.]*$", "")), r"(?U)[^\w.\-]", "_")


def tokens(c: Column) -> Column:
    """Lower case, split at white space, without empty tokens."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def topic_of(question: Column, triggers=vocab.TOPIC_TRIGGERS) -> Column:
    """Topic of the first trigger that is a part of the question, null if none is."""
    q = F.lower(question)
    return F.coalesce(*[F.when(q.contains(t), F.lit(v)) for t, v in triggers])


def intent_of(question: Column, intents=vocab.INTENT_TRIGGERS) -> Column:
    """The intent with the most triggers in the question, the first of equal ones; 'general' if there is none."""
    q = F.lower(question)
    hits = [reduce(lambda a, b: a + b, [F.when(q.contains(t), 1).otherwise(0) for t in words]) for _, words in intents]
    best = F.greatest(*hits)
    out = F.when(best == 0, F.lit("general"))
    for (name, _), h in zip(intents, hits):
        out = out.when(h == best, F.lit(name))
    return out


def word_pattern(words: list[str], *, ends: str = r"\p{L}\p{N}_") -> str:
    """A pattern for any of ``words`` as whole words: nothing of ``ends`` before or after, unless the word begins or ends with a
    sign. In the words' order."""
    safe = "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w).replace(" ", r"\s+") for w in words)
    return rf"(?<![{ends}])(?:{safe})(?![{ends}])"


def route_of(question: Column) -> Column:
    """Which way a question takes: 'spec_fast' if it has a word for a measured quantity, else 'kg_fast' if it asks for a cause or
    a remedy, else 'full_agent'."""
    q = F.coalesce(F.lower(question), F.lit(""))
    asks = lambda words: q.rlike(word_pattern([w for w in words if w[0].isalpha()])) | reduce(lambda a, b: a | b, [q.contains(w) for w in words if not w[0].isalpha()], F.lit(False))
    return F.when(asks(vocab.SPEC_WORDS), "spec_fast").when(asks(vocab.DIAGNOSTIC_WORDS), "kg_fast").otherwise("full_agent")


def convert(value: Column, unit_from: Column, unit_to: Column) -> Column:
    """A value in another unit, rounded to 6; °C, °F and K among each other; null where there is no conversion."""
    t = lambda u: F.when(u.isin("°c", "degc", "celsius", "c"), "c").when(u.isin("°f", "degf", "fahrenheit", "f"), "f").when(u.isin("k", "kelvin"), "k")
    a, b = F.lower(F.trim(unit_from)), F.lower(F.trim(unit_to))
    kelvin = F.when(t(a) == "c", value + 273.15).when(t(a) == "f", (value - 32) * 5 / 9 + 273.15).when(t(a) == "k", value)
    degrees = F.when(t(b) == "c", kelvin - 273.15).when(t(b) == "f", (kelvin - 273.15) * 9 / 5 + 32).when(t(b) == "k", kelvin)
    factors = F.create_map(*[F.lit(x) for p, q, f in vocab.CONVERSIONS for x in (f"{p}>{q}", f)])
    same = F.when(a == b, value)
    return F.round(F.coalesce(same, degrees, value * F.try_element_at(factors, F.concat(a, F.lit(">"), b))), 6)


def unit_name(unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    return F.when(u.isin("c", "?c", "°c"), "°C").when(u.isin("f", "?f", "°f"), "°F").otherwise(F.trim(unit))


def confidence(c: Column) -> Column:
    """A confidence as a number from 0 to 1, null where it isn't one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.try_cast("double")))


def evidence(c: Column, n: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def strip_reasoning(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def salvaged_json(c: Column) -> Column:
    """From the first brace to the last of an answer without its reasoning; empty if there are none."""
    return F.regexp_extract(strip_reasoning(c), r"(?s)\{.*\}", 0)


def looks_like_refusal(answer: Column) -> Column:
    marks = ("i don't know", "i do not know", "cannot answer", "not enough information", "no information", "unable to answer", "insufficient context")
    low = F.lower(F.coalesce(answer, F.lit("")))
    return (F.length(low) <= 300) & reduce(lambda a, b: a | b, [low.contains(m) for m in marks])


def looks_like_raw_graph(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(r"--[A-Z_]+-->")


_MATH = str.maketrans(vocab.GREEK | vocab.FORMULA_SIGNS | {chr(0x2080 + i): f"_{i}" for i in range(10)} | {"²": "^2", "³": "^3", "¹": "^1"} | {chr(0x2070 + i): f"^{i}" for i in range(10)})
_IS_MATH = re.compile("[" + "".join(map(re.escape, [*vocab.GREEK, *vocab.FORMULA_SIGNS])) + "²³¹\u2070-\u2089\U0001d400-\U0001d7ff]")


def _fold_sign(m: re.Match) -> str:
    plain = unicodedata.normalize("NFKC", m[0]) if m[0] >= "\U0001d400" else m[0]
    return plain.translate(_MATH)


@F.pandas_udf(StringType())
def fold_math(text: pd.Series) -> pd.Series:
    """Mathematical letters, Greek letters, raised and lowered digits and operators as readable plain text, then compatibility
    decomposition (ligatures, full-width letters) with accents composed again. Null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFKD", _IS_MATH.sub(_fold_sign, t))), na_action="ignore")


#: Repairs of formulas as read from pages, in order: (what is read, what is meant).
_FORMULA_REPAIRS = (
    (r"\b([A-Z])\s*([a-z])\b", "$1_$2"),  # an index beside its symbol
    (r"\b(?:eta\s*|η\s*)e\b", "eta_e"),  # the effective efficiency
    (r"\bm(?:\s+|_)F\b", "m_dot_F"),  # the mass flow of fuel
    (r"\bm_dot_F\s*\*\s*LHV\s+P_b\b", "m_dot_F * LHV / P_b"),
    (r"\bBTE\s*\(\s*eta_e\s*\)\s*=", "BTE (eta_e) ="),
    (r"([\p{L}\p{N}_^)])\s*\*\s*(?=[\p{L}\p{N}_(])", "$1 * "),
    (r"\s*/\s*", " / "),
)


def formula_spaces(c: Column) -> Column:
    """A formula with the usual misreadings of symbols and indices repaired and one blank around operators."""
    for a, b in _FORMULA_REPAIRS:
        c = F.regexp_replace(c, a, b)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*=\s*", " = "), r"\s+", " "))


def edge_key(src_type: Column, src: Column, relation: Column, dst_type: Column, dst: Column, doc_id: Column, chunk: Column) -> Column:
    """Identity of an edge: its ends, relation and place, in lower case; missing parts are empty."""
    parts = [F.lower(F.coalesce(x.cast("string"), F.lit(""))) for x in (src_type, src, relation, dst_type, dst, doc_id, chunk)]
    return F.concat_ws("|", *parts)


STOP_TERMS = frozenset("the and for with from that this what which when where why how are was were does did can could should would may might has have had into about your you".split())


def relevance_terms(question: str) -> list[str]:
    """Words of three letters or more that aren't common, each with its singular form, in order."""
    out: list[str] = []
    for w in re.findall(r"[a-z0-9äöüß]{3,}", (question or "").lower()):
        if w not in STOP_TERMS:
            out += [x for x in (w, w[:-1] if w.endswith("s") and len(w) > 3 else w) if x not in out]
    return out


def without_words(text: Column, words: list[str]) -> Column:
    """The text without these words, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, word_pattern(words), " "), r"\s+", " "))


def symptom_of(question: Column) -> Column:
    """The symptom that a question is about: a known one that it names, by its usual name, or what is left of the question without its
    common words, or else the whole question."""
    q = F.lower(question)
    named = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in vocab.SYMPTOM_NAMES.items()]), lambda z: F.contains(q, z["k"]))
    rest = without_words(q, vocab.QUESTION_WORDS)
    return F.coalesce(F.try_element_at(named, F.lit(1))["v"], F.nullif(rest, F.lit("")), question)


def query_terms(question: Column, *, most_words: int = 8, most: int = 10) -> Column:
    """Terms to look up in the graph: hints in the question, then its words of four characters or more that aren't common, at most
    ``most_words`` of them; distinct regardless of case, at most ``most``."""
    q = F.coalesce(F.lower(question), F.lit(""))
    hints = F.filter(F.array(*[F.lit(h) for h in vocab.TERM_HINTS]), lambda h: F.contains(q, h))
    more = F.when(F.contains(q, F.lit("misfiring")), F.array(F.lit("misfire"))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.regexp_extract_all(q, F.lit(r"[a-z0-9][a-z0-9_-]{3,}"), F.lit(0)), lambda w: ~w.isin(vocab.TERM_STOPS))
    return F.slice(F.array_distinct(F.concat(hints, more, F.slice(words, 1, most_words))), 1, most)


def display_text(content: Column) -> Column:
    """A passage for reading: table marks and bars out, white space collapsed."""
    c = F.regexp_replace(content, r"\[Table: [^\]]*\]|\[PAGE_BREAK:\d+\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\|\s*", ", "), r"\s+", " "))


def formula_term(question: Column) -> Column:
    """What a question about a formula is about: its words without those that ask, or else the whole question."""
    q = F.replace(F.lower(F.coalesce(question, F.lit(""))), F.lit("?"), F.lit(" "))
    return F.coalesce(F.nullif(without_words(q, vocab.FORMULA_WORDS), F.lit("")), F.trim(question))


def node_type(c: Column) -> Column:
    """A type of nodes, 'unknown' for what isn't one."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(vocab.NODE_TYPES), t).otherwise("unknown")


def relation(c: Column) -> Column:
    """A relation of edges, 'RELATED_TO' for what isn't one."""
    r = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.when(r.isin(vocab.RELATIONS), r).otherwise("RELATED_TO")


def source_label(title: Column, doc_id: Column, page: Column, chunk: Column) -> Column:
    """Where a statement stands: title or document, page and chunk, as far as known."""
    return F.concat_ws(", ", F.coalesce(title, doc_id), F.concat(F.lit("p. "), page.cast("string")), F.concat(F.lit("chunk "), chunk.cast("string")))


def job_stamp(at: Column) -> Column:
    """The name of a job by the time it starts, which is passed in."""
    return F.concat(F.lit("job-"), F.date_format(at, "yyyyMMdd-HHmmss"))


def path_label(parts: list[Column]) -> Column:
    """A graph path as text, without its missing end."""
    return F.array_join(F.array_compact(F.array(*parts)), " -> ")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """The default embedder: hashed words as a vector of unit length; null for a text without words."""

    def embed(batch: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for t in batch:
            words = t.lower().split() if t else []
            if not words:
                out.append(None)
                continue
            h = np.array([known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace"))) for w in words], np.int64)
            v = np.bincount(h % dim, weights=np.where((h >> 17) % 2 == 0, 1.0, -1.0), minlength=dim)
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm > 0 else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(embed, ArrayType(DoubleType()))(text)
