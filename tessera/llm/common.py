"""Helpers of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_MARK = r"\[PAGE_BREAK:\d+\]"

# Abbreviations that end in a full stop without ending the sentence.
ABBREVIATIONS = frozenset(
    "abb approx art b bd bsp bzw ca cap cf cfr ch co d dr e ecc ed esp etc evtl ex fig figs g h i inc "
    "ing inkl jr kap ltd max min mm mr mrs ms n nb no nos nr num o op p pag par pos pp prof pág s sec sect "
    "sez sig sr sra st str tab tel u usw v vgl vol vs z zb".split()
)

_BREAK = re.compile(r"[.!?…]+[)\]»”“\"’']*\s+(?=[^a-zà-öø-ÿß\s])|\n\s*\n\s*")
_LAST_WORD = re.compile(r"([^\W\d_]+|\d+)[.º°]*\.[)\]»”“\"’']*\s+$")


def clean_space(text: str) -> str:
    """Page marks out, single line breaks as blanks, paragraphs kept."""
    text = re.sub(r"\s*" + PAGE_MARK + r"\s*", " ", text)
    return re.sub(r"(?<!\n)[ \t]*\n(?!\s*\n)[ \t]*", " ", text)


def sentences(text: str | None) -> list[str]:
    """Sentences of a text in order. A full stop after an abbreviation, a single letter or a number before
    another word in running text doesn't end one; a blank line always does. None and blank texts give none."""
    if not text:
        return []
    text, out, start = clean_space(text), [], 0
    for m in _BREAK.finditer(text):
        head = text[m.start() : m.end()]
        if head[0] == "." and "\n" not in head:
            nxt = text[m.end()] if m.end() < len(text) else ""
            if nxt.isdigit() and not re.search(r"\w{5,}$", text[max(0, m.start() - 5) : m.start()]):
                continue
            word = re.search(r"[^\W\d_]+$", text[max(start, m.start() - 12) : m.start()])
            if word and (word[0].lower() in ABBREVIATIONS or (len(word[0]) == 1 and word[0].islower())):
                continue
            if not word and re.search(r"\b(?:vor dem|nach dem|dem|am|der|den|im|zum)\s+\d+$", text[max(start, m.start() - 16) : m.start()], re.I):
                continue
        piece = text[start : m.end()].strip()
        if piece:
            out.append(piece)
        start = m.end()
    if piece := text[start:].strip():
        out.append(piece)
    return out


_GRAIN = 1 << 24


def thinned(df: DataFrame, key: Column, limit: int, total: int, seed: int = 17) -> DataFrame:
    """Rows of the smallest hashed keys, somewhat more than ``limit`` of ``total``: what the tasks of a sample need to
    send, so that it doesn't grow with their number."""
    share = min(1.0, (limit + 6 * limit**0.5 + 50) / max(1, total))
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_GRAIN)) <= int(share * _GRAIN))


def sample_rows(df: DataFrame, key: Column, limit: int, seed: int = 17) -> pd.DataFrame:
    """At most ``limit`` rows for fitting, the same ones on each run: those of the smallest hashed key."""
    some = thinned(df, key, limit, df.select(key).count(), seed)
    return some.orderBy(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_GRAIN)), key).limit(limit).toPandas()


def over_batches(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = fn(b)
                if len(out):  # columns of an empty frame have no proper type
                    yield out

    return run


def fnv(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of integers, the same on all machines."""
    x = data.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
