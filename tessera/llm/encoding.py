"""Text that was decoded with a wrong character encoding: finding the fields and restoring the text.

A multinomial (softmax) classifier over hashed byte bigrams of single words predicts the chain of encodings a word
went through. It is trained on words garbled here, from the corpus's own clean words. The predicted chain is
inverted, and the word counts as garbled only if the inverse decodes strictly and gives the same garbled word again.
"""

from __future__ import annotations

import random
import re
import unicodedata
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fnv, over_batches

# Letters and signs beyond ASCII that texts in English, German, French, Spanish, Italian and Portuguese use.
LETTERS = "äöüßéèêëàâáåãçñóòôõøíìîïúùûýÿæœ"
SIGNS = "“”„‘’‚‹›«»–—…·•°±µ×÷½¼¾²³ºª§©®™€£¿¡ ­‐"
# Rare signs that stand in sound texts, for examples of sound words.
RARE = "½¼¾²³Ø∞±≤≥≈√ΔΣΩΘΦπ∂‰°µ·×÷⌀→•…€§®™´ªº¬└─├│▒║━∙‡†"

# Further letters of names in Latin script.
MORE_LETTERS = "ąćčďđęěğıłńňőŕřśşšťţůűźżžþð"

# chain: the encoding the bytes were in, then the one they were read in
_ENCODINGS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251")
CHAINS: tuple[tuple[str, ...], ...] = (
    *(("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")),
    ("utf-8", "cp1252", "utf-8", "cp1252"),
    ("utf-8", "latin-1", "utf-8", "latin-1"),
    ("utf-8", "cp1252", "lower"),
    ("utf-8", "cp1252", "utf-8", "cp1252", "lower"),
    *((t, w) for t in _ENCODINGS[:4] for w in (*_ENCODINGS, "latin-1") if t != w and (t, w) not in (("cp437", "cp850"), ("cp850", "cp437"), ("cp1252", "latin-1"))),
    ("lost",),
)
SOUND = len(CHAINS)


@lru_cache
def _decode_table(enc: str) -> list[str]:
    """The 256 characters of a single-byte encoding; bytes it leaves open stand for control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache
def _encode_table(enc: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_decode_table(enc))))}


def _read_as(data: bytes, enc: str) -> str:
    t = _decode_table(enc)
    return "".join(t[b] for b in data)


def _bytes_in(text: str, enc: str) -> bytes:
    t = _encode_table(enc)
    return bytes(t[c] for c in text)  # KeyError: not from this encoding


def garble(word: str, chain: tuple[str, ...]) -> str | None:
    """The word after the chain, None where it can't go through it."""
    if chain == ("lost",):
        return word.encode("cp1252", "replace").decode("utf-8", "replace")
    lower = chain[-1] == "lower"
    steps = chain[:-1] if lower else chain
    try:
        for right, wrong in zip(steps[::2], steps[1::2]):
            data = word.encode("utf-8") if right == "utf-8" else _bytes_in(word, right)
            word = _read_as(data, wrong)
    except KeyError:
        return None
    return word.lower() if lower else word


def _raise_case(word: str) -> list[str]:
    """Ways to put the capitals back into a lowered run of garbled UTF-8."""
    up = lambda s: re.sub(r"[âãåîïðñäëê]", lambda m: m[0].upper(), s)
    return [up(word), re.sub(r"[ãâ](?=[\u0080-¿€‚ƒ„…†‡ˆ‰š‹œž‘’“”•–—˜™›ÿ¡-¿])", lambda m: m[0].upper(), word)]


def invert(word: str, chain: tuple[str, ...]) -> str | None:
    """The word before the chain, None if it doesn't decode strictly or doesn't give ``word`` again."""
    if chain == ("lost",):
        return None
    if chain[-1] == "lower":
        for w in _raise_case(word):
            try:
                for right, wrong in reversed(list(zip(chain[:-1:2], chain[1:-1:2]))):
                    if right != "utf-8":
                        return None
                    w = _bytes_in(w, wrong).decode("utf-8")
                    w = re.sub(r"[âã](?=[\u0080-¿])", lambda m: m[0].upper(), w) if len(chain) > 3 else w
            except (KeyError, UnicodeDecodeError):
                continue
            if garble(w, chain) == word:
                return w
        return None
    w = word
    try:
        for right, wrong in reversed(list(zip(chain[::2], chain[1::2]))):
            data = _bytes_in(w, wrong)
            w = data.decode("utf-8") if right == "utf-8" else _read_as(data, right)
    except (KeyError, UnicodeDecodeError):
        return None
    return w if w != word and garble(w, chain) == word else None


_FINE = set(LETTERS + LETTERS.upper() + SIGNS + "ẞ")


def plausible(word: str) -> bool:
    """Only characters that sound texts use, no letter pressed between signs, no capital within small letters."""
    odd = [c for c in word if c > "\x7f"]
    if not odd or not all(c in _FINE for c in odd):
        return False
    if re.search(r"[a-zà-öø-ÿß][A-ZÀ-ÖØ-Þ]", word) and not re.search(r"^[a-zà-ÿ]{1,2}['’][A-ZÀ-Þ]", word):
        return False
    return not re.search(r"[^\W\d_][“„«»¿¡°±×÷½¼¾²³§©®™€£…•·µ‚‹›ªº‡][^\W\d_]", word.replace("·m", "m").replace("·c", "c"))


# --- the classifier --------------------------------------------------------------------------------------------

_DIM = 1 << 15


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams (and trigrams) of the UTF-8 bytes around the characters beyond ASCII, once as they are and once
    with ASCII letters and digits as their kind, so that the model sees the garbling before the vocabulary.
    As (row starts, indices)."""
    # every word has one index at least, as reduceat needs: words without such bytes count as hash 0
    starts, chunks, at = np.zeros(len(words) + 1, np.int64), [], 0
    for i, w in enumerate(words):
        parts = []
        for salt, form in ((0, _kinds(w)), (1 << 30, w)):
            b = np.frombuffer(b"\1" + form.encode("utf-8", "replace") + b"\2", np.uint8).astype(np.int64)
            two, three = b[:-1] * 256 + b[1:], (b[:-2] * 256 + b[1:-1]) * 256 + b[2:] + (1 << 24)
            high = b > 127
            parts += [two[high[:-1] | high[1:]] + salt, three[high[:-2] | high[1:-1] | high[2:]] + salt]
        idx = (fnv(np.concatenate([*parts, np.zeros(1, np.int64)])) % np.uint64(_DIM)).astype(np.int64)
        chunks.append(idx)
        at += len(idx)
        starts[i + 1] = at
    return starts, np.concatenate(chunks) if chunks else np.zeros(0, np.int64)


def _kinds(word: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", word)))


@dataclass
class ChainModel:
    weights: np.ndarray  # (_DIM, classes) float32
    bias: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)  # sound words with their counts: those it was trained on, or all that are asked for

    def scores(self, words: list[str]) -> np.ndarray:
        starts, idx = _features(words)
        z = np.add.reduceat(self.weights[idx], starts[:-1], axis=0)
        z = z / np.sqrt(np.maximum(1, np.diff(starts)))[:, None] + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _sound_examples(rng: random.Random) -> list[str]:
    """Sound words with rare signs, in capitals, in other scripts or decomposed."""
    out = []
    shapes = ("{s}", "{s}", "0{s}", "{s}0", "00,0{s}", "{s}a", "({s})", "{s}.", "±0{s}", "{s}{t}", "a{s}", "Δ{s}", "{s}aa", "kp{s}cm", "0{s}0", "{s}{s}{s}", "A{s}", "{s}A")
    for _ in range(3000):
        out.append(rng.choice(shapes[:14] if rng.random() < 0.8 else shapes).format(s=rng.choice(RARE), t=rng.choice(RARE)))
    for first, last, n in ((0x430, 0x44F, 700), (0x3B1, 0x3C9, 300), (0x1D6FC, 0x1D70B, 150), (0x4E00, 0x4F00, 60)):
        for _ in range(n):
            w = "".join(chr(rng.randint(first, last)) for _ in range(rng.randint(2, 7)))
            out.append(rng.choice((w, w.capitalize(), f"«{w.capitalize()}»", w + ".")) if first < 0x500 else w)
    for c in LETTERS + MORE_LETTERS:  # words that begin with, hold, end with or are one such letter, also in capitals
        if len(c.upper()) == 1:
            out += [c.upper(), f"{c.upper()}aa", f"{c.upper()}AA", f"AA{c.upper()}A", f"AA{c.upper()}", f"A{c.upper()}A", f"aa{c}", f"a{c}aa"] * 3
    return out


def _clean(word: str) -> bool:
    return plausible(word) and not any(invert(word, c) for c in CHAINS[:10])


def fit_chain_model(words: dict[str, int], *, max_words: int = 1200, epochs: int = 5, seed: int = 7) -> ChainModel:
    """Train on at most ``max_words`` clean words (the keys of ``words``), each garbled by every chain that it can go
    through. Without any words a small built-in alphabet sample serves."""
    rng = random.Random(seed)
    clean = sorted(filter(_clean, words))
    rng.shuffle(clean)
    clean = clean[:max_words]
    lexicon: dict[str, int] = {}
    for w in clean:
        if re.search(r"[^\W\d_]", w):
            lexicon[bare(w)] = lexicon.get(bare(w), 0) + words[w]
    clean += [f"{a}{c}{b}" for c in LETTERS for a in ("aa", "A", "") for b in ("aa", "a", "")] + [f"{c.upper()}aa" for c in LETTERS if c != "ß"]
    clean += [f"{a}{s}{b}" for s in "\xad¬‐—–" for a in ("aa", "A", "aé", "ü") for b in ("", "aa")]
    clean += [f"{s}aa" for s in "“„«‘¿¡"] + [f"aa{s}" for s in "”“»’,."] + ["–", "—", "°C", "00°C", "±0,0", "n°", "n.º", "µm", "00µm", "·", "aa…"]
    xs, ys = [], []
    for w in clean:
        for v in {w, w.upper(), w.capitalize(), unicodedata.normalize("NFD", w)} if rng.random() < 0.4 else (w,):
            xs.append(v)
            ys.append(SOUND)
        for k, chain in enumerate(CHAINS):
            for v in (w, w.upper()) if rng.random() < 0.1 else (w,):
                g = garble(v, chain)
                if g and g != v and (chain == ("lost",) or re.search(r"[^\x00-\x7f]", g)):
                    xs.append(g)
                    ys.append(k)
    for w in _sound_examples(rng):
        xs.append(w)
        ys.append(SOUND)
    known: dict[str, int] = {x: y for x, y in zip(xs, ys) if y == SOUND}
    xy = [(x, y) for x, y in zip(xs, ys) if y == SOUND or x not in known]
    rng.shuffle(xy)
    xs, y = [x for x, _ in xy], np.array([b for _, b in xy])
    n_class = len(CHAINS) + 1
    starts, idx = _features(xs)
    lens = np.diff(starts)
    share = np.bincount(y, minlength=n_class) + 1.0
    row_w = ((len(y) / n_class) / share[y]) ** 0.5
    w, b, g2 = np.zeros((_DIM, n_class), np.float32), np.zeros(n_class, np.float32), np.full((_DIM, n_class), 1e-4, np.float32)
    for epoch in range(epochs):
        for lo in range(0, len(xs), 512):
            hi = min(len(xs), lo + 512)
            ix, n = idx[starts[lo] : starts[hi]], lens[lo:hi]
            rows, scale = np.repeat(np.arange(hi - lo), n), 1 / np.sqrt(np.maximum(1, n))
            z = np.add.reduceat(w[ix], starts[lo:hi] - starts[lo], axis=0)
            z = z * scale[:, None] + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(hi - lo), y[lo:hi]] -= 1
            p *= row_w[lo:hi, None]
            order = np.argsort(ix, kind="stable")
            u, first = np.unique(ix[order], return_index=True)
            grad = np.add.reduceat((p * scale[:, None]).astype(np.float32)[rows[order]], first, axis=0)
            g2[u] += grad**2
            w[u] -= 0.5 * grad / np.sqrt(g2[u])
            b -= 0.02 * p.mean(axis=0)
    return ChainModel(w, b, lexicon)


def bare(word: str) -> str:
    return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", word).lower()


# words end at ASCII white space and at the marks between the parts of paths, names and table cells
_TOKEN = re.compile(r"(?<![^\x00-\x20/_|=()\[\]])[^\x00-\x20/_|=()\[\]\x7f-\U0010ffff]*+[^\x00-\x7f][^\x00-\x20/_|=()\[\]]*+")


# a sound word with at most one sign at either end
_EDGES = re.compile(r"[“„‘«¿¡°·±–—]?[\x00-\x7f]*[“”‘’»—–…\xad¬‐°·º]?[\x00-\x7f]?[,;.]?")


class Restorer:
    """Judges words, remembering those already seen (at most ``memory`` of them)."""

    def __init__(self, model: ChainModel, *, floor: float = 0.02, sure: float = 0.5, memory: int = 200_000):
        self.model, self.floor, self.sure, self.memory, self.seen = model, floor, sure, memory, {}

    def words(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        if not new:
            return
        if len(self.seen) + len(new) > self.memory:
            self.seen.clear()
            new = list(dict.fromkeys(words))
        for w, p in zip(new, self.model.scores(new)):
            self.seen[w] = self.judge(w, p)

    def judge(self, word: str, p: np.ndarray, lexicon: dict[str, int] | None = None) -> tuple[bool, str | None, str | None, float]:
        """(garbled, restored or None, chain, probability). Chains are tried from the most probable on until one
        inverts strictly into a plausible word: those from UTF-8, where strict decoding is proof by itself, as long
        as they are more than ``floor`` probable, the others from ``sure`` on."""
        order, lexicon = np.argsort(-p), self.model.lexicon if lexicon is None else lexicon
        if _EDGES.fullmatch(word):
            return False, None, None, float(p[SOUND])
        if "�" in word:
            return True, None, "lost", float(p[CHAINS.index(("lost",))])
        same: dict[str, float] = {}  # chains that differ only in bytes not at hand share their probability
        for k in order:
            if p[k] < self.floor / 4:
                break
            if k == SOUND or (chain := CHAINS[k]) == ("lost",):
                continue
            back = invert(word, chain)
            if back is None or not plausible_after(back, chain):
                continue
            if chain[0] == "utf-8":
                if p[k] >= self.floor:
                    return True, back, ">".join(chain), float(p[k])
            own, right = lexicon.get(bare(word), 0), lexicon.get(bare(back), 0)
            # a word that looks sound is one unless its original is at least twice as frequent
            if own and right < 2 * own or not right and (plausible(word) or len(bare(back)) == 1 and not bare(back).isascii()):
                continue
            else:
                same[back] = same.get(back, 0.0) + float(p[k])
        if same:
            back = max(same, key=lambda w: (same[w], w))
            if same[back] >= self.sure:
                chain = next(CHAINS[k] for k in order if k != SOUND and CHAINS[k][0] != "utf-8" and invert(word, CHAINS[k]) == back)
                return True, back, ">".join(chain), same[back]
        # a part of the word may be garbled and the rest sound
        for k in order:
            if k == SOUND or p[k] < self.floor or (chain := CHAINS[k])[0] != "utf-8":
                continue
            runs = re.sub(r"[^\x00-\x7f]+", lambda m: (b if (b := invert(m[0], chain)) and plausible_after(b, chain) else m[0]), word)  # noqa: B023
            if runs != word:
                return True, runs, ">".join(chain), float(p[k])
        return False, None, None, float(p[SOUND])

    def text(self, text: str) -> tuple[bool, str | None, list[str]]:
        """(garbled, restored text or None where a part is lost, chains)."""
        self.words(_TOKEN.findall(text))
        return restore(text, self.seen)


def restore(text: str, judged: dict[str, tuple]) -> tuple[bool, str | None, list[str]]:
    """(garbled, restored text or None where a part is lost, chains), by what is known of the text's words: (garbled, restored, chain)."""
    bad = [g for w in _TOKEN.findall(text) if (g := judged.get(w)) and g[0]]
    if not bad:
        return False, text, []
    lost = any(g[1] is None for g in bad)
    fixed = None if lost else _TOKEN.sub(lambda m: g[1] if (g := judged.get(m[0])) and g[0] else m[0], text)
    return True, fixed, sorted({g[2] for g in bad})


def plausible_after(word: str, chain: tuple[str, ...]) -> bool:
    if chain[0] == "utf-8":  # strict decoding is strong evidence by itself; other scripts may come out
        return all(c.isprintable() or c in " ­" for c in word)
    return plausible(word)


def _words(text_cols: list[str]):
    """The words with a character beyond ASCII in these columns."""
    token = r"(?<![^\x00-\x20/_|=()\[\]])[^\x00-\x20/_|=()\[\]\x7f-\x{10FFFF}]*+[^\x00-\x7F][^\x00-\x20/_|=()\[\]]*+"
    return F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(token), F.lit(0)) for c in text_cols]))


def word_counts(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """``w``, ``count``: the words with a character beyond ASCII, counted over all rows."""
    return df.select(F.explode(_words(text_cols)).alias("w")).groupBy("w").count()


def frequent_words(counted: DataFrame, *, limit: int) -> dict[str, int]:
    """The ``limit`` most frequent of ``counted``: the training words."""
    return {r["w"]: r["count"] for r in counted.orderBy(F.desc("count"), "w").limit(limit).collect()}


def judged_words(counted: DataFrame, model: ChainModel) -> DataFrame:
    """``w``, ``restored``, ``chain``: the garbled ones of the distinct words ``counted`` (w, count), each judged once.

    Whether a word is another garbled through a single-byte chain depends on how often the other occurs, and it itself: every word
    gets by join the counts, over all rows, of the sound words that it may stand for. A single letter is counted whether or
    not it looks sound: as a sign of its own (a Greek letter, say) it isn't rarer than its original."""
    shared = counted.sparkSession.sparkContext.broadcast(replace(model, lexicon={}))  # 4 MB

    def sound(b: pd.DataFrame) -> pd.DataFrame:
        b = b[[(_clean(w) or len(bare(w)) == 1) and re.search(r"[^\W\d_]", w) is not None for w in b["w"]]]
        return pd.DataFrame({"x": b["w"].map(bare).astype(str), "n": b["count"]})

    def asked(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for w in b["w"]:
            backs = {bare(back) for c in CHAINS if c[0] not in ("utf-8", "lost") and (back := invert(w, c)) and plausible_after(back, c)}
            rows += [(w, x) for x in sorted(backs | {bare(w)})] if backs else []
        return pd.DataFrame(rows, columns=["w", "x"], dtype=str)

    def judge(b: pd.DataFrame) -> pd.DataFrame:
        tool, words = Restorer(shared.value), b["w"].tolist()
        out = []
        for w, p, known in zip(words, shared.value.scores(words), b["known"]):
            got = tool.judge(w, p, {} if known is None else {k["x"]: k["n"] for k in known})
            if got[0]:
                out.append((w, got[1], got[2]))
        return pd.DataFrame(out, columns=["w", "restored", "chain"], dtype=object)

    known = counted.mapInPandas(over_batches(sound), "x string, n bigint").groupBy("x").agg(F.sum("n").alias("n"))
    pairs = counted.mapInPandas(over_batches(asked), "w string, x string").join(known, "x").groupBy("w").agg(F.collect_list(F.struct("x", "n")).alias("known"))  # a word's own inversions
    return counted.select("w").join(pairs, "w", "left").mapInPandas(over_batches(judge), "w string, restored string, chain string")


def find_garbled(df: DataFrame, key_cols: list[str], text_cols: list[str], *, model: ChainModel | None = None, train_words: int = 1200, small: int = 200_000) -> DataFrame:
    """Fields whose text was, at least in part, read in a wrong encoding.

    Returns ``key_cols``, ``field_name``, ``garbled`` (the text), ``restored`` (null where a character is lost for
    good), ``chains`` (array: encoding of the bytes > encoding they were read in, ...). One row per affected field;
    fields that are null, empty or sound give none. Equal rows are judged alike and kept each. Columns other than
    ``key_cols`` and ``text_cols`` are ignored, so their names can't clash. An empty table gives an empty result.

    ``train_words`` bounds the training words (the corpus's most frequent clean ones), not the words looked up, which are
    counted over all rows. Each distinct word beyond ASCII is judged once; rows get by join what was found of their
    words, and rows without such words never leave the JVM. ``small`` only says up to where the garbled words are sent to the rows
    instead of shuffled with their words.
    """
    odd = [F.col(c).rlike(r"[^\x00-\x7F]") for c in text_cols]
    any_odd = odd[0]
    for o in odd[1:]:
        any_odd = any_odd | o
    rows = df.where(any_odd).select(*key_cols, *text_cols)
    counted = cut(word_counts(rows, text_cols))
    if model is None:
        model = fit_chain_model(frequent_words(counted, limit=train_words), max_words=train_words)
    bad = cut(judged_words(counted, model))
    bad = F.broadcast(bad) if bad.count() <= small else bad
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) for c in text_cols])))
    hints = hashed.select("_h", F.explode(F.array_distinct(_words(text_cols))).alias("w")).join(bad, "w").groupBy("_h").agg(F.collect_set(F.struct("w", "restored", "chain")).alias("_bad"))  # a row's own words
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key_cols).schema), "field_name string", "garbled string", "restored string", "chains array<string>"])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, hint in enumerate(b["_bad"]):
            judged = {h["w"]: (True, h["restored"], h["chain"]) for h in hint}
            for c in text_cols:
                t = b[c].iat[i]
                if t and not t.isascii():
                    bad, fixed, chains = restore(t, judged)
                    if bad:
                        out.append((i, c, t, fixed, chains))
        got = b[key_cols].iloc[[o[0] for o in out]].reset_index(drop=True)
        got["field_name"], got["garbled"] = [o[1] for o in out], [o[2] for o in out]
        got["restored"], got["chains"] = [o[3] for o in out], [o[4] for o in out]
        return got

    return hashed.join(hints, "_h").drop("_h").mapInPandas(over_batches(run), schema)
