"""Languages of documents and of the stretches in mixed ones, by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed character n-grams predicts each of its bits. A
sentence gets the language whose codeword loses least against the predicted bits, each bit weighted by how well its
classifier did on held-out sentences, and is ambiguous if the next codeword loses hardly more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_batches, sentences
from .linear import WordTable, char_ngrams, fit, ragged

# Spellings of the labels, lower case, without region.
LABELS = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglese"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francese"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "spagnolo"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien"),
}
# Labels that name no language.
NO_LABEL = ("", "n/a", "na", "none", "null", "und", "unknown", "unk", "mul", "mis", "zxx", "other", "-", "?", "xx")

DIM = 1 << 15


def normal_label(label: Column) -> Column:
    """The two-letter code that a label means: null where it names none, the label itself where it names another."""
    t = F.lower(F.trim(label))
    base = F.when(t.rlike(r"^[a-z]{2,3}[-_][a-z0-9]{2,4}$"), F.regexp_extract(t, r"^[a-z]+", 0)).otherwise(t)
    out = F.when(t.isNull() | base.isin(*NO_LABEL), F.lit(None).cast("string"))
    for code, names in LABELS.items():
        out = out.when(base.isin(*names), F.lit(code))
    return out.otherwise(base)


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def unbroken(text: str) -> str:
    """Words divided at a line end in one piece."""
    return re.sub(r"([^\W\d_])[-‐¬\xad—][ \t]*\n\s*([a-zà-öø-ÿß])", r"\1\2", text)


@dataclass
class CodeModel:
    langs: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray  # languages x bits, rows sum to 1
    heat: float  # turns losses into probabilities

    def losses(self, z: np.ndarray) -> np.ndarray:
        m = z[:, None, :] * self.codes[None]
        return (np.log1p(np.exp(-np.clip(m, -30, 30))) * self.bit_weight[None]).sum(axis=2)

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        s = -self.losses(z) * self.heat
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def codewords(k: int) -> np.ndarray:
    """The exhaustive code of k classes: every way to part them in two, once."""
    rows = []
    for j in range(1, 2 ** (k - 1)):
        bits = [1] + [1 if (2 ** (k - 1) - 1 - j) >> i & 1 else -1 for i in range(k - 1)]
        if len(set(bits)) > 1:
            rows.append(bits)
    return np.array(rows, np.float32).T


def fit_languages(sample: pd.DataFrame, *, max_sentences: int = 8_000) -> CodeModel:
    """Fit on rows (text, lang) with known labels. Labels may be wrong: sentences that a model of the other half of the
    texts gives another language than their label are left out of the last fit."""
    langs = list(LABELS)
    rng = np.random.default_rng(5)
    feats, ys, fold = [], [], []
    for i, (text, lang) in enumerate(zip(sample["text"], sample["lang"])):
        for s in sentences(unbroken(text or "")):
            words = tokens(s)
            if len(words) >= 4:
                feats.append(words)
                ys.append(langs.index(lang))
                fold.append(i % 2)
    codes = codewords(len(langs))
    if not feats:
        return CodeModel(langs, codes, np.zeros((DIM, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32), np.full(codes.shape, 1 / codes.shape[1]), 1.0)
    pick = rng.permutation(len(feats))[:max_sentences]
    known: dict[str, np.ndarray] = {}
    grams = lambda w: known[w] if w in known else known.setdefault(w, char_ngrams(w, DIM))
    feats, y = [np.concatenate([grams(w) for w in feats[i]]) for i in pick], np.array(ys)[pick]
    fold = np.array(fold)[pick]
    share = np.bincount(y, minlength=len(langs)) + 1.0
    weight = np.minimum(3.0, (len(y) / len(langs)) / share[y])
    held = np.arange(len(y)) % 5 == 0

    def train(rows: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
        starts, idx = ragged([feats[i] for i in rows])
        return fit(starts, idx, (codes[y[rows]] > 0).astype(np.float32), dim=DIM, weight=weight[rows], epochs=epochs)

    starts, idx = ragged(feats)
    raw = lambda w, b: np.add.reduceat(w[idx], starts[:-1], axis=0) / np.sqrt(np.diff(starts))[:, None] + b
    flat = np.full(codes.shape, 1 / codes.shape[1])
    sound = np.zeros(len(y), bool)
    for half in (0, 1):
        w, b = train(np.flatnonzero(fold != half) if (fold != half).any() else np.arange(len(y)), 2)
        loss = CodeModel(langs, codes, w, b, flat, 4.0).losses(raw(w, b))
        sound |= (fold == half) & (loss.argmin(axis=1) == y)
    fine = np.flatnonzero(sound & ~held)
    w, b = train(fine if len(fine) else np.arange(len(y)), 3)
    test = np.flatnonzero(sound & held) if (sound & held).any() else np.arange(len(y))
    z = raw(w, b)[test]
    good = np.zeros(codes.shape, np.float32)
    for k in range(len(langs)):
        own = z[y[test] == k] * codes[k]
        good[k] = (own > 0).mean(axis=0) if len(own) else 0.5
    bit_weight = np.maximum(good - 0.4, 0.05)
    bit_weight /= bit_weight.sum(axis=1, keepdims=True)
    model = CodeModel(langs, codes, w, b, bit_weight, 1.0)
    losses = model.losses(z)

    def nll(heat: float) -> float:
        s = -losses * heat
        s -= s.max(axis=1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(axis=1, keepdims=True)))[np.arange(len(test)), y[test]].mean())

    model.heat = min((1.0, 2.0, 4.0, 8.0, 16.0), key=nll)
    return model


class Labeller:
    def __init__(self, model: CodeModel):
        self.model, self.words = model, WordTable(model.weights)

    def margins(self, sents: list[list[str]]) -> np.ndarray:
        """Predicted bits of tokenised sentences, none of them empty."""
        lens = np.fromiter((len(s) for s in sents), np.int64, len(sents))
        ids = self.words.lookup([w for s in sents for w in s])
        at = np.concatenate([[0], np.cumsum(lens)])[:-1]
        sums = np.add.reduceat(self.words.rows[ids], at, axis=0)
        n = np.add.reduceat(self.words.counts[ids], at)
        return sums / np.sqrt(n)[:, None] + self.model.bias

    def texts(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, bool]]]:
        """For every text its stretches: (first sentence, sentences, language, confidence, ambiguous)."""
        sents, owner, place = [], [], []
        totals = []
        for i, t in enumerate(texts):
            parts = sentences(unbroken(t or ""))
            totals.append(len(parts))
            for j, s in enumerate(parts):
                words = tokens(s)
                if words:
                    sents.append(words)
                    owner.append(i)
                    place.append(j)
        out: list[list] = [[] for _ in texts]
        if not sents:
            return out
        p = self.model.probabilities(self.margins(sents))
        owner, place = np.array(owner), np.array(place)
        size = np.array([sum(map(len, s)) for s in sents])
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(owner)]])):
            out[owner[lo]] = self._stretches(p[lo:hi], place[lo:hi], size[lo:hi])
        return out

    def _stretches(self, p: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[tuple[int, int, str, float, bool]]:
        """Neighbouring sentences of one language. Sentences that are short or undecided go with their surroundings."""
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        unsure = (size < 12) | (top[:, -1] - top[:, -2] < 0.3)
        if not unsure.all():
            sure = np.flatnonzero(~unsure)
            for i in np.flatnonzero(unsure):
                near = sure[np.argmin(np.abs(sure - i))]
                best[i] = best[near]
        else:
            best[:] = np.log(p + 1e-9).sum(axis=0).argmax()
        out, lo = [], 0
        for hi in range(1, len(best) + 1):
            if hi == len(best) or best[hi] != best[lo]:
                mean = np.exp((np.log(p[lo:hi] + 1e-9) * size[lo:hi, None]).sum(axis=0) / size[lo:hi].sum())
                mean /= mean.sum()
                conf = float(mean[best[lo]])
                out.append((int(place[lo]), hi - lo, self.model.langs[best[lo]], round(conf, 6), bool(conf < 0.6)))
                lo = hi
        return out


def label_languages(df: DataFrame, key_cols: list[str], text_col: str, model: CodeModel, *, least_confidence: float = 0.9) -> DataFrame:
    """The stretches of every text in one language: ``key_cols``, ``segment_no``, ``first_sentence``, ``n_sentences``,
    ``segment_lang``, ``confidence``, ``ambiguous``, ``counts`` (whether the language counts for the text: an unambiguous stretch of two
    sentences or more in it, of ``least_confidence`` at least, or the text's main language). A page header and the fragment of a
    sentence beside it make no language of their own.

    One pass without shuffle. Null, empty and wordless texts give no row, equal rows equal rows; columns other than
    keys and text aren't returned."""
    spark = df.sparkSession
    rows = df.select(*key_cols, F.col(text_col).alias("_text"))
    shared = spark.sparkContext.broadcast(model)  # fixed size: DIM x 15 floats
    seg = "segment_no int, first_sentence int, n_sentences int, segment_lang string, confidence double, ambiguous boolean, counts boolean"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key_cols).schema), seg])

    def run(batches):
        tool = Labeller(shared.value)

        def one(b: pd.DataFrame) -> pd.DataFrame:
            rows, at = [], []
            for i, stretches in enumerate(tool.texts(b["_text"].tolist())):
                total: dict[str, int] = {}
                for _, n, lang, _, _ in stretches:
                    total[lang] = total.get(lang, 0) + n
                main = max(total, key=lambda k: (total[k], k)) if total else None
                ok = {lang for _, n, lang, conf, amb in stretches if n >= 2 and conf >= least_confidence and not amb} | {main}
                for j, (first, n, lang, conf, amb) in enumerate(stretches):
                    at.append(i)
                    rows.append((j, first, n, lang, conf, amb, lang in ok))
            got = b[key_cols].iloc[at].reset_index(drop=True)
            more = pd.DataFrame(rows, columns=["segment_no", "first_sentence", "n_sentences", "segment_lang", "confidence", "ambiguous", "counts"])
            return pd.concat([got, more], axis=1)

        yield from over_batches(one)(batches)

    return rows.mapInPandas(run, schema)
