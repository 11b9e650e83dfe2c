"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams of sentences.

The training sentences carry weak labels, from section metadata (the topic of a passage) or from the address (the
subject's name within the file name). Sentences that stand under every topic alike end up below all thresholds. The
thresholds are calibrated for each subject on documents whose subjects are known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, sentences
from .language import unbroken
from .linear import fit, word_ngrams

DIM = 1 << 18
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def words_of(sentence: str) -> list[str]:
    return [re.sub(r"\d+", "0", w) for w in _WORD.findall(sentence.lower())]


def usable(text: str | None) -> list[list[str]]:
    """Tokenised sentences of three words or more."""
    return [w for s in sentences(unbroken(text or "")) if len(w := words_of(s)) >= 3]


def weak_label(topic: str | None, address: str | None, subjects: list[str]) -> str | None:
    """The subject that the metadata's topic names, else the one whose name is a part of the address."""
    if topic and topic.strip().lower() in subjects:
        return topic.strip().lower()
    if topic:
        return None
    parts = set(re.split(r"[^a-z]+", (address or "").lower()))
    named = [s for s in subjects if s in parts]
    return named[0] if len(named) == 1 else None


@dataclass
class SubjectModel:
    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))  # a sentence's threshold by subject
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))  # a document's least share by subject

    def sentence_scores(self, sents: list[list[str]]) -> np.ndarray:
        starts, idx = word_ngrams(sents, DIM)
        z = np.add.reduceat(self.weights[idx], starts[:-1], axis=0) / np.sqrt(np.diff(starts))[:, None] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def shares(self, docs: list[list[list[str]]], cut: np.ndarray | None = None) -> np.ndarray:
        """(documents, subjects): the part of a document's sentences that lies above the threshold."""
        cut = self.cut if cut is None else cut
        flat = [s for d in docs for s in d]
        lens = np.array([len(d) for d in docs])
        out = np.zeros((len(docs), len(self.subjects)))
        if flat:
            p = self.sentence_scores(flat)
            hit = (p >= cut) & (p >= p.max(axis=1, keepdims=True) * 0.5)
            at = np.concatenate([[0], np.cumsum(lens)])[:-1]
            some = lens > 0
            out[some] = np.add.reduceat(hit.astype(float), at[some], axis=0) / lens[some, None]
        return out


def fit_subjects(weak: pd.DataFrame, known: pd.DataFrame, subjects: list[str], *, least_share: float = 0.2, max_sentences: int = 60_000) -> SubjectModel:
    """``weak``: rows (text, subject) with weak labels. ``known``: rows (text, subjects), all subjects of each document,
    for the thresholds. At most ``max_sentences`` sentences are used for the weights."""
    subjects = sorted(subjects)
    sents, ys, fold = [], [], []
    for i, (text, subject) in enumerate(zip(weak["text"], weak["subject"])):
        if subject in subjects:
            for s in usable(text):
                sents.append(s)
                ys.append(subjects.index(subject))
                fold.append(i % 2)
    k = len(subjects)
    model = SubjectModel(subjects, np.zeros((DIM, k), np.float32), np.full(k, -4.0, np.float32), np.full(k, 0.5), np.full(k, least_share))
    if not sents:
        return model
    pick = np.random.default_rng(11).permutation(len(sents))[:max_sentences]
    sents, y, fold = [sents[i] for i in pick], np.array(ys)[pick], np.array(fold)[pick]
    one = np.eye(k, dtype=np.float32)[y]
    share = np.bincount(y, minlength=k) + 1.0
    weight = np.clip((len(y) / k) / share[y], 0.3, 3.0)
    starts, idx = word_ngrams(sents, DIM)
    # Passages that deal with something besides their topic: where the model of the other half is sure of another
    # subject, the sentence isn't an example of its label.
    target = one.copy()
    for half in (0, 1):
        if (fold != half).any() and (fold == half).any():
            w, b = _train(starts, idx, one, weight, fold != half, epochs=2)
            z = np.add.reduceat(w[idx], starts[:-1], axis=0) / np.sqrt(np.diff(starts))[:, None] + b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            best = p.argmax(axis=1)
            other = (fold == half) & (best != y) & (p[np.arange(len(y)), best] > 0.6) & (p[np.arange(len(y)), y] < 0.2)
            target[other] = np.eye(k, dtype=np.float32)[best[other]]
    model.weights, model.bias = _train(starts, idx, target, weight, np.ones(len(y), bool), epochs=3)
    return calibrate(model, known, least_share=least_share)


def _train(starts, idx, target, weight, rows, epochs):
    at = np.flatnonzero(rows)
    lens = np.diff(starts)[at]
    new = np.concatenate([[0], np.cumsum(lens)])
    ix = idx[np.repeat(starts[at] - new[:-1], lens) + np.arange(new[-1])]
    return fit(new, ix, target[at], dim=DIM, weight=weight[at], epochs=epochs)


def calibrate(model: SubjectModel, known: pd.DataFrame, *, least_share: float) -> SubjectModel:
    """Choose each subject's sentence threshold and share by F1 on documents with known subjects. The share stays at
    ``least_share`` unless another one is clearly better, as sentences may be cut and judged a little differently."""
    docs = [usable(t) for t in known["text"]]
    if not docs:
        return model
    truth = np.array([[s in set(x) for s in model.subjects] for x in known["subjects"]])
    best = np.full(len(model.subjects), -1.0)
    for cut in (0.5, 0.35, 0.25, 0.65, 0.8):
        got = model.shares(docs, np.full(len(model.subjects), cut))
        for share in (least_share, least_share * 0.85, least_share * 1.1, least_share * 0.7):
            hit = got >= share - 1e-9
            tp = (hit & truth).sum(axis=0)
            f1 = 2 * tp / np.maximum(1, hit.sum(axis=0) + truth.sum(axis=0))
            better = f1 > best + 0.004
            best = np.where(better, f1, best)
            model.cut = np.where(better, cut, model.cut)
            model.share = np.where(better, share, model.share)
    return model


def label_subjects(df: DataFrame, key_cols: list[str], text_col: str, model: SubjectModel) -> DataFrame:
    """``key_cols``, ``subject``, ``share`` (part of the text's sentences on it) and ``n_sentences`` for every subject that a
    text deals with; a text on none gives no row, nor does a null or empty one. Equal rows come out alike; columns
    other than keys and text aren't returned. One pass without shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: DIM x subjects floats
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*key_cols).schema), "subject string, share double, n_sentences int"])

    def run(batches):
        m = shared.value

        def one(b: pd.DataFrame) -> pd.DataFrame:
            docs = [usable(t) for t in b["_text"]]
            got = m.shares(docs)
            i, j = np.nonzero(got >= m.share - 1e-9)
            keys = b[key_cols].iloc[i].reset_index(drop=True)
            keys["subject"] = [m.subjects[x] for x in j]
            keys["share"] = np.round(got[i, j], 6)
            keys["n_sentences"] = np.array([len(docs[x]) for x in i], np.int32)
            return keys

        yield from over_batches(one)(batches)

    return df.select(*key_cols, F.col(text_col).alias("_text")).mapInPandas(run, schema)
