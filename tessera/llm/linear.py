"""Linear models over hashed features, trained with numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .common import fnv


def fit(starts: np.ndarray, idx: np.ndarray, y: np.ndarray, *, dim: int, weight: np.ndarray | None = None, epochs: int = 4, rate: float = 0.5, batch: int = 256, l2: float = 1e-6, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """One logistic model per column of ``y`` (0 or 1), by AdaGrad. Row i has the features
    ``idx[starts[i]:starts[i + 1]]`` (one at least), each of value 1 / sqrt(their number)."""
    n, k = y.shape
    w, b, g2 = np.zeros((dim, k), np.float32), np.zeros(k, np.float32), np.full((dim, k), 1e-4, np.float32)
    lens, rng = np.diff(starts), np.random.default_rng(seed)
    weight = np.ones(n, np.float32) if weight is None else weight.astype(np.float32)
    scale = (1 / np.sqrt(np.maximum(1, lens))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            at = np.concatenate([[0], np.cumsum(lens[rows])])
            ix = idx[np.repeat(starts[rows] - at[:-1], lens[rows]) + np.arange(at[-1])]
            z = np.add.reduceat(w[ix], at[:-1], axis=0) * scale[rows, None] + b
            p = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows, None]
            by = np.argsort(ix, kind="stable")
            u, first = np.unique(ix[by], return_index=True)
            grad = np.add.reduceat((p * scale[rows, None]).astype(np.float32)[np.repeat(np.arange(len(rows)), lens[rows])[by]], first, axis=0)
            g2[u] += grad**2
            w[u] -= rate * (grad / np.sqrt(g2[u]) + l2 * w[u])
            b -= 0.05 * p.mean(axis=0)
    return w, b


def ragged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return starts, np.concatenate(parts) if parts else np.zeros(0, np.int64)


_HASHES: dict[str, int] = {}


def word_hash(word: str) -> int:
    """A 64-bit hash that all machines agree on; seen words are remembered, a bounded number of them."""
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = 0xCBF29CE484222325
        for c in word.encode("utf-8", "replace"):
            h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        _HASHES[word] = h
    return h


def word_ngrams(sents: list[list[str]], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of neighbouring words of tokenised sentences, as (starts, indices); each sentence has one
    index more, so that none is empty."""
    lens = np.fromiter((len(s) for s in sents), np.int64, len(sents))
    flat = np.fromiter((word_hash(w) for s in sents for w in s), np.uint64, int(lens.sum()))
    starts = np.zeros(len(sents) + 1, np.int64)
    np.cumsum(2 * lens + 1, out=starts[1:])
    out = np.zeros(starts[-1], np.int64)
    at = np.zeros(len(sents) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    place = np.arange(len(flat)) + np.repeat(starts[:-1] - at[:-1], lens)
    m = np.uint64(dim)
    out[place] = (fnv(flat) % m).astype(np.int64)
    nxt = np.empty_like(flat)
    nxt[:-1] = flat[1:]
    if len(flat):
        nxt[at[1:][lens > 0] - 1] = np.uint64(7)  # the sentence's end
    with np.errstate(over="ignore"):
        out[place + np.repeat(lens, lens)] = (fnv(flat * np.uint64(0x9E3779B97F4A7C15) + nxt, 5) % m).astype(np.int64)
    return starts, out


@dataclass
class WordTable:
    """Word vectors as sums of weights of hashed character n-grams, computed once for every distinct word and kept for
    at most ``memory`` words."""

    weights: np.ndarray
    memory: int = 400_000
    ids: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    counts: np.ndarray | None = None
    used: int = 0

    def lookup(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            new = [w for w in dict.fromkeys(words) if w not in self.ids]
            if self.used + len(new) > self.memory:
                self.ids, self.used = {}, 0
                new = list(dict.fromkeys(words))
            self._add(new)
            out = [self.ids[w] for w in words]
        return np.array(out, np.int64)

    def _add(self, new: list[str]) -> None:
        starts, idx = ragged([char_ngrams(w, len(self.weights)) for w in new])
        sums = np.add.reduceat(self.weights[idx], starts[:-1], axis=0)
        need = self.used + len(new)
        if self.rows is None or need > len(self.rows):
            grown = np.zeros((max(1024, 2 * need), self.weights.shape[1]), np.float32)
            counts = np.zeros(len(grown), np.float32)
            if self.rows is not None:
                grown[: self.used], counts[: self.used] = self.rows[: self.used], self.counts[: self.used]
            self.rows, self.counts = grown, counts
        self.rows[self.used : need], self.counts[self.used : need] = sums, np.diff(starts)
        for i, w in enumerate(new):
            self.ids[w] = self.used + i
        self.used = need


def char_ngrams(word: str, dim: int) -> np.ndarray:
    """Hashed character n-grams (1 to 4, with marks for both ends) of a word, and the word."""
    b = np.frombuffer(f" {word} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    parts, with_len = [np.array([word_hash(word)], np.uint64)], b
    with np.errstate(over="ignore"):
        for n in (1, 2, 3, 4):
            if len(b) < n + (n == 1):
                break
            if n > 1:
                with_len = with_len[:-1] * np.uint64(0x100000001B3) ^ b[n - 1 :]
            parts.append(with_len + np.uint64(n << 40))
    return (fnv(np.concatenate(parts)) % np.uint64(dim)).astype(np.int64)
