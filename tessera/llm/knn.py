"""The most similar vectors of every vector: hierarchical navigable small-world graphs per shard, results merged.

Points go to shards by their nearest centre. One task per shard builds the shard's graph by layered insertion and
answers every query through it: the shard's own points, each starting at itself, and the points that lie near the
shard's border, coming in through the upper levels. How near is measured on the sample that the centres are fitted on.
Nothing is compared all to all: neighbours come out of the graph search alone, at every size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import thinned

# --- one shard's graph --------------------------------------------------------------------------------------------


@dataclass
class Graph:
    """Flat arrays. ``x``: the points, those of upper levels first, so that level l holds the points 0 to n_l - 1;
    ``names``: their positions in the input; ``links``: for each level, from the ground, an array (n_l, width) of neighbours, -1 where there are fewer."""

    x: np.ndarray
    names: np.ndarray
    links: list[np.ndarray]

    def descend(self, q: np.ndarray, to: int = 0) -> np.ndarray:
        """Entry points for level ``to``: the best ones found on the level above, coming from the top."""
        top = len(self.links) - 1
        entry = np.zeros((len(q), 1), np.int64)
        for level in range(top, to, -1):
            links = self.links[level]
            entry, _ = beam(self.x[: len(links)], links, q, entry, 4)
            entry = np.where(entry < 0, entry[:, :1], entry)
        return entry

    def search(self, q: np.ndarray, k: int, ef: int = 40, *, entry: np.ndarray | None = None, budget: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(points, products) of about the ``k`` best points for each query, best first; -1 where there are fewer. ``entry``:
        where to start on the ground (default: through the upper levels)."""
        n, ef = len(self.x), max(ef, k)
        idx, sim = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -2, np.float32)
        if not n:
            return idx, sim
        step = max(64, min(1024, budget // n))
        for lo in range(0, len(q), step):
            b = q[lo : lo + step]
            start = self.descend(b) if entry is None else entry[lo : lo + step]
            got, s = beam(self.x, self.links[0], b, start, ef)
            w = min(k, got.shape[1])
            idx[lo : lo + step, :w], sim[lo : lo + step, :w] = got[:, :w], s[:, :w]
        return idx, sim

    def search_own(self, k: int, ef: int = 40) -> tuple[np.ndarray, np.ndarray]:
        """For each point the ``k`` best others, by a search that starts at the point itself."""
        own = np.arange(len(self.x))
        idx, sim = self.search(self.x, k + 1, ef, entry=own[:, None])
        others = np.argsort(idx == own[:, None], axis=1, kind="stable")[:, :k]  # the point itself goes to the end
        return np.take_along_axis(idx, others, 1), np.take_along_axis(sim, others, 1)


_STEP = 2048  # products at a time, so that their vectors stay in the processor's cache


def _products(q: np.ndarray, r: np.ndarray, x: np.ndarray, node: np.ndarray) -> np.ndarray:
    """q[r] · x[node] row by row."""
    out = np.empty(len(r), np.float32)
    a, b = np.empty((2, min(_STEP, len(r)), x.shape[1]), np.float32)
    for lo in range(0, len(r), _STEP):
        hi = min(lo + _STEP, len(r))
        np.take(q, r[lo:hi], axis=0, out=a[: hi - lo], mode="clip")
        np.take(x, node[lo:hi], axis=0, out=b[: hi - lo], mode="clip")
        np.einsum("ed,ed->e", a[: hi - lo], b[: hi - lo], out=out[lo:hi])
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all queries in step: each round every query still at work opens the ``wide`` best points
    it hasn't opened, and keeps the ``ef`` best seen. A query is done when it has opened all that it keeps."""
    n_q, n = len(q), len(x)
    seen = np.zeros(n_q * n, bool)
    rows = np.arange(n_q)
    ids = np.full((n_q, ef), -1, np.int64)
    sims = np.full((n_q, ef), -2, np.float32)
    opened = np.ones((n_q, ef), bool)
    first = np.sort(entry, axis=1)[:, :ef]
    dup = np.zeros(first.shape, bool)
    dup[:, 1:] = first[:, 1:] == first[:, :-1]
    e = first.shape[1]
    s = np.einsum("qd,qed->qe", q, x[first])
    s[dup] = -2
    ids[:, :e], sims[:, :e], opened[:, :e] = np.where(dup, -1, first), s, dup
    seen[(rows[:, None] * n + first).ravel()] = True
    active, w = rows, min(wide, ef)
    while len(active):
        s_a = np.where(opened[active], -3, sims[active])
        pick = np.argpartition(-s_a, w - 1, axis=1)[:, :w] if w < ef else np.broadcast_to(np.arange(ef), s_a.shape)
        ok = np.take_along_axis(s_a, pick, 1) > -2
        going = ok.any(axis=1)
        active, pick, ok = active[going], pick[going], ok[going]
        if not len(active):
            break
        opened[active[:, None], pick] = True
        nodes = np.where(ok, ids[active[:, None], pick], -1)
        base, rs, ns = active * n, [], []
        for j in range(w):  # one opened point at a time: its links are distinct, so none comes twice
            at = np.flatnonzero(nodes[:, j] >= 0)
            nb = links[nodes[at, j]].astype(np.int64)
            flat = base[at, None] + nb
            new = (nb >= 0) & ~seen[np.maximum(flat, 0)]
            i, c = np.nonzero(new)
            node = nb[i, c]
            seen[flat[i, c]] = True
            rs.append(at[i])
            ns.append(node)
        r, node = np.concatenate(rs), np.concatenate(ns)
        if not len(r):
            continue
        d = _products(q, active[r], x, node)
        good = np.flatnonzero(d > sims[active].min(axis=1)[r])  # only what beats the worst kept is worth merging
        good = good[np.argsort(r[good], kind="stable")]
        r, node, d = r[good], node[good], d[good]
        if not len(r):
            continue
        place = np.arange(len(r)) - np.searchsorted(r, r)
        touched, back = np.unique(r, return_inverse=True)
        width = int(place.max()) + 1
        ci, cs = np.full((len(touched), width), -1, np.int64), np.full((len(touched), width), -2, np.float32)
        ci[back, place], cs[back, place] = node, d
        at = active[touched]
        all_i, all_s = np.concatenate([ids[at], ci], 1), np.concatenate([sims[at], cs], 1)
        all_o = np.concatenate([opened[at], ci < 0], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[at], sims[at], opened[at] = np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1), np.take_along_axis(all_o, top, 1)
    order = np.lexsort((ids, -sims), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, idx: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first; -1: none) up to ``m``: those nearer to the row than to any kept before, then the
    best of the rest. As an array with -1 where there are fewer."""
    n, k = idx.shape
    out = np.full((n, m), -1, np.int32)
    for lo in range(0, n, 256):
        c, s = idx[lo : lo + 256], sim[lo : lo + 256]
        v = x[np.maximum(c, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(c.shape, bool)
        nearest = np.full(c.shape, -3, np.float32)  # of the kept ones, by candidate
        for j in range(k):
            kept[:, j] = (c[:, j] >= 0) & (nearest[:, j] < s[:, j])
            nearest = np.where(kept[:, j, None], np.maximum(nearest, between[:, j]), nearest)
        order = np.argsort(np.where(c < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :m]
        out[lo : lo + 256, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen points to the ``new`` ones; a full row keeps its most diverse links."""
    src, dst = chosen.ravel().astype(np.int64), np.repeat(new, chosen.shape[1])
    src, dst = src[src >= 0], dst[src >= 0]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    rows, back = np.unique(src, return_inverse=True)
    have = (links[rows] >= 0).sum(axis=1)
    at, width = have[back] + place, links.shape[1]
    full = np.zeros(len(rows), bool)
    np.logical_or.at(full, back, at >= width)
    fits = ~full[back]
    links[src[fits], at[fits]] = dst[fits]
    if full.any():
        over = rows[full]
        number = np.cumsum(full) - 1
        mine = full[back]
        cand = np.full((len(over), width + int(place[mine].max()) + 1), -1, np.int64)
        cand[:, :width] = links[over]
        cand[number[back[mine]], width + place[mine]] = dst[mine]
        s = np.einsum("rd,rcd->rc", x[over], x[np.maximum(cand, 0)])
        s[cand < 0] = -2
        best = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, best, 1), np.take_along_axis(s, best, 1)
        links[over] = diverse(x, cand, s, width)


def build(x: np.ndarray, *, m: int = 16, ef: int = 32, batch: int = 384, seed: int = 13) -> Graph:
    """The graph over the rows of ``x`` by layered insertion in batches: levels are drawn geometrically; from the top level
    down, a level's points come in batches, each point finds its candidates by searching the level as it is so far,
    entering through the finished level above, and besides among the at most ``batch`` points of its own batch. It links to
    the ``m`` most diverse of them, and they link back (up to 2 ``m`` links)."""
    n = len(x)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int)
    order = np.argsort(-level, kind="stable")
    x = np.ascontiguousarray(x[order])
    sizes = [int((level >= lv).sum()) for lv in range(int(level.max(initial=0)) + 1)] or [0]
    graph = Graph(x, order, [])
    finished: list[np.ndarray] = []  # from the top
    for lv in range(len(sizes) - 1, -1, -1):
        size, above = sizes[lv], sizes[lv + 1] if lv + 1 < len(sizes) else 0
        links = np.full((size, 2 * m), -1, np.int32)
        upper = Graph(x, order, [links, *reversed(finished)])
        done = 0
        while done < size:
            end = min(size, done + batch, above if done < above else size)
            q, own = x[done:end], np.arange(done, end)
            inner = q @ q.T
            np.fill_diagonal(inner, -2)
            w = min(m, len(q) - 1)
            near = np.argpartition(-inner, w - 1, axis=1)[:, :w] if w else np.zeros((len(q), 0), np.int64)
            cand, sim = near + done, np.take_along_axis(inner, near, 1)
            if done:
                entry = upper.descend(q) if done >= above > 0 else np.zeros((len(q), 1), np.int64)
                far, s = beam(x[:done], links[:done], q, entry, min(ef, done))
                cand, sim = np.concatenate([cand, far], 1), np.concatenate([sim, s], 1)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :ef]
            chosen = diverse(x, np.take_along_axis(cand, best, 1), np.take_along_axis(sim, best, 1), m) if cand.shape[1] else np.full((len(q), m), -1, np.int32)
            links[done:end, :m] = chosen
            # links within the batch may already be mutual
            mutual = (chosen >= done) & (chosen >= 0)
            if mutual.any():
                both = (chosen[np.maximum(chosen - done, 0)] == own[:, None, None]).any(axis=2) & mutual
                chosen = np.where(both, -1, chosen)
            _link_back(x, links, own, chosen)
            done = end
        finished.append(links)
    graph.links = finished[::-1]
    return graph


# --- routing ------------------------------------------------------------------------------------------------------


@dataclass
class Router:
    """Shards by nested centres: shard (c, r) is the cell of centre c and, within it, of the residual centre r, which all
    cells share. A point visits the shards that are at most ``margin`` farther than its own, up to ``most``."""

    centres: np.ndarray
    residual: np.ndarray
    parts: np.ndarray  # parts that a shard is dealt to by hash
    margin: float = 0.0
    most: int = 8

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, shard) of each row's nearest shards, nearest first."""
        n2, cells = len(self.residual), min(4, len(self.centres))
        to = 1 + (self.centres**2).sum(axis=1)[None] - 2 * (x @ self.centres.T)
        if n2 == 1:
            shard, d = np.broadcast_to(np.arange(len(self.centres)), to.shape), to
        else:
            cell = np.argpartition(to, cells - 1, axis=1)[:, :cells]
            rest = x[:, None] - self.centres[cell]
            d = (rest**2).sum(axis=2)[:, :, None] + (self.residual**2).sum(axis=1) - 2 * (rest @ self.residual.T)
            shard, d = (cell[:, :, None] * n2 + np.arange(n2)).reshape(len(x), -1), d.reshape(len(x), -1)
        keep = min(self.most, d.shape[1])
        top = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        d = np.sqrt(np.maximum(0, np.take_along_axis(d, top, 1)))
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(d, order, 1), np.take_along_axis(np.take_along_axis(shard, top, 1), order, 1)

    def visits(self, x: np.ndarray, deal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, part, home) of all visits; ``deal`` is each row's hash, which decides its part."""
        d, shard = self.distances(x)
        i, j = np.nonzero(d <= d[:, :1] + self.margin)
        s = shard[i, j]
        p = self.parts[s]
        row, s2, j2 = np.repeat(i, p), np.repeat(s, p), np.repeat(j, p)
        part = np.arange(len(row)) - np.repeat(np.cumsum(p) - p, p)
        return row, s2, part, (j2 == 0) & (part == deal[row] % np.repeat(p, p))


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centres by k-means."""
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        a = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        sums, size = np.zeros_like(c), np.bincount(a, minlength=n)
        np.add.at(sums, a, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.choice(len(x), n)])
    return c.astype(np.float32)


def fit_router(sample: np.ndarray, total: int, *, k: int, shard_rows: int, most_cells: int = 1024, coverage: float = 0.98, seed: int = 29) -> Router:
    """Centres on the sample for shards of about ``shard_rows`` of ``total`` points, nested beyond ``most_cells``. The margin is
    such that ``coverage`` of the sample's own nearest neighbours lie in shards that are visited; the sample being a part
    of all points, these neighbours are farther apart than those to be found. Shards that the sample shows to
    hold over four times ``shard_rows`` are dealt to parts."""
    rng = np.random.default_rng(seed)
    wanted = max(1, -(-total // shard_rows))
    n1 = max(1, min(wanted, most_cells, len(sample) // 8))
    n2 = max(1, min(-(-wanted // n1), len(sample) // 8))
    if len(sample) < 2:
        d = sample.shape[1] if sample.ndim == 2 else 1
        return Router(np.zeros((1, d), np.float32), np.zeros((1, d), np.float32), np.ones(1, np.int64))
    c = _means(sample, n1, rng)
    home = ((c**2).sum(axis=1) - 2 * sample @ c.T).argmin(axis=1)
    r = _means(sample - c[home], n2, rng) if n2 > 1 else np.zeros((1, sample.shape[1]), np.float32)
    router = Router(c, r, np.ones(n1 * n2, np.int64))
    d, shard = router.distances(sample)
    share = np.bincount(shard[:, 0], minlength=n1 * n2) / len(sample)
    router.parts = np.maximum(1, np.ceil(share * total / (4 * shard_rows))).astype(np.int64)
    near = max(1, min(k, round(k * len(sample) / max(1, total)), len(sample) - 1))
    q = rng.choice(len(sample), min(2000, len(sample)), replace=False)
    gaps = []
    for lo in range(0, len(q), 128):
        b = q[lo : lo + 128]
        s = sample[b] @ sample.T
        s[np.arange(len(b)), b] = -2
        best = np.argpartition(-s, near - 1, axis=1)[:, :near]
        hit = shard[b][:, None, :] == shard[best, 0][:, :, None]
        gaps.append(np.where(hit, (d[b] - d[b][:, :1])[:, None, :], np.inf).min(axis=2).ravel())
    gaps = np.sort(np.concatenate(gaps))
    finite = gaps[np.isfinite(gaps)]
    at = min(int(coverage * len(gaps)), len(finite) - 1)
    router.margin = float(finite[at]) + 1e-6 if len(finite) else 0.0
    return router


# --- the operator -------------------------------------------------------------------------------------------------


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v) of rows whose vector has ``dim`` numbers, none of them null or no number, and isn't all zero."""
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists("v", lambda e: e != 0)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where((F.size("v") == dim) & F.col("id").isNotNull()).where(fine)


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    x = values.reshape(-1, dim).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` numbers."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _groups(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct pair, the group of each row)."""
    keys = np.empty(len(k1), np.dtype([("a", np.int64), ("b", np.int64)]))
    keys["a"], keys["b"] = k1, k2
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first, back


def _first_ids(group: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) by group: the ``most`` smallest of each, in order."""
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])]) if len(group) else np.zeros(0, bool)
    group, ids = group[fresh], ids[fresh]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    keep = place < most
    return ids[keep], np.bincount(group[keep])


_PLACED = "shard int, part int, home boolean, alone boolean, k1 bigint, k2 bigint, x array<float>, ids array<bigint>, n bigint"
_ANSWERED = "k1 bigint, k2 bigint, alone boolean, n bigint, ids array<bigint>, cosines array<float>, others array<bigint>"


def _answer(table: pa.Table, k: int, dim: int, ef: int, least: float) -> pa.Table:
    """One shard: the graph over its points, and the answers to all that visit it."""
    home = table["home"].to_numpy()
    k1, k2, alone, n = (table[c].to_numpy() for c in ("k1", "k2", "alone", "n"))
    x = _matrix(table["x"], dim)
    at = np.flatnonzero(home)
    first, group = _groups(k1[at], k2[at])  # copies from several batches meet here
    points = at[first]
    col = table["ids"].combine_chunks()
    counts = col.value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(table)), counts)
    flat = col.flatten().to_numpy()
    of_home = home[owner]
    where = np.full(len(table), -1)
    where[at] = group
    ids, n_ids = _first_ids(where[owner[of_home]], flat[of_home], k + 1)
    starts = np.cumsum(n_ids) - n_ids
    rows = np.bincount(group, weights=n[at]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    graph = build(x[points])
    own_i, own_s = graph.search_own(k, ef)
    back = np.argsort(graph.names)  # from positions in the input to points of the graph
    own_i, own_s = own_i[back], own_s[back]
    guests = np.flatnonzero(~home)
    guests = guests[_groups(k1[guests], k2[guests])[0]]
    far_i, far_s = graph.search(x[guests], k, ef)
    query = np.concatenate([points, guests])
    idx, sim = np.concatenate([own_i, far_i]), np.minimum(np.concatenate([own_s, far_s]), 1)
    ok = (idx >= 0) & (sim >= least)
    q, _ = np.nonzero(ok)
    hit, cos = graph.names[idx[ok]] if len(points) else idx[ok], sim[ok]
    # every found point stands for its rows
    many = n_ids[hit] if len(points) else hit
    q, cos, offset = np.repeat(q, many), np.repeat(cos, many), np.repeat(starts[hit] if len(points) else hit, many)
    other = ids[offset + np.arange(len(offset)) - np.repeat(np.cumsum(many) - many, many)] if len(offset) else np.zeros(0, np.int64)
    order = np.lexsort((other, -cos, q))
    q, cos, other = q[order], cos[order], other[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, cos, other = q[keep], cos[keep], other[keep]
    per = np.bincount(q, minlength=len(query))
    return pa.table(
        {
            "k1": k1[query],
            "k2": k2[query],
            "alone": alone[query],
            "n": np.concatenate([rows, np.zeros(len(guests), np.int64)]),
            "ids": _lists(ids, np.concatenate([n_ids, np.zeros(len(guests), np.int64)])),
            "cosines": _lists(cos.astype(np.float32), per),
            "others": _lists(other, per),
        }
    )


def neighbours(df: DataFrame, id_col: str, vec_col: str, *, k: int = 10, dim: int = 64, shard_rows: int = 8192, sample_rows: int = 20_000, ef: int = 40, least_cosine: float = -1.0) -> DataFrame:
    """``id`` and ``near``, an array of (cosine, id) of the k most similar other rows, best first; equal cosines by id.

    Null, all-zero and wrongly sized vectors are left out. Rows of one vector are one point of the graph, so a vector in
    a third of all rows makes no large shard; they are each other's neighbours with cosine 1. ``sample_rows`` bounds the
    vectors that the centres are fitted on; every row is indexed, and every row's neighbours come from searching the
    graphs of its own shard and of those near it. Neighbours below ``least_cosine`` are left out. An empty table gives
    an empty result, repeated ids count as rows of their own.

    The vectors are shuffled once, to their shard and those they visit; what is shuffled after that are lists of k.
    """
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, vec_col, dim)
    total = rows.count()
    some = thinned(rows, F.col("id"), sample_rows, total).orderBy(F.xxhash64("id", F.lit(23)), "id").limit(sample_rows).select("v").toPandas()
    sample = np.unique(_unit(np.stack(some["v"].to_numpy()), dim), axis=0) if len(some) else np.zeros((0, dim), np.float32)
    router = fit_router(sample, total, k=k, shard_rows=shard_rows)
    shared = spark.sparkContext.broadcast(router)  # at most 1,024 centres and 2,500 residual ones

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k1, k2 = (b.column(c).to_numpy() for c in ("k1", "k2"))
            first, group = _groups(k1, k2)
            x = _unit(_matrix(b.column("v"), dim)[first], dim)
            ids, n_ids = _first_ids(group, b.column("id").to_numpy(), k + 1)
            starts = np.cumsum(n_ids) - n_ids
            row, shard, part, home = shared.value.visits(x, k1[first] & 0x7FFFFFFF)
            many = np.where(home, n_ids[row], 0)
            spread = np.repeat(starts[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.record_batch(
                {
                    "shard": shard.astype(np.int32),
                    "part": part.astype(np.int32),
                    "home": home,
                    "alone": (np.bincount(row, minlength=len(first)) == 1)[row],
                    "k1": k1[first][row],
                    "k2": k2[first][row],
                    "x": _lists(x[row].ravel(), np.full(len(row), dim)),
                    "ids": _lists(ids[spread], many),
                    "n": np.where(home, np.bincount(group)[row], 0),
                }
            )

    keyed = rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"))
    placed = keyed.mapInArrow(place, _PLACED)
    tasks = int(max(1, min(100_000, 2 * router.parts.sum())))  # by shard, so that small ones aren't put into one task
    made = placed.repartition(tasks, "shard", "part").groupBy("shard", "part").applyInArrow(lambda t: _answer(t, k, dim, ef, least_cosine), _ANSWERED)
    made = cut(made)
    lists = "array<struct<d:double,id:bigint>>"
    far = F.transform(F.arrays_zip("cosines", "others"), lambda z: F.struct((-z["cosines"]).cast("double").alias("d"), z["others"].alias("id"))).cast(lists)
    answered = made.select("k1", "k2", "alone", "n", "ids", far.alias("far"))
    several = answered.where("NOT alone").groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("far")).alias("far"))  # a list for each visit
    every = answered.where("alone").drop("alone").unionByName(several)
    copies = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id"))).cast(lists)
    every = every.select("k1", "k2", "n", F.get("ids", 0).alias("first"), F.slice(F.array_sort(F.concat(copies, "far")), 1, 2 * k + 2).alias("all"))
    mine = F.slice(F.filter("all", lambda z: z["id"] != F.col("id")), 1, k)
    single = every.where("n = 1").select(F.col("first").alias("id"), "all")
    repeated = keyed.select("id", "k1", "k2").join(every.where("n > 1").select("k1", "k2", "all"), ["k1", "k2"]).select("id", "all")
    return single.unionByName(repeated).select("id", F.transform(mine, lambda z: F.struct(F.round(-z["d"], 6).alias("cosine"), z["id"].alias("id"))).alias("near"))


def exact_tenth(df: DataFrame, id_col: str, vec_col: str, queries: Column, *, k: int = 10, dim: int = 64, block: int = 50_000) -> DataFrame:
    """For the rows that ``queries`` picks: ``id``, ``tenth`` (cosine of the exact k-th best other row) and ``n_exact`` (k, or
    fewer where there are fewer rows). A stated query set against all rows, in blocks of at most about ``block`` queries,
    which is what the driver holds at a time."""
    rows = usable_vectors(df, id_col, vec_col, dim)
    asked = rows.where(queries)
    blocks, out = max(1, -(-asked.count() // block)), None
    for i in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toPandas()
        x = _unit(np.stack(held["v"].to_numpy()), dim) if len(held) else np.zeros((0, dim), np.float32)
        shared = df.sparkSession.sparkContext.broadcast((held["id"].to_numpy(np.int64), x))

        def run(batches, shared=shared):
            ids, x = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                y, mine = _unit(_matrix(b.column("v"), dim), dim), b.column("id").to_numpy()
                for lo in range(0, len(x), 1024):
                    s = x[lo : lo + 1024] @ y.T
                    s[ids[lo : lo + 1024, None] == mine[None]] = -2
                    w = min(k, s.shape[1])
                    top = -np.sort(-np.partition(s, s.shape[1] - w, axis=1)[:, s.shape[1] - w :], axis=1)
                    yield pa.record_batch({"id": ids[lo : lo + 1024], "top": _lists(top[top > -2].astype(np.float64), (top > -2).sum(axis=1))})

        got = rows.mapInArrow(run, "id bigint, top array<double>")
        out = got if out is None else out.unionByName(got)
    best = out.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top"))
    return best.select("id", F.element_at("top", -1).alias("tenth"), F.size("top").alias("n_exact"))
