"""Near-duplicate vectors: exact pairs above a cosine, greedy keeping, and merging of provenance.

Rows of one vector are one point, named by the smallest of their ids; pairs are between points, and ``members`` says which
rows a point stands for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists(v, lambda e: e != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0)).where(fine)
    return rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"))


def members(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``point``: the rows with a usable vector and the smallest id of those with the same vector."""
    rows = _usable(df, id_col, vec_col).select("id", "k1", "k2")
    return rows.join(rows.groupBy("k1", "k2").agg(F.min("id").alias("point")), ["k1", "k2"]).select("id", "point")


def _cells(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own cell of each row): a row is in the cell of its nearest centre and in every other that a row within
    ``reach`` of it may have as its own: those whose bisecting plane is no farther than that."""
    d = np.maximum(0, 1 + (c**2).sum(axis=1)[None] - 2 * (x @ c.T))
    own = d.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, ((c[:, None] - c[None]) ** 2).sum(axis=2))) if len(c) <= 64 else np.sqrt(np.maximum(0, (c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * c @ c.T))
    i, j = np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * reach * apart[own] + 1e-9)
    return i, j, own


def _close(y: np.ndarray, z: np.ndarray | None, least: float, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of the rows i of ``y`` and j of ``z``, or i < j of ``y`` alone, whose product is at least ``least``; rows have
    length one.

    The distance along some orthogonal axes is never above the whole one, so few axes, those of most variance, rule out nearly all
    pairs in single precision (with room for its error). What they leave is multiplied in full in double precision."""
    w = y if z is None else z
    if not len(y) or not len(w):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    some = np.concatenate([y[:: len(y) // 2000 + 1], w[:: len(w) // 2000 + 1]])
    mean = some.mean(axis=0)
    axes = np.linalg.eigh((some - mean).T @ (some - mean))[1][:, ::-1]
    width, most = y.shape[1], 2 - 2 * least
    for k in sorted({min(width, n) for n in (16, 32, width)}):
        p, q = (y - mean) @ axes[:, :k], (w - mean) @ axes[:, :k]
        near = most + 1e-4 + 2e-6 * k
        left = np.ascontiguousarray(np.column_stack([-2 * p, (p**2).sum(axis=1), np.ones(len(p))]), np.float32)
        right = np.ascontiguousarray(np.column_stack([q, np.ones(len(q)), (q**2).sum(axis=1)]).T, np.float32)
        if k == width or (left[:: len(left) // 500 + 1] @ right[:, :: len(w) // 2000 + 1] <= near).mean() <= 1e-3:
            break
    rows, columns = max(1, block // 8), block
    found = []
    for lo in range(0, len(y), rows):
        for at in range(0 if z is not None else lo // columns * columns, len(w), columns):
            hit = left[lo : lo + rows] @ right[:, at : at + columns] <= near
            some = np.flatnonzero(hit.ravel())
            if not len(some):
                continue
            if len(some) > hit.size // 50:  # many pairs: all products at once are cheaper, and no larger than a block
                s = y[lo : lo + rows] @ w[at : at + columns].T
                i, j = np.nonzero(s >= least - 1e-12)
                s = s[i, j]
            else:
                i, j = np.divmod(some, hit.shape[1])
                s = np.einsum("ij,ij->i", y[lo + i], w[at + j])
            ok = (s >= least - 1e-12) & ((lo + i < at + j) if z is None else True)
            found.append((i[ok] + lo, j[ok] + at, s[ok]))
    return tuple(np.concatenate(a) for a in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def close_pairs(x: np.ndarray, least: float, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of all rows i < j, of length one, whose product is at least ``least``."""
    return _close(x, None, least, block)


def _parting(x: np.ndarray, total: float, reach: float, most_cells: int, pair_s: float = 3e-9, row_s: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """(centres, rows expected in each cell) that make the comparison of ``total`` rows like ``x`` cheapest: centres of groups part rows only where groups are
    farther from each other than ``reach``; elsewhere more cells mean more rows in several of them."""
    rng = np.random.default_rng(3)
    some, best, worse, k = x[rng.permutation(len(x))[:4000]], None, 0, 1
    while k <= max(1, min(most_cells, len(some) // 8)) and worse < 4:
        costs = []
        for _ in range(1 if k == 1 else 4 if k < 100 else 1):
            c = some[rng.permutation(len(some))[:k]]
            for _ in range(8):
                own = (1 + (c**2).sum(axis=1)[None] - 2 * (some @ c.T)).argmin(axis=1)
                n = np.bincount(own, minlength=k)
                order = np.argsort(own, kind="stable")
                starts = np.concatenate([[0], n.cumsum()[:-1]])[n > 0]
                c = np.add.reduceat(some[order], starts) / n[n > 0][:, None]
                k_now = len(c)
                if k_now < k:
                    break
            expected = np.bincount(_cells(some, c, reach)[1], minlength=len(c)) * (total / len(some))
            costs.append((pair_s * (expected**2).sum() / 2 + row_s * expected.sum(), len(costs), c, expected))
        cost, _, c, expected = min(costs, key=lambda z: z[:2])
        best, worse = ((cost, c, expected), 0) if best is None or cost < best[0] else (best, worse + 1)
        k = k + 1 if k < 4 else -(-k * 5 // 4)
    return best[1], best[2]


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, *, least: float = 0.98, cell_rows: int = 4000, sample_rows: int = 20_000, most_cells: int = 4096) -> DataFrame:
    """All pairs (``a`` < ``b``) of points with a cosine of at least ``least``, with the cosine; exact.

    Vectors go to cells around centres of groups in a bounded sample, as many as make the comparison cheapest. A pair may fall into
    two cells, so each vector also goes to every earlier cell that a near one may have as its own. A cell of more than ``cell_rows`` rows
    (more in large tables) falls into parts at random, and each two of them are compared by a task. Null, all-zero and odd-sized
    vectors have no pairs; of vectors of several lengths each is compared with those of its own.
    """
    spark = df.sparkSession
    rows = _usable(df, id_col, vec_col)
    if dict(rows.dtypes)["v"] not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    number = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    total = rows.count()
    share = min(1.0, 2 * sample_rows / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()
    part_rows = max(cell_rows, min(10 * cell_rows, total // 24))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    plan: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(sample):
        for width, group in sample.groupby(sample["v"].map(len)):
            x = np.stack(group["v"].to_numpy()).astype(np.float64)
            x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
            centres, expected = _parting(x, total * len(x) / len(sample), reach, most_cells)
            plan[int(width)] = centres, np.maximum(1, np.ceil(expected / part_rows)).astype(np.int64)
    shared = spark.sparkContext.broadcast(plan)  # at most most_cells of each length
    tasks = max(1, min(4096, int(sum((n * (n + 1) // 2).sum() for _, n in plan.values()))))

    def place(batches):
        for b in batches:
            for width, g in b.groupby(b["v"].map(len)) if len(b) else ():
                x = np.stack(g["v"].to_numpy()).astype(number, copy=False)
                y = x.astype(np.float64)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                c, parts = shared.value.get(int(width)) or (np.zeros((1, int(width))), np.ones(1, np.int64))  # a length that the sample doesn't have: one cell
                i, cell, own = _cells(y, c, reach)
                i, cell = i[cell <= own[i]], cell[cell <= own[i]]  # a pair belongs to the earlier of its own cells
                ids, n = g["id"].to_numpy(), parts[cell]
                part = (((ids[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(i)), n)
                other = np.arange(len(at)) - np.repeat(n.cumsum() - n, n)
                i, cell, part = i[at], cell[at], part[at]
                sent = np.array([r.tobytes() for r in x] + [None], object)[:-1]
                yield pd.DataFrame({"width": np.int32(width), "cell": cell.astype(np.int32), "p": np.minimum(part, other).astype(np.int32), "q": np.maximum(part, other).astype(np.int32), "first": part <= other, "id": ids[i], "own": own[i].astype(np.int32), "x": sent[i]})

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        y = np.frombuffer(b"".join(b["x"]), number).reshape(len(b), -1).astype(np.float64)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        ids, own, one = b["id"].to_numpy(), (b["own"] == b["cell"]).to_numpy(), b["first"].to_numpy()
        if int(b["p"].iloc[0]) == int(b["q"].iloc[0]):
            i, j, s = _close(y, None, least, 2048)
        else:
            f, t = np.flatnonzero(one), np.flatnonzero(~one)
            i, j, s = _close(y[f], y[t], least, 2048)
            i, j = f[i], t[j]
        mine = own[i] | own[j]
        i, j = i[mine], j[mine]
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "cosine": s[mine]})

    points = rows.groupBy("k1", "k2").agg(F.min("id").cast("bigint").alias("id"), F.first("v").alias("v")).select("id", "v")
    placed = points.mapInPandas(place, "width int, cell int, p int, q int, first boolean, id bigint, own int, x binary")
    placed = placed.repartition(tasks, "width", "cell", "p", "q")
    pairs = placed.groupBy("width", "cell", "p", "q").applyInPandas(compare, "a bigint, b bigint, cosine double")
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


def _dropped(pairs: DataFrame) -> DataFrame:
    """``id`` of those that going through these pairs in order drops, by one task, which holds no more than these ids."""
    kind = dict(pairs.dtypes)["b"]

    def go(batches):
        dropped = set()
        for g in batches:
            new = []
            for a, b in zip(g["a"].tolist(), g["b"].tolist()):  # by b: whatever is said of an a has been said before
                if a not in dropped and b not in dropped:
                    dropped.add(b)
                    new.append(b)
            yield pd.DataFrame({"id": pd.Series(new, dtype=g["b"].dtype)})

    return pairs.repartition(1).sortWithinPartitions("b", "a").mapInPandas(go, f"id {kind}")


def greedy_keep(ids: DataFrame, pairs: DataFrame, membership: DataFrame | None = None, *, block_pairs: int = 1_000_000) -> DataFrame:
    """``id``, ``kept``, ``kept_as``: what going through the rows by id and dropping each that is similar to a kept one before
    leaves. ``kept_as`` is the first kept similar row of a dropped one. With ``membership`` (id, point), pairs are between points, and rows
    go with their point: a later copy is dropped for what its point is kept as.

    This is the lexicographically first independent set. Whether a row is kept depends on smaller ids only, so the pairs of the smallest
    ids, about ``block_pairs``, are gone through by one task. Pairs beyond those come in rounds: each takes such a block, and all rows
    beyond it without an undecided smaller partner, and what they drop leaves the pairs. So there are as many rounds as blocks at most,
    however long a chain of similar ids is."""
    pairs = cut(pairs.select("a", "b"))
    left, n, dropped = pairs, pairs.count(), []
    while n > block_pairs:
        upto = left.agg(F.percentile_approx("b", block_pairs / n).alias("b")).first()["b"]
        within = cut(_dropped(left.where(F.col("b") <= F.lit(upto))))
        open_ = within.union(left.where(F.col("b") > F.lit(upto)).select("b")).distinct()
        kept = left.select(F.col("a").alias("id")).distinct().join(open_, "id", "left_anti")
        gone = cut(within.union(left.join(kept.withColumnRenamed("id", "a"), "a").select("b")).distinct())
        dropped.append(gone)
        left = cut(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
        n = left.count()
    if n:
        dropped.append(cut(_dropped(left)))
    owner = pairs
    for gone in dropped:
        owner = owner.join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
    decided = owner.groupBy(F.col("b").alias("point")).agg(F.min("a").alias("kept_as"))
    rows = ids.select("id").distinct()
    rows = rows.join(membership.distinct(), "id", "left").select("id", F.coalesce("point", "id").alias("point")) if membership is not None else rows.select("id", F.col("id").alias("point"))
    got = rows.join(decided, "point", "left")
    return got.select("id", (F.col("kept_as").isNull() & (F.col("id") == F.col("point"))).alias("kept"), F.coalesce("kept_as", "point").alias("kept_as"))


def merge_refs(rows: DataFrame, keep: DataFrame, refs_col: str) -> DataFrame:
    """Kept rows with the distinct references of themselves and of those dropped for them, in order of the rows' ids. References are made
    distinct before they are gathered, so that many copies of one reference are one entry."""
    tagged = rows.join(keep.select("id", "kept_as"), "id").where(F.col(refs_col).isNotNull())
    each = tagged.select("kept_as", "id", F.posexplode(refs_col).alias("p", "r")).groupBy("kept_as", "r").agg(F.min(F.struct("id", "p")).alias("o"))
    some = each.groupBy(F.col("kept_as").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda z: z["r"]).alias(refs_col))
    none = tagged.groupBy(F.col("kept_as").alias("id")).agg(F.count("*").alias("_n")).select("id")
    return none.join(some, "id", "left").select("id", F.coalesce(refs_col, F.array().cast(rows.schema[refs_col].dataType)).alias(refs_col))
