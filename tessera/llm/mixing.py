"""Drawing records from several sources to target shares of the total size.

The records of each source fall into blocks by a hash. Which blocks are drawn, and how often, is decided from the
blocks' sizes; a splitting tree then deals them to the output shards: at each node a multivariate hypergeometric draw
parts the exact quotas of blocks by source between both halves. A shard takes its own permuted blocks and shuffles
their records. The numbers of shards and blocks follow the total, and no list of blocks ever comes to the driver: a
block's place among its source's permuted blocks is computed, and the tree's leaves say which shard has that place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def source_name(col):
    """Spellings of a source in one form: lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_")


@dataclass
class Target:
    source: str
    share: float
    max_repeats: int


@dataclass
class Draw:
    """Of one source: ``full`` copies of all blocks, one more of the first ``extra`` in permuted order, and of the block after
    these the records up to ``rest``."""

    full: int
    extra: int = 0
    rest: float = 0.0


def plan_total(sizes: dict[str, float], targets: list[Target], total: float | None) -> tuple[dict[str, tuple[int, float]], float]:
    """Per source (full copies, size still wanted), and the total. By default the total is the largest at which every source
    that has records keeps its share among them; a given total may make small sources fall short, as no record is used
    more than ``max_repeats`` times."""
    have = {t.source: t for t in targets if t.share > 0 and t.max_repeats > 0 and sizes.get(t.source, 0) > 0}
    if not have:
        return {}, 0.0
    present = sum(t.share for t in have.values())
    if total is None:
        total = min(t.max_repeats * sizes[s] / (t.share / present) for s, t in have.items())
    out = {}
    for s, t in have.items():
        quota = min(total * t.share / present, t.max_repeats * sizes[s])
        full = min(int(quota / sizes[s] + 1e-9), t.max_repeats)
        out[s] = (full, quota - full * sizes[s] if full < t.max_repeats else 0.0)
    return out, float(total)


def _until(sums: dict[int, float], count: int, wanted: float) -> tuple[int, float]:
    """How many of the parts 0 to ``count`` - 1 fit into ``wanted``, and what is left of it."""
    for i in range(count):
        if sums.get(i, 0.0) > wanted + 1e-9:
            return i, wanted
        wanted -= sums.get(i, 0.0)
    return count, wanted


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): the splitting tree's leaves. Rows differ by one block at most in sum; columns sum to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64), 1)]
    while todo:
        lo, hi, m, node = todo.pop()
        if hi - lo == 1:
            out[lo] = m
            continue
        half = (hi - lo) // 2
        n = int(m.sum() * half // (hi - lo))
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(m, n, method="marginals") if m.sum() else m
        todo += [(lo, lo + half, left, 2 * node), (lo + half, hi, m - left, 2 * node + 1)]
    return out


def _coprime(n: int, start: int) -> int:
    a = start % max(n, 1) or 1
    while math.gcd(a, n) != 1:
        a += 1
    return a


def mix(records: DataFrame, targets: DataFrame, *, key_col: str, source_col: str, size_col: str, total: float | None = None, shards: int | None = None, blocks: int | None = None, most_targets: int = 10_000, seed: int = 41) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). ``drawn``: ``shard``, ``position``, ``key_col``, ``source``, ``copy_no`` (from 0), ``size``. ``shares``: per source
    ``target_share``, ``max_repeats``, ``available``, ``drawn``, ``actual_share``, ``n_records``, ``most_copies``.

    Records whose source is null or not a target are not drawn, nor are those of size 0 or null; shares reports them
    with a null target. A target without records gets nothing, and the others keep their shares among themselves.
    By default the shards number the square root of the total over 4,096, so that both their number and their size grow
    with it, and each source has at least eight blocks a shard. To the driver come one size a target and two times the
    square root of the number of blocks of each. More than ``most_targets`` targets raise an error. Repeated rows of one
    key count as records of their own; an empty table gives an empty draw.
    """
    spark = records.sparkSession
    wanted = [Target(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(most_targets + 1).collect()]
    if len(wanted) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    names = [t.source for t in wanted]
    base = cut(records.select(F.col(key_col).alias("_key"), source_name(F.col(source_col)).alias("source"), F.col(size_col).cast("bigint").alias("size")))
    usable = base.where((F.col("size") > 0) & F.col("source").isin(*names)) if names else base.where("false")
    sizes = {r["source"]: float(r["n"]) for r in usable.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row a target
    todo, all_drawn = plan_total(sizes, wanted, total)
    shards = shards or max(1, math.isqrt(int(all_drawn) // 4096))
    bits = max(10, (8 * shards - 1).bit_length()) if blocks is None else max(1, (blocks - 1).bit_length())
    blocks, group = 1 << bits, 1 << (bits // 2)
    rng = np.random.default_rng([seed, 3])
    turn, shift = int(rng.integers(0, blocks)) | 1, int(rng.integers(0, blocks))
    block = F.xxhash64("_key", F.lit(seed)).bitwiseAND(blocks - 1)
    usable = usable.withColumn("block", ((block * turn + shift) % blocks).cast("bigint"))  # blocks in permuted order
    sums = usable.groupBy("source", F.expr(f"block div {group}").alias("g")).agg(F.sum("size").alias("n")).collect()  # square root of blocks, a target
    by_group: dict[str, dict[int, float]] = {}
    for r in sums:
        by_group.setdefault(r["source"], {})[r["g"]] = float(r["n"])
    reached = {s: _until(by_group[s], blocks // group, rest) for s, (_, rest) in todo.items()}
    open_groups = spark.createDataFrame([(s, g) for s, (g, _) in reached.items()] or [("", -1)], "source string, g bigint")
    inner = usable.withColumn("g", F.expr(f"block div {group}")).join(F.broadcast(open_groups), ["source", "g"]).groupBy("source", "block").agg(F.sum("size").alias("n")).collect()  # as many
    by_block: dict[str, dict[int, float]] = {}
    for r in inner:
        by_block.setdefault(r["source"], {})[r["block"] % group] = float(r["n"])
    draws: dict[str, Draw] = {}
    for s, (g, rest) in reached.items():
        i, rest = _until(by_block.get(s, {}), group, rest) if g * group < blocks else (0, 0.0)
        draws[s] = Draw(todo[s][0], g * group + i, rest)
    order = sorted(draws)
    quotas = np.array([draws[s].full * blocks + draws[s].extra + (draws[s].rest > 1e-6) for s in order], np.int64)
    leaves = split_quotas(quotas, shards, seed) if order else np.zeros((1, 0), np.int64)
    ends = spark.sparkContext.broadcast(np.cumsum(leaves, axis=0))  # shards x targets numbers
    plan = []
    for i, s in enumerate(order):
        q, d = int(quotas[i]), draws[s]
        plan.append((s, i, d.full, d.extra, d.rest, q, _coprime(q, int(rng.integers(1, 1 << 30))), int(rng.integers(0, max(q, 1)))))
    plan_df = spark.createDataFrame(plan, "source string, _s int, _full int, _extra bigint, _rest double, _q bigint, _a bigint, _d bigint")  # one row a target

    @F.pandas_udf("int")
    def shard_of(s: pd.Series, place: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int32)
        for i in s.unique():
            at = (s == i).to_numpy()
            out[at] = np.searchsorted(ends.value[:, i], place[at].to_numpy(), side="right")
        return pd.Series(out)

    more = F.col("block") < F.col("_extra")
    last = (F.col("block") == F.col("_extra")) & (F.col("_rest") > 1e-6)
    copies = F.sequence(F.lit(0), F.col("_full") - F.when(more | last, 0).otherwise(1))
    got = usable.join(F.broadcast(plan_df), "source").where((F.col("_full") > 0) | more | last).select("*", F.explode(copies).alias("copy_no"))
    # the one block of each source that is drawn in part: records in hashed order up to the limit
    in_part = last & (F.col("copy_no") == F.col("_full"))
    within = Window.partitionBy("source").orderBy(F.xxhash64("_key", F.lit(seed + 1)), "_key")
    partly = got.where(in_part).withColumn("_c", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_c") - F.col("size") / 2 <= F.col("_rest")).drop("_c")
    drawn = got.where(~in_part).unionByName(partly)
    place = (F.col("_a") * (F.col("copy_no") * blocks + F.col("block")) + F.col("_d")) % F.col("_q")
    dealt = drawn.select(shard_of("_s", place).alias("shard"), "_key", "source", "copy_no", "size")
    turn_in = Window.partitionBy("shard").orderBy(F.xxhash64("_key", "copy_no", F.lit(seed + 2)), "_key", "copy_no")
    result = dealt.select("shard", F.row_number().over(turn_in).alias("position"), F.col("_key").alias(key_col), "source", "copy_no", "size")
    per = drawn.groupBy("source").agg(F.sum("size").alias("drawn"), F.count("*").alias("n_records"), (F.max("copy_no") + 1).alias("most_copies"))
    stock = base.groupBy("source").agg(F.sum("size").alias("available"))
    listed = spark.createDataFrame([(t.source, t.share, t.max_repeats) for t in wanted], "source string, target_share double, max_repeats int")
    joined = stock.withColumn("source", F.coalesce("source", F.lit("(none)"))).join(listed, "source", "full").join(per, "source", "left")
    whole = per.agg(F.sum("drawn").alias("_all"))
    shares = joined.crossJoin(F.broadcast(whole)).select(  # one row
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.round(F.coalesce(F.col("drawn") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return result, shares
