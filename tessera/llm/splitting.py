"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PAGE_MARK


def _boundary_pattern(most: int) -> str:
    """Alternatives by strength: all the rest, up to the last paragraph end within ``most`` characters, wherever it is, else to
    the last sentence end, else to the last word end, else ``most`` characters of a word that is longer. The blank line
    between paragraphs may hold up to five blanks."""
    return (
        rf"(?s)(?:.{{1,{most}}}\z"
        rf"|.{{0,{most - 9}}}\S[ \t\r]?\n[ \t\r]{{0,5}}\n"
        rf"|.{{1,{most - 1}}}(?<=[.!?…][)\]»”“\"’']{{0,3}})\s"
        rf"|.{{0,{most - 2}}}\S\s"
        rf"|.{{1,{most}}})"
    )


def split_items(
    df: DataFrame,
    key_cols: list[str],
    text_col: str,
    *,
    limit: int = 850,
    overlap: int = 100,
    whole_when: Column | None = None,
    drop_pattern: str = PAGE_MARK,
) -> DataFrame:
    """Cut texts longer than ``limit`` characters (code points) into pieces of at most ``limit``.

    Bounded-quantifier regular expressions consume up to ``limit`` characters for the first piece and up to ``limit -
    overlap`` for each later one, ending at the last paragraph end within these, else at the last sentence end, else at
    the last word end, else (a longer word) anywhere; each piece but the first is led by about ``overlap``
    characters of the one before, from a word start where there is one. ``drop_pattern`` is taken out first.
    Everything is one projection of built-in functions: no shuffle and no Python.

    Returns ``key_cols``, ``piece_no`` (from 0), ``n_pieces``, ``start`` (offset of the piece in the text without
    marks), ``repeated`` (characters that stand in the piece before) and ``piece``. Texts within the limit, and rows
    where ``whole_when`` holds, come out as one piece. Null or empty texts give no row. Rows that are equal are kept
    apart only by their keys. Other columns are not returned, so their names can't clash.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half of limit")
    step = limit - overlap
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)]
    kept_whole = F.lit(False) if whole_when is None else F.coalesce(whole_when, F.lit(False))
    base = df.select(*keys, F.regexp_replace(F.col(text_col), drop_pattern, "").alias("_t"), kept_whole.alias("_w"))
    whole = (F.length("_t") <= limit) | F.col("_w")
    first = F.regexp_extract("_t", r"\A" + _boundary_pattern(limit), 0)
    parts = F.when(whole, F.array("_t")).otherwise(F.concat(F.array("_f"), F.regexp_extract_all(F.substr("_t", F.length("_f") + 1), F.lit(_boundary_pattern(step)), F.lit(0))))
    ends = F.aggregate(
        "_p",
        F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))).otherwise(F.lit(0)) + F.length(p))),
    )

    def tail(p: Column) -> Column:
        """What the next piece repeats: the end of this part, from its first word start."""
        raw = F.right(p, F.lit(overlap))
        cut = F.regexp_replace(raw, r"(?s)\A\S*\s+(?=\S)", "")
        return F.when(F.length(p) <= overlap, p).when(F.length(cut) >= overlap // 2, cut).otherwise(raw)

    cutting = base.where(F.length("_t") > 0).withColumn("_f", F.when(~whole, first)).withColumn("_p", parts).withColumn("_e", ends)
    rows = cutting.select(
        *[f"_k{i}" for i in range(len(key_cols))],
        F.size("_p").alias("_n"),
        F.posexplode(F.arrays_zip(F.col("_p").alias("p"), F.col("_e").alias("e"), F.concat(F.array(F.lit("")), F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0)))).alias("b"))).alias("_i", "_z"),
    )
    rep = F.when(F.col("_i") == 0, F.lit("")).otherwise(tail(F.col("_z.b"))) if overlap else F.lit("")
    rows = rows.withColumn("_r", rep)
    return rows.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(key_cols)],
        F.col("_i").alias("piece_no"),
        F.col("_n").alias("n_pieces"),
        (F.col("_z.e") - F.length("_z.p") - F.length("_r")).alias("start"),
        F.length("_r").alias("repeated"),
        F.concat("_r", "_z.p").alias("piece"),
    )
