"""Checks on statements: grounding of numbers in their sources, and numbers that sources disagree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..session import spread

#: numbers that a statement must have from its sources: of three digits, or with a fraction
NUMBERS = r"\d{3,}(?:[.,]\d+)?|\d+[.,]\d+"
_UNITS = sorted(vocab.UNIT_RANGES, key=len, reverse=True)
#: number, unit; a unit ends where no letter or digit follows
MEASURE = r"(\d+(?:[.,]\d+)?)\s*(" + "|".join(_UNITS) + r")(?![\p{L}\d])"


#: units whose numbers make a statement worth checking
CHECKED_UNITS = ["rpm", "nm", "bar", "°c", "psi", "mm", "kg"]
_CHECKED = r"(?i)\d\s*(?:" + "|".join(CHECKED_UNITS) + r")(?![\p{L}\p{N}_])"


def worth_checking(draft: Column) -> Column:
    """Whether a draft has a number with a unit, so that its grounding matters."""
    return F.coalesce(draft, F.lit("")).rlike(_CHECKED)


def grounded(draft: Column, sources: Column) -> Column:
    """Whether every number of three digits or with a fraction stands in the sources. Empty drafts aren't grounded, drafts
    without such numbers are."""
    numbers = F.regexp_extract_all(draft, F.lit(NUMBERS), F.lit(0))
    return F.when(F.trim(F.coalesce(draft, F.lit(""))) == "", F.lit(False)).otherwise(F.forall(numbers, lambda n: F.contains(F.coalesce(sources, F.lit("")), n)))


def grounded_in(drafts: DataFrame, sources: DataFrame, *, key: str, doc: str, draft_col: str, text_col: str, salt: int = 16) -> DataFrame:
    """``key``, ``grounded``: whether every number of a draft stands in some text of its document (see ``grounded``).

    The distinct numbers asked of a document go to its texts in ``salt`` parts, and what was found comes back by number, so that
    a document with many drafts copies its texts ``salt`` times and not once a draft."""
    d = drafts.select(key, doc, F.col(draft_col).alias("_d"), F.array_distinct(F.regexp_extract_all(draft_col, F.lit(NUMBERS), F.lit(0))).alias("_n"))
    asked = d.select(doc, F.explode("_n").alias("n")).where(F.col(doc).isNotNull()).distinct()
    parts = asked.groupBy(doc, F.pmod(F.xxhash64("n"), F.lit(salt)).alias("_p")).agg(F.collect_list("n").alias("ns"))  # one document's numbers, in parts
    found = sources.select(doc, F.col(text_col).alias("_t")).where("_t IS NOT NULL").join(parts, doc).select(doc, F.explode(F.filter("ns", lambda n: F.contains("_t", n))).alias("n")).distinct()
    missing = d.select(key, doc, F.explode("_n").alias("n")).join(found, [doc, "n"], "left_anti").select(key).distinct().withColumn("_missing", F.lit(True))
    return d.join(missing, key, "left").select(key, (F.col("_missing").isNull() & (F.trim(F.coalesce("_d", F.lit(""))) != "")).alias("grounded"))


def measures(passages: DataFrame, key_cols: list[str], text_col: str, *, ranges: dict = vocab.UNIT_RANGES, context: list[str] = vocab.SPEC_CONTEXT, around: int = 80) -> DataFrame:
    """``key_cols``, ``pos``, ``number`` (as written), ``value``, ``unit``: plausible numbers with a unit that have a word of ``context``
    within ``around`` characters. One pass of the pattern cuts a text into pieces that end with a number and its unit; only their short
    surroundings leave it."""
    text = F.col(text_col)
    base = spread(passages.select(*key_cols, text_col)).where(text.rlike(r"\d\s*(?:" + "|".join(_UNITS) + ")")).select(*key_cols, text.alias("_t"), F.regexp_extract_all(text, F.lit(r"(?s)\G.*?" + MEASURE), F.lit(0)).alias("_p"))
    rows = base.select(*key_cols, "_t", F.posexplode_outer(F.transform("_p", lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice("_p", 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)).alias("end")))).alias("_i", "_z"))
    rows = rows.withColumn("_m", F.regexp_extract("_z.p", r"(?s)" + MEASURE + r"$", 0)).withColumn("pos", F.col("_z.end") - F.length("_m"))
    near = F.lower(F.substr(F.col("_t"), F.greatest(F.col("pos") + 1 - around, F.lit(1)), F.least(F.col("pos"), F.lit(around)) + F.length("_m") + around))
    rows = rows.select(*key_cols, "pos", F.regexp_extract("_m", MEASURE, 1).alias("number"), F.regexp_extract("_m", MEASURE, 2).alias("unit"), near.rlike("|".join(context)).alias("_near")).where("_near")
    rows = rows.withColumn("value", F.regexp_replace("number", ",", ".").cast("double"))
    plausible = F.lit(False)
    for u, (lo, hi) in ranges.items():
        plausible = plausible | ((F.col("unit") == u) & F.col("value").between(lo, hi))
    return rows.where(plausible).select(*key_cols, "pos", "number", "value", "unit")


def conflicts(found: DataFrame, *, group: str, source: str, order: list[str], per_source: int = 2, least_spread: float = 5, least_share: float = 0.03) -> DataFrame:
    """``group``, ``unit``, ``n_sources``, ``n_values``, ``low``, ``high``, ``spread``: units in which two sources or more give different
    numbers, by the first ``per_source`` numbers of each source."""
    u = found.withColumn("unit", F.lower("unit"))
    first = u.withColumn("_r", F.row_number().over(Window.partitionBy(group, "unit", source).orderBy(*order))).where(F.col("_r") <= per_source)
    got = first.groupBy(group, "unit").agg(F.count_distinct(source).alias("n_sources"), F.count_distinct("number").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"))
    got = got.withColumn("spread", F.round(F.col("high") - F.col("low"), 6))
    return got.where((F.col("n_sources") >= 2) & (F.col("n_values") > 1) & ((F.col("spread") >= least_spread) | (F.col("spread") / F.col("high") > least_share)))


def conflicting_keys(facts: DataFrame, key: str, value: str) -> DataFrame:
    """All facts whose key has more than one value."""
    many = facts.groupBy(key).agg((F.min(value) != F.max(value)).alias("_c")).where("_c").select(key)
    return facts.join(many, key, "left_semi")


def first_conflicts(found: DataFrame, *, group: str, first_seen: DataFrame, most: int = 3) -> DataFrame:
    """Of each group's conflicts (see ``conflicts``) the ``most`` whose unit its passages name first (``first_seen``: ``group``, unit, seen)."""
    w = Window.partitionBy(group).orderBy("seen", "unit")
    return found.join(first_seen, [group, "unit"]).withColumn("no", F.row_number().over(w)).where(F.col("no") <= most).drop("seen")


def page_confidence(words: DataFrame, *, page: list[str], conf: str, least: float = 60.0) -> DataFrame:
    """``page``, ``mean``, ``low``: mean confidence of the words of a page, without negative ones, 100 if there are none; whether it is under ``least``."""
    mean = F.coalesce(F.avg(F.when(F.col(conf) >= 0, F.col(conf))), F.lit(100.0))
    return words.groupBy(*page).agg(mean.alias("mean")).withColumn("low", F.col("mean") < least)
