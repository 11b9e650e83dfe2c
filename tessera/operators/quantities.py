"""Quantities recorded in different units: every number in its common unit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import CELL_PATTERN, header_unit, numbers_of, parse_unit, pick_number, remark_units

UNIT_TYPE = T.StructType(
    [T.StructField("quantity", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType()), T.StructField("common", T.BooleanType())]
)
_REMARK_TYPE = T.MapType(T.StringType(), UNIT_TYPE)


def _row(u):
    return None if u is None else (u.quantity, u.factor, u.offset, u.common)


def _frame(units) -> pd.DataFrame:
    return pd.DataFrame([_row(u) or (None,) * 4 for u in units], columns=["quantity", "factor", "offset", "common"])


@F.pandas_udf(UNIT_TYPE)
def unit_of(text: pd.Series, prior: pd.Series) -> pd.DataFrame:
    """The unit that a string stands for, all fields null if none; ``prior`` is the expected quantity or null."""
    return _frame(parse_unit(t, p) for t, p in zip(text, prior))


@F.pandas_udf(UNIT_TYPE)
def unit_of_header(text: pd.Series) -> pd.DataFrame:
    return _frame(header_unit(t) for t in text)


@F.pandas_udf(_REMARK_TYPE)
def units_of_remark(text: pd.Series) -> pd.Series:
    return pd.Series([{k: dict(zip(("quantity", "factor", "offset", "common"), _row(u))) for k, u in remark_units(t).items()} for t in text])


@F.pandas_udf(T.DoubleType())
def number_of(written: pd.Series, quantity: pd.Series, factor: pd.Series, offset: pd.Series) -> pd.Series:
    """The number a string stands for, decimal commas and thousands marks resolved by the quantity's usual values; without a
    quantity the likelier reading."""
    return pd.Series([None if w is None else numbers_of(w)[0] if q is None else pick_number(w, q, f, o) for w, q, f, o in zip(written, quantity, factor, offset)], dtype="float64")


def _given(unit: Column) -> Column:
    """Null instead of a unit without content."""
    return F.when(unit["quantity"].isNotNull(), unit)


def _common(quantity: Column) -> Column:
    return F.struct(quantity.alias("quantity"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("offset"), F.lit(True).alias("common"))


def convert_cells(df: DataFrame, key_cols: list[str], cell_col: str, *, fallbacks: list[Column], prior: Column | None = None) -> DataFrame:
    """Cells that hold a number, with the value in the common unit of its quantity.

    A cell is an optional qualifier, a number and an optional unit; anything else (words, blanks, dates) gives no
    row. The unit is the one in the cell, else the first of ``fallbacks`` (unit structs, null where they don't say).
    ``prior`` is the quantity the field holds, for units that can be read in two ways.

    Returns ``key_cols``, ``raw``, ``number``, ``value``, ``unit`` (common unit), ``quantity``, ``in_cell`` (whether
    the cell names the unit) and ``converted`` (whether the unit isn't the common one). A number without any unit has
    value = number and a null quantity. Null cells and empty tables give no rows, equal rows stay equal rows, and
    other columns are not returned.
    """
    prior = prior if prior is not None else F.lit(None).cast("string")
    got = (
        df.withColumns({"_num": F.regexp_extract(cell_col, CELL_PATTERN, 2), "_txt": F.regexp_extract(cell_col, CELL_PATTERN, 3), "_prior": prior})
        .where(F.col("_num") != "")
        .withColumn("_cell", F.when(F.col("_txt") != "", unit_of("_txt", "_prior")))
        .where((F.col("_txt") == "") | F.col("_cell.quantity").isNotNull())
        .withColumn("_unit", F.coalesce(_given(F.col("_cell")), *fallbacks))
    )
    quantity = F.col("_unit.quantity")
    got = got.withColumn("_n", number_of("_num", quantity, "_unit.factor", "_unit.offset"))
    n = F.col("_n")
    names = F.create_map(*[F.lit(x) for q in ("speed:rpm", "torque:Nm", "temperature:°C", "pressure:bar", "power:kW", "length:mm", "mass:kg") for x in q.split(":")])
    return got.select(
        *key_cols,
        F.col(cell_col).alias("raw"),
        n.alias("number"),
        F.when(quantity.isNull(), n).otherwise(n * F.col("_unit.factor") + F.col("_unit.offset")).alias("value"),
        F.element_at(names, quantity).alias("unit"),
        quantity.alias("quantity"),
        (F.col("_cell.quantity").isNotNull()).alias("in_cell"),
        (~F.coalesce(F.col("_unit.common"), F.lit(True))).alias("converted"),
    )


def _tables(parsed_docs: DataFrame) -> DataFrame:
    """One row per table: parsed_id, doc_id, version, t (index), tab."""
    return parsed_docs.select("parsed_id", "doc_id", "version", F.posexplode("tables").alias("t", "tab"))


def _header_units(tab: Column) -> Column:
    """Texts to look for a unit in, by column: (header, unit noted for it)."""
    notes = F.coalesce(tab["units"], F.create_map().cast("map<string,string>"))
    return F.transform(F.element_at(tab["rows"], 1), lambda h: F.struct(h.alias("header"), F.try_element_at(notes, F.coalesce(h, F.lit(""))).alias("note")))


def table_values(parsed_docs: DataFrame) -> DataFrame:
    """Every number in the tables of ``parsed_docs``: ``parsed_id``, ``t``, ``r`` (row, from 1), ``c`` (column) and what
    ``convert_cells`` returns. Units: the cell's, else the header's, else the one in ``units``. Tables without rows, null
    rows and rows shorter or longer than the header are fine: a column beyond the header has no header unit."""
    tabs = _tables(parsed_docs).where(F.size("tab.rows") > 1)
    heads = tabs.withColumn("h", _header_units(F.col("tab")))
    rows = heads.select("parsed_id", "t", "h", F.posexplode("tab.rows").alias("r", "cells")).where("r > 0")
    cells = rows.select("parsed_id", "t", "r", "h", F.posexplode("cells").alias("c", "cell")).where(F.col("cell").isNotNull())
    cells = cells.withColumn("_hd", F.try_element_at("h", F.col("c") + 1)).drop("h")
    none = F.lit(None).cast(UNIT_TYPE)
    cells = cells.withColumn("_head", F.when(F.col("_hd.header").isNotNull(), unit_of_header(F.col("_hd.header"))).otherwise(none))
    cells = cells.withColumn("_note", F.when(F.col("_hd.note").isNotNull(), unit_of(F.col("_hd.note"), F.lit(None).cast("string"))).otherwise(none))
    return convert_cells(cells, ["parsed_id", "t", "r", "c"], "cell", fallbacks=[_given(F.col("_head")), _given(F.col("_note"))], prior=F.coalesce("_head.quantity", "_note.quantity"))


FIELDS = (("value_rpm", "speed", 1), ("torque_nm", "torque", 2), ("temperature_deg_c", "temperature", 3))


def sheet_units(parsed_docs: DataFrame) -> DataFrame:
    """(doc_id, sheet) with the units of columns 1 to 3 of that table, from the newest version that has it."""
    tabs = _tables(parsed_docs).select("doc_id", F.col("tab.name").alias("sheet"), "version", "parsed_id", "t", _header_units(F.col("tab")).alias("h"))
    newest = tabs.where("doc_id IS NOT NULL AND sheet IS NOT NULL").groupBy("doc_id", "sheet").agg(F.max_by("h", F.struct(F.coalesce("version", F.lit(-1)), "parsed_id", -F.col("t"))).alias("h"))
    none = F.lit(None).cast(UNIT_TYPE)
    for field, quantity, k in FIELDS:
        newest = newest.withColumn("_x", F.try_element_at("h", F.lit(k + 1)))
        head = F.when(F.col("_x.header").isNotNull(), unit_of_header(F.col("_x.header"))).otherwise(none)
        note = F.when(F.col("_x.note").isNotNull(), unit_of(F.col("_x.note"), F.lit(quantity))).otherwise(none)
        newest = newest.withColumn("_hd", head).withColumn("_nt", note)
        fits = F.coalesce(F.when(F.col("_hd.quantity") == quantity, F.col("_hd")), F.when(F.col("_nt.quantity") == quantity, F.col("_nt")))
        newest = newest.withColumn(f"u_{field}", fits).drop("_hd", "_nt")
    return newest.select("doc_id", "sheet", *[f"u_{f}" for f, _, _ in FIELDS])


def sheet_values(readings: DataFrame, parsed_docs: DataFrame) -> DataFrame:
    """Every number in ``sheet_readings``: ``reading_id``, ``field_name`` and what ``convert_cells`` returns. Units: the
    cell's, else the remark's for that quantity, else the sheet's, else the column's own. Readings without a doc_id
    or with a sheet nobody knows have no sheet units; they take part in the join under a key of their own, so they
    don't gather in one task."""
    spread = F.coalesce(F.col("doc_id"), F.concat(F.lit("\u0000"), F.xxhash64("reading_id").cast("string")))
    base = readings.select("reading_id", spread.alias("doc_id"), "sheet", "remark", *[f for f, _, _ in FIELDS])
    base = base.join(sheet_units(parsed_docs), ["doc_id", "sheet"], "left")
    base = base.withColumn("_rem", F.when(F.col("remark").isNotNull(), units_of_remark("remark")))
    cells = base.select(
        "reading_id",
        "_rem",
        F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(q).alias("q"), F.col(f).alias("cell"), F.col(f"u_{f}").alias("su")) for f, q, _ in FIELDS])),
    ).where(F.col("cell").isNotNull())
    said = F.try_element_at("_rem", F.col("q"))
    return convert_cells(cells, ["reading_id", "field_name"], "cell", fallbacks=[said, F.col("su"), _common(F.col("q"))], prior=F.col("q"))
