"""Passages of documents: overlapping windows that end with a sentence, and tables as one passage each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = r"\[PAGE_BREAK:(\d+)\]"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def page_starts(text: Column) -> Column:
    """Array of (offset, page) in the text without marks, in order: where each marked page starts."""
    pages = F.regexp_extract_all(text, F.lit(PAGE), F.lit(1))
    pieces = F.split(text, PAGE)
    lengths = F.transform(pieces, lambda z: F.length(z))
    return F.transform(pages, lambda p, i: F.struct(F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, x: a + x).alias("offset"), p.cast("int").alias("page")))


def page_at(starts: Column, offset: Column) -> Column:
    """The page that ``offset`` lies on: that of the last start at or before it, 1 before the first."""
    before = F.filter(starts, lambda s: s["offset"] <= offset)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["page"], F.lit(1))


def chunk_documents(docs: DataFrame, key_cols: list[str], text_col: str, *, size: int = 700, overlap: int = 100, reach: int = 150) -> DataFrame:
    """``key_cols``, ``chunk_index``, ``pos``, ``page``, ``content``.

    Windows of ``size`` start every ``size - overlap`` characters of the text without page marks. A window that doesn't end
    the text is extended to the first sentence end or blank line within ``reach`` characters. Windows are trimmed and
    blank ones dropped before they are numbered. A projection without shuffle; null and empty texts give no row.
    """
    step = size - overlap
    base = docs.select(*key_cols, page_starts(F.col(text_col)).alias("_pages"), F.regexp_replace(text_col, PAGE, "").alias("_t")).where(F.length("_t") > 0)

    def window(pos: Column) -> Column:
        tail = F.substring("_t", pos + size + 1, F.lit(reach))
        more = F.length(F.regexp_extract(tail, r"(?s)\A(.*?(?:[.!?](?:\s|\z)|\n\n))", 1))
        return F.struct(pos.alias("pos"), strip_ws(F.substring("_t", pos + 1, F.lit(size) + more)).alias("content"))

    starts = F.sequence(F.lit(0), F.length("_t") - 1, F.lit(step))
    parts = F.filter(F.transform(starts, window), lambda w: w["content"] != "")
    rows = base.select(*key_cols, "_pages", F.posexplode(parts).alias("chunk_index", "_w"))
    return rows.select(*key_cols, "chunk_index", F.col("_w.pos").alias("pos"), page_at(F.col("_pages"), F.col("_w.pos")).alias("page"), F.col("_w.content").alias("content"))


def table_text(tab: Column) -> Column:
    """A table as text: its name, the rows with cells parted by bars, and the units."""
    cells = F.transform(tab["rows"], lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | "))
    units = F.array_join(F.transform(F.map_entries(tab["units"]), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")
    lines = F.concat(F.array(F.concat(F.lit("[Table: "), F.coalesce(tab["name"], F.lit("")), F.lit("]"))), F.coalesce(cells, F.array().cast("array<string>")))
    return F.array_join(F.when(F.size(F.coalesce(tab["units"], F.create_map().cast("map<string,string>"))) > 0, F.concat(lines, F.array(F.concat(F.lit("Units: "), units)))).otherwise(lines), "\n")


def chunk_tables(docs: DataFrame, key_cols: list[str]) -> DataFrame:
    """One passage for every table: ``key_cols``, ``table_no``, ``table_name``, ``content``."""
    return docs.select(*key_cols, F.posexplode("tables").alias("table_no", "_t")).select(*key_cols, "table_no", F.col("_t.name").alias("table_name"), table_text(F.col("_t")).alias("content"))


def table_facts(docs: DataFrame, key_cols: list[str]) -> DataFrame:
    """Every non-blank cell beside a row label as a fact: ``key_cols``, ``sheet``, ``row_label``, ``col_label``, ``key``, ``value``, ``unit``.
    Values stay the strings they are."""
    tabs = docs.select(*key_cols, F.explode("tables").alias("_t")).where(F.size("_t.rows") > 1)
    rows = tabs.select(*key_cols, "_t", F.element_at("_t.rows", 1).alias("_h"), F.posexplode("_t.rows").alias("_r", "_c")).where("_r > 0")
    cells = rows.select(*key_cols, "_t", "_h", F.coalesce(F.get("_c", F.lit(0)), F.lit("")).alias("row_label"), F.posexplode("_c").alias("_j", "value")).where("_j > 0 AND value IS NOT NULL AND trim(value) <> ''")
    label = F.coalesce(F.get("_h", F.col("_j")), F.lit(""))
    return cells.select(*key_cols, F.col("_t.name").alias("sheet"), "row_label", label.alias("col_label"), F.concat("row_label", F.lit("::"), label).alias("key"), "value", F.try_element_at("_t.units", label).alias("unit"))
