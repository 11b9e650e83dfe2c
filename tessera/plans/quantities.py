"""Queries on quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quantities as op
from ..session import table


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of sheet_readings and of the tables in parsed_docs, in rpm, Nm, °C, bar, kW, mm and kg."""
    docs = table(spark, d, "parsed_docs")
    sheet = op.sheet_values(table(spark, d, "sheet_readings"), docs)
    tabs = op.table_values(docs)
    place = F.concat(F.lit("t"), F.col("t").cast("string"), F.lit("c"), F.col("c").cast("string"))
    keep = ["raw", "number", "value", "unit", "quantity", "in_cell", "converted"]
    return sheet.select(F.lit("sheet_readings").alias("source_table"), F.col("reading_id").alias("row_id"), "field_name", F.lit(0).alias("cell_row"), *keep).unionByName(
        tabs.select(F.lit("parsed_docs").alias("source_table"), F.col("parsed_id").alias("row_id"), place.alias("field_name"), F.col("r").alias("cell_row"), *keep)
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_values(spark, d).where("converted").select("source_table", "row_id", "field_name").distinct()


def queries() -> dict:
    return {"p5_found": p5_found, "p5_values": p5_values}


def oracle_sql() -> dict[str, str]:
    return {}
