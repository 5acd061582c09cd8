"""Read tools over the cells relation: neighbourhood, summary, headers, sheets, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import workbook as W


def neighbourhood(cells: DataFrame, sheet: str, ref: str, radius: int = 3) -> DataFrame:
    row, col = W.split_ref(ref)
    return cells.where((F.col("sheet") == sheet) & F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius))


def sheet_summary(cells: DataFrame, sheet: str, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(extent and counts, the cells of the header row and the first ``rows`` below it)."""
    s = cells.where(F.col("sheet") == sheet)
    size = s.agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), F.count("*").alias("n_cells"), F.count_if("has_formula").alias("n_formulas"))
    return size, s.where(F.col("row") <= rows + 1).orderBy("row", "col")


def headers(cells: DataFrame, sheet: str, start_col: str, end_col: str) -> DataFrame:
    """The header of each column of a range, null where there is none."""
    a, z = W.column_number(start_col), W.column_number(end_col)
    wanted = cells.sparkSession.range(a, z + 1).select(F.col("id").cast("int").alias("want"))
    text = cells.where((F.col("sheet") == sheet) & (F.col("row") == 1)).select("col", F.coalesce("text_value", F.col("num_value").cast("string")).alias("header"))
    return wanted.join(text, F.col("want") == F.col("col"), "left").select(F.col("want").alias("col"), "header").orderBy("col")


def list_sheets(books: DataFrame) -> DataFrame:
    """(file, sheet_idx, sheet) in workbook order."""
    return W.sheets(books).select("file", "sheet_idx", "sheet").orderBy("file", "sheet_idx")


def named_ranges(books: DataFrame) -> DataFrame:
    """(file, name, value, scope, hidden): all defined names, those of one sheet with that sheet."""
    return W.names(books).select("file", "name", "value", "scope", "hidden")
