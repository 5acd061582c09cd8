"""Deduplication, summaries, range joins and neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import overlaps

#: Rows of a sheet that share a bin in overlap joins.
BIN_ROWS = 4096


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Minima are pre-aggregated before the shuffle."""
    row = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in keys and c not in order])
    named = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(row).alias("first_row"))
    return picked.select(*keys, *[F.col(f"first_row.{c}").alias(c) for c in named])


def contained_points(points: DataFrame, boxes: DataFrame, sheet: str, at: str, lo: str, hi: str, box_sheet: str, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Points inside any interval of their sheet (semi-join), by equality on sheet and bin."""
    b = boxes.select(F.col(box_sheet).alias("box_sheet"), F.col(lo).alias("box_lo"), F.col(hi).alias("box_hi"), F.explode(F.sequence(F.floor(F.col(lo) / bin_rows), F.floor(F.col(hi) / bin_rows))).alias("box_bin"))
    cond = (F.col(sheet) == F.col("box_sheet")) & (F.floor(F.col(at) / bin_rows) == F.col("box_bin")) & F.col(at).between(F.col("box_lo"), F.col("box_hi"))
    return points.join(b, cond, "left_semi")


def overlapping(left: DataFrame, right: DataFrame, on: tuple[str, str], left_range: tuple[str, str], right_range: tuple[str, str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs on one sheet whose intervals overlap, each once: by equality on sheet and bin, and
    a pair counts in the bin where its overlap begins."""
    (a, z), (lo, hi) = left_range, right_range
    cut = lambda c: F.floor(F.col(c) / bin_rows)
    ls = left.withColumn("bin_l", F.explode(F.sequence(cut(a), cut(z))))
    rs = right.withColumn("bin_r", F.explode(F.sequence(cut(lo), cut(hi))))
    cond = (F.col(on[0]) == F.col(on[1])) & (F.col("bin_l") == F.col("bin_r")) & (F.col(a) <= F.col(hi)) & (F.col(lo) <= F.col(z))
    return ls.join(rs, cond).where(F.floor(F.greatest(a, lo) / bin_rows) == F.col("bin_l")).drop("bin_l", "bin_r")


def overlapping_boxes(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], boxes: tuple[str, str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs with equal keys whose rectangles (``struct(r1, c1, r2, c2)``) overlap, each once: by
    equality on the keys and a bin of rows; a pair counts in the bin where its overlap begins."""
    a, b = (F.col(c) for c in boxes)
    bins = lambda box: F.explode(F.sequence(F.floor(box["r1"] / bin_rows), F.floor(box["r2"] / bin_rows)))
    cond = (F.col("bin_l") == F.col("bin_r")) & overlaps(a, b) & (F.floor(F.greatest(a["r1"], b["r1"]) / bin_rows) == F.col("bin_l"))
    for x, y in keys:
        cond = cond & (F.col(x) == F.col(y))
    return left.withColumn("bin_l", bins(a)).join(right.withColumn("bin_r", bins(b)), cond).drop("bin_l", "bin_r")


def neighbourhood(grid: DataFrame, line: str, row: str, col: str, radius: int) -> DataFrame:
    """Pairs of cells of one sheet within ``radius`` rows and columns, by equality on row.

    Each cell is sent to the rows around it, so the join never meets a whole sheet."""
    other = grid.select(F.col(line).alias("n_line"), F.explode(F.sequence(F.col(row) - radius, F.col(row) + radius)).alias("n_at"), F.col(row).alias("n_row"), F.col(col).alias("n_col"))
    cond = (F.col(line) == F.col("n_line")) & (F.col(row) == F.col("n_at")) & (F.abs(F.col(col) - F.col("n_col")) <= radius)
    return grid.join(other, cond).drop("n_line", "n_at")


def priority_pick(df: DataFrame, keys: list[str], priority: Column, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(priority, *order)
    return df.withColumn("pick", F.row_number().over(w)).where("pick = 1").drop("pick")


def counts_by(df: DataFrame, *sets: list[str]) -> DataFrame:
    """Counts over several groupings in one pass; a column left out of a grouping is null."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count("*").alias("n"))
