"""Incremental ingest: new workbooks as a stream of cells, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import workbook as W

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_cells(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Cells of each workbook that arrives in ``folder``."""
    found = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return W.cells(found.where(F.lower("path").rlike(r"\.xls[xm]$")).select(F.col("path").alias("file"), "content"))


def event_windows(events: DataFrame, ts: str = "ts", keys: list[str] = ("event_type",), width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window; rows later than ``late`` are dropped with their state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
