"""Helpers shared by the text-corpus operators: tables, checkpoints, hashed folds."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, ``spark.checkpoint.dir``. Where it is unset a folder
    of this machine will do only if all of Spark runs in one process; elsewhere that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridweave-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy() -> None:
    """Gives freed memory back to the system, so that an idle worker does not hold on to the peak of
    its last block or bucket. Without effect where the C library has no such call."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function over batches that ends with ``tidy``."""

    def inner(batches):
        yield from run(batches)
        tidy()

    return inner


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as crc 0."""
    crc = F.crc32(id_col.cast("string").cast("binary"))
    return F.coalesce(crc, F.lit(0)) % F.lit(modulus)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def thinned(df: DataFrame, id_col: str, bound: int, rows: int, seed: int = 0) -> DataFrame:
    """About twice ``bound`` of ``rows`` rows by hashed id, so that a later limit moves little."""
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(unit < F.lit(min(1.0, 2.0 * bound / max(rows, 1))))


def hashed_sample(df: DataFrame, id_col: str, bound: int, seed: int = 0) -> DataFrame:
    """At most ``bound`` rows: those whose hashed id is smallest. Each task keeps its own
    ``bound`` smallest before anything moves; wide rows should be ``thinned`` first."""
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    return df.orderBy(order, F.col(id_col)).limit(bound)
