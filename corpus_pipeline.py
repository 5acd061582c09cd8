"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Defined results: null and empty texts, null ids and very long texts go through every stage (a
repeated row counts as a near copy; a null id is never one); other columns are kept as they are,
whatever their names, but ``n_chars`` follows the text and ``token_ids`` comes last; without labels
nothing is toxic and every rate is 1; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, jaccard, mixing, suffix, toxicity
from gridweave.llm.common import fold, shared_folder, table
from gridweave.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is one half or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; null ids stay."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out."""
    return suffix.remove_repeats(docs, n_chars_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the rates that meet the target weights say."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and their token ids."""
    return bpe.encode_into(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("bpe_encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again, and
    goes when the next one's has been written. The last one stays for the caller to read."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before:
            drop(spark, before)
        before = f"{folder}/{k}-{name}"
    return docs


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark writes to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Trained models and suffix arrays have no counterpart in SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None
