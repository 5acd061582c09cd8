"""URL filter: host and path rules, then a blocked Bloom filter before an exact hash join.

Input: a table with an id and a url column, and a table of listed canonical URLs. Output: one
row per input row, repeated rows included.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is
judged as the empty canonical URL; a null id is passed through; empty tables give empty or
all-allowed results; extra columns are ignored; very long urls are ordinary rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path) in any order; the longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS_PER_URL, WORDS, BLOCK_BITS, SHARD_BLOCKS = 16, 4, 256, 1024
#: A side is broadcast only when its measured size is under this many bytes.
BROADCAST_BYTES = 8 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without trailing slashes; scheme, query and
    fragment are gone already."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that fits best and its verdict, both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(act)).otherwise(verdict)
    return name, verdict


def _bloom_keys(c: Column, blocks: int) -> dict[str, Column]:
    second = F.xxhash64(c, F.lit(1))
    bit = lambda k: F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    return {"bf_block": F.pmod(F.xxhash64(c), F.lit(blocks))} | {f"bf_{k}": F.call_function("shiftleft", F.lit(1).cast("long"), bit(k)) for k in range(WORDS)}


def build_filter(listed: DataFrame, url_col: str, n_listed: int) -> tuple[DataFrame, int]:
    """(shard, words): the filter's blocks of 256 bits, as four longs each, in order, the blocks of
    a shard as one array. Each URL sets one bit in each long of one block."""
    blocks = max(1, -(-n_listed * BITS_PER_URL // BLOCK_BITS))
    keyed = listed.select(*[v.alias(k) for k, v in _bloom_keys(F.col(url_col), blocks).items()])
    made = keyed.groupBy("bf_block").agg(*[F.bit_or(f"bf_{k}").alias(f"filter_{k}") for k in range(WORDS)])
    place = (F.col("bf_block") % SHARD_BLOCKS).cast("int")
    entry = F.struct(place.alias("place"), F.array(*[f"filter_{k}" for k in range(WORDS)]).alias("w"))
    shards = made.groupBy(F.floor(F.col("bf_block") / SHARD_BLOCKS).alias("shard")).agg(F.map_from_entries(F.collect_list(entry)).alias("at"))
    nothing = F.array(*[F.lit(0).cast("long")] * WORDS)
    words = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SHARD_BLOCKS - 1)), lambda i: F.coalesce(F.try_element_at("at", i), nothing)))
    return shards.select("shard", words.alias("words")), blocks


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "canonical", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, maybe_listed, listed.

    The filter is packed into shards, which are broadcast only if all of them, counted before, are
    under ``BROADCAST_BYTES``; beyond it pages meet their shard by a shuffle. Only rows that pass
    the filter are joined with the list, by a shuffle of both; the others do not move.
    """
    listed = listed.select(F.col(listed_col).alias("listed_url")).where("listed_url IS NOT NULL").distinct()
    n_listed = listed.count()
    shards, blocks = build_filter(listed, "listed_url", n_listed)
    if 8 * WORDS * SHARD_BLOCKS * -(-blocks // SHARD_BLOCKS) < BROADCAST_BYTES:
        shards = F.broadcast(shards)
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rule, act = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), act.alias("rule_verdict"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    rows = rows.withColumns(_bloom_keys(F.col("canonical"), blocks)).withColumn("bf_shard", F.floor(F.col("bf_block") / SHARD_BLOCKS))
    rows = rows.join(shards, F.col("bf_shard") == F.col("shard"), "left")
    first = (F.col("bf_block") % SHARD_BLOCKS * WORDS).cast("int")
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.get("words", first + k).bitwiseAND(F.col(f"bf_{k}")) != 0)
    rows = rows.select(id_col, "host", "path", "rule", "rule_verdict", "canonical", F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
    misses = rows.where("NOT maybe_listed").withColumn("listed", F.lit(False))
    # Spark knows no size of a list made by rule and might send it to all; so the way is named.
    exact = listed.withColumn("found", F.lit(True)).hint("merge")
    hits = rows.where("maybe_listed").join(exact, F.col("canonical") == F.col("listed_url"), "left")
    hits = hits.withColumn("listed", F.coalesce("found", F.lit(False))).drop("found", "listed_url")
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return misses.unionByName(hits).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "maybe_listed", "listed")


# The parts of the listed addresses of the registered query.
LISTED_LABELS = ("casino-win", "cheap-pills", "free-bets", "adult-x", "ads-track")
LISTED_PREFIXES, LISTED_ENDS, LISTED_TONGUES = ("", "blog.", "m."), ("com", "net", "org"), ("en", "de", "fr", "es")
#: Every ``LISTED_STEP``-th number under ``LISTED_NUMBERS`` from ``LISTED_FIRST`` on is listed; its
#: neighbours on the same hosts are near misses.
LISTED_NUMBERS, LISTED_STEP, LISTED_FIRST = 60_000, 6, 1


def listed_urls(spark: SparkSession) -> DataFrame:
    """The canonical URLs of the registered query's list: 1,800,000 pages of unwanted hosts, made by
    rule from the fixed parts, independently of any table of pages."""
    one_of = lambda xs, name: F.explode(F.array(*[F.lit(x) for x in xs])).alias(name)
    n = spark.range(LISTED_FIRST, LISTED_NUMBERS, LISTED_STEP)
    for name, xs in (("prefix", LISTED_PREFIXES), ("label", LISTED_LABELS), ("tail", LISTED_ENDS), ("tongue", LISTED_TONGUES)):
        n = n.select("*", one_of(xs, name))
    return n.select(F.concat("prefix", "label", F.lit(".example."), "tail", F.lit("/"), "tongue", F.lit("/"), F.col("id").cast("string")).alias("canonical"))
