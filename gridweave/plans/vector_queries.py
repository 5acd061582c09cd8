"""Vectors, matching and similarity over the tables.

``lineitem`` is a grid: an order is a row, a line number a column, the summed quantity the cell.
``events`` is a ledger: a user's hours are the rows of a column of cells.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs
from ..operators import vectors as V
from .registry import query

_GRID = "WITH g AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)"
_ISLANDS = """, i AS (SELECT *, {idx} - row_number() OVER (PARTITION BY {line} ORDER BY {idx}) AS island FROM g)
, runs AS (SELECT {line}, min({idx}) AS first_idx, max({idx}) AS last_idx, CAST(count(*) AS INTEGER) AS length, list(q ORDER BY {idx}) AS values
  FROM i GROUP BY {line}, island HAVING count(*) >= {n})"""
_ROWS = _GRID + _ISLANDS.format(idx="l_linenumber", line="l_orderkey", n=3)
_COLS = _GRID + _ISLANDS.format(idx="l_orderkey", line="l_linenumber", n=3)


def grid(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))


def row_runs(t, n=3):
    return V.runs(grid(t), ["l_orderkey"], "l_linenumber", "q", n)


_SUM = ", list_sum(values) AS total FROM runs"


@query(_ROWS + " SELECT l_orderkey, first_idx, last_idx, length" + _SUM)
def vector_runs_row(t):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return row_runs(t).select("l_orderkey", "first_idx", "last_idx", "length", total.alias("total"))


@query(_COLS + " SELECT l_linenumber, first_idx, last_idx, length" + _SUM)
def vector_runs_col(t):
    r = V.runs(grid(t), ["l_linenumber"], "l_orderkey", "q")
    return r.select("l_linenumber", "first_idx", "last_idx", "length", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(_GRID + """, k AS (SELECT l_orderkey, min(l_linenumber) AS first_idx, max(l_linenumber) AS last_idx, CAST(count(*) AS INTEGER) AS length FROM g GROUP BY 1)
SELECT * FROM k WHERE last_idx - first_idx + 1 = length AND length >= 3""")  # fmt: skip
def formula_vectors(t):
    return V.whole_group_runs(grid(t), ["l_orderkey"], "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F') AND l_quantity IS NOT NULL AND l_extendedprice > 0""")  # fmt: skip
def numeric_filter(t):
    formula = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return t("lineitem").where(~formula & F.col("l_quantity").isNotNull() & (F.col("l_extendedprice") > 0)).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(_ROWS + " SELECT l_orderkey, length, list_slice(values, 1, 5)[1] AS v1, list_slice(values, 1, 5)[2] AS v2, list_slice(values, 1, 5)[3] AS v3, len(list_slice(values, 1, 5)) AS n_samples FROM runs")
def sample_values(t):
    s = F.slice("values", 1, 5)
    at = lambda k: F.get(s, F.lit(k)).alias(f"v{k + 1}")
    return row_runs(t).select("l_orderkey", "length", at(0), at(1), at(2), F.size(s).cast("long").alias("n_samples"))


_HALVES = """WITH g AS (SELECT l_returnflag, l_orderkey, l_linenumber, floor(sum(l_quantity) / 10) AS q FROM lineitem GROUP BY 1, 2, 3)
, i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber) AS island FROM g)
, runs AS (SELECT l_returnflag, l_orderkey, min(l_linenumber) AS first_idx, CAST(count(*) AS INTEGER) AS length, list(q ORDER BY l_linenumber) AS values
  FROM i GROUP BY l_returnflag, l_orderkey, island HAVING count(*) >= 2)"""


def half_runs(t, flag):
    g = t("lineitem").where(F.col("l_returnflag") == flag).groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.sum("l_quantity") / 10).cast("double").alias("q"))
    return V.runs(g, ["l_orderkey"], "l_linenumber", "q", 2)


@query(_HALVES + """ SELECT m.l_orderkey AS model_key, m.first_idx AS model_first, u.l_orderkey AS up_key, u.first_idx AS up_first, m.length
FROM runs m JOIN runs u ON m.values = u.values WHERE m.l_returnflag = 'A' AND u.l_returnflag = 'R' AND m.length >= 3""")  # fmt: skip
def exact_match(t):
    m = V.exact_matches(half_runs(t, "A").where("length >= 3"), half_runs(t, "R").where("length >= 3"))
    return m.select(F.col("l_orderkey").alias("model_key"), F.col("first_idx").alias("model_first"), F.col("up_l_orderkey").alias("up_key"), F.col("up_first_idx").alias("up_first"), "length")


_SUBS = _HALVES + """, w AS (SELECT l_orderkey, first_idx, values, length, unnest(range(length)) AS o FROM runs WHERE l_returnflag = 'R')
, hits AS (SELECT m.l_orderkey AS model_key, m.first_idx AS model_first, m.length AS model_len, u.l_orderkey AS up_key, u.first_idx AS up_first, CAST(u.o AS INTEGER) AS "offset"
  FROM runs m JOIN w u ON m.l_returnflag = 'A' AND u.length > m.length AND u.o + m.length <= u.length AND u.values[u.o + 1 : u.o + m.length] = m.values)"""


def subsequence_places(t):
    """Packs of model runs, and where each distinct one lies within a longer run; ``match_key`` has its values.

    The columns with few values come first, as packs are sorted by them."""
    a = half_runs(t, "A").select("values", F.col("first_idx").alias("model_first"), F.col("l_orderkey").alias("model_key"))
    m, at = V.contained_places(a, half_runs(t, "R"), head=2, columns=["model_first", "model_key"])
    return m, at.select("match_key", F.col("up_first_idx").alias("up_first"), "offset", F.col("up_l_orderkey").alias("up_key"))


def subsequences(t):
    m, at = subsequence_places(t)
    return V.paired_packs(m, V.packed(at, "match_key"), "match_key")


@query(_SUBS + ' SELECT model_key, model_first, up_key, up_first, "offset" FROM hits')
def subsequence_match(t):
    return subsequences(t).select("model_key", "model_first", "up_key", "up_first", "offset")


_LETTER = "(CASE WHEN {n} <= 26 THEN chr(CAST(64 + {n} AS INTEGER)) ELSE chr(CAST(64 + ({n} - 1) // 26 AS INTEGER)) || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)) END)"


@query(_SUBS + f""" SELECT model_key, up_key, up_first, "offset", {_LETTER.format(n='(up_first + "offset")')} || up_key || ':' || {_LETTER.format(n='(up_first + "offset" + model_len - 1)')} || up_key AS matched_range FROM hits""")
def matched_sub_range(t):
    """The range is the same for all copies of a model run, so it is made once for each place."""
    m, at = subsequence_places(t)
    rng = refs.sub_range(F.lit("row"), F.col("up_key"), F.col("up_first"), F.col("offset"), F.size("match_key"))
    return V.paired_packs(m.drop("model_first"), V.packed(at.withColumn("matched_range", rng), "match_key"), "match_key").select("model_key", "up_key", "up_first", "offset", "matched_range")


@query(_SUBS + """ SELECT l_orderkey AS model_key, first_idx AS model_first FROM runs r WHERE l_returnflag = 'A'
AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.model_key = r.l_orderkey)""")  # fmt: skip
def unmatched(t):
    m = V.unmatched(half_runs(t, "A"), subsequences(t), "l_orderkey", "model_key")
    return m.select(F.col("l_orderkey").alias("model_key"), F.col("first_idx").alias("model_first"))


# Model vectors are those of label 0, upstream vectors all others.
_PAIRS = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
, p AS (SELECT m.vec_id AS model_id, u.vec_id AS up_id, m.e AS a, u.e AS b FROM v m JOIN v u ON len(m.e) = len(u.e) WHERE m.label = 0 AND u.label <> 0)"""
_CENTRED = _PAIRS + """, c AS (SELECT model_id, up_id, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM p)
, s AS (SELECT model_id, up_id, list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS sim FROM c)"""


def _sim(t, metric, least):
    e = t("embeddings")
    return V.similar(e.where("label = 0"), e.where("label <> 0"), "vec_id", "embedding", metric, least)


@query(_CENTRED + " SELECT model_id, up_id, round(sim, 6) AS similarity FROM s WHERE sim >= 0.3")
def approx_pearson(t):
    return _sim(t, "pearson", 0.3).select("model_id", "up_id", F.round("similarity", 6).alias("similarity"))


@query(_PAIRS + """ SELECT model_id, up_id, round(sim, 6) AS similarity FROM (SELECT model_id, up_id, list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS sim FROM p) WHERE sim >= 0.3""")
def approx_cosine(t):
    return _sim(t, "cosine", 0.3).select("model_id", "up_id", F.round("similarity", 6).alias("similarity"))


@query(_PAIRS + """, u AS (SELECT len(e) AS n, count(*) AS c, sum(list_sum(e)) AS s1, sum(list_inner_product(e, e)) AS s2 FROM v WHERE label <> 0 GROUP BY 1)
, m AS (SELECT vec_id, n, sqrt((s2 + list_inner_product(e, e)) / ((c + 1) * n) - power((s1 + list_sum(e)) / ((c + 1) * n), 2)) AS sigma FROM v JOIN u ON len(e) = n WHERE label = 0)
SELECT model_id, up_id, round(sim, 6) AS similarity FROM (SELECT model_id, up_id, 1 / (1 + list_distance(a, b) / (sigma * sqrt(n))) AS sim FROM p JOIN m ON model_id = vec_id) WHERE sim >= 0.45""")  # fmt: skip
def approx_euclidean(t):
    return _sim(t, "euclidean", 0.45).select("model_id", "up_id", F.round("similarity", 6).alias("similarity"))


@query(_CENTRED + """ SELECT model_id, up_id, rank, similarity FROM (SELECT model_id, up_id, round(sim, 6) AS similarity,
CAST(row_number() OVER (PARTITION BY model_id ORDER BY round(sim, 6) DESC, up_id) AS INTEGER) AS rank FROM s WHERE sim >= 0.0) WHERE rank <= 5""")  # fmt: skip
def topn_rank(t):
    s = _sim(t, "pearson", 0.0).withColumn("similarity", F.round("similarity", 6))
    return V.rank_matches(s, "model_id", [F.desc("similarity"), F.col("up_id")], 5).select("model_id", "up_id", "rank", "similarity")


@query(_ROWS + """ SELECT m.l_orderkey AS model_key, m.first_idx AS model_first, count(*) AS n_partners FROM runs m
JOIN (SELECT length, count(*) AS c FROM runs GROUP BY 1) x ON x.length BETWEEN greatest(3, floor(m.length * 0.5)) AND floor(m.length * 1.5) * 2
JOIN (SELECT DISTINCT length FROM runs) y ON y.length = x.length GROUP BY ALL""")  # fmt: skip
def length_bounded_join(t):
    r = row_runs(t)
    lens = r.groupBy("length").count().select(F.col("length").alias("up_len"), "count")
    m = r.withColumn("up_len", F.explode(F.sequence(F.greatest(F.lit(3), F.floor(F.col("length") * 0.5).cast("int")), (F.floor(F.col("length") * 1.5) * 2).cast("int"))))
    return m.join(lens, "up_len").groupBy(F.col("l_orderkey").alias("model_key"), F.col("first_idx").alias("model_first")).agg(F.count("*").alias("n_partners"))


@query(_HALVES + """, m AS (SELECT l_orderkey AS mk, first_idx AS mf, values AS a, length AS n FROM runs WHERE l_returnflag = 'A' AND length >= 4), u AS (SELECT l_orderkey AS uk, first_idx AS uf, values AS b, length AS l FROM runs WHERE l_returnflag = 'R' AND length >= 3)
, p AS (SELECT *, unnest(range(abs(n - l) + 1)) AS o FROM m JOIN u ON l <> n AND l BETWEEN greatest(3, floor(n * 0.5)) AND floor(n * 1.5) * 2)
, w AS (SELECT mk, mf, uk, uf, o, CASE WHEN l > n THEN a ELSE a[o + 1 : o + l] END AS x, CASE WHEN l > n THEN b[o + 1 : o + n] ELSE b END AS y FROM p)
, d AS (SELECT mk, mf, uk, uf, o, x[1] AS x1, y[1] AS y1, list_transform(x, lambda v: v - list_avg(x)) AS x, list_transform(y, lambda v: v - list_avg(y)) AS y FROM w)
, q AS (SELECT *, list_inner_product(x, x) AS xx, list_inner_product(y, y) AS yy FROM d)
, s AS (SELECT mk, mf, uk, uf, o, CASE WHEN xx < 1e-30 THEN CASE WHEN yy < 1e-30 AND x1 = y1 THEN 1.0 ELSE 0.0 END WHEN yy < 1e-30 THEN 0.0 ELSE list_inner_product(x, y) / sqrt(xx * yy) END AS sim FROM q)
SELECT mk AS model_key, mf AS model_first, uk AS up_key, uf AS up_first, CAST(arg_min(o, (-round(sim, 9), o)) AS INTEGER) AS "offset", round(max(sim), 6) AS similarity FROM s GROUP BY 1, 2, 3, 4 HAVING max(sim) >= 0.95""")  # fmt: skip
def best_window(t):
    """Runs of orders with returns against runs of other lengths."""
    named = lambda flag, n: half_runs(t, flag).where(F.col("length") >= n).withColumn("vid", F.xxhash64("l_orderkey", "first_idx"))
    a, r = named("A", 4), named("R", 3)
    found = V.best_window(a, r, least=0.95)
    m = a.select(F.col("vid").alias("model_id"), F.col("l_orderkey").alias("model_key"), F.col("first_idx").alias("model_first"))
    u = r.select(F.col("vid").alias("up_id"), F.col("l_orderkey").alias("up_key"), F.col("first_idx").alias("up_first"))
    return found.join(m, "model_id").join(u, "up_id").select("model_key", "model_first", "up_key", "up_first", "offset", F.round("similarity", 6).alias("similarity"))


# Series of events by user, of one length each: 91 against 3,196 vectors where there are as many.
_SERIES = """WITH e AS (SELECT event_id // 12 AS vid, event_id % 12 AS i, value FROM events), v AS (SELECT vid, list(value ORDER BY i) AS a FROM e GROUP BY 1 HAVING count(*) = 12)
, p AS (SELECT m.vid AS model_id, u.vid AS up_id, list_transform(m.a, lambda x: x - list_avg(m.a)) AS x, list_transform(u.a, lambda x: x - list_avg(u.a)) AS y FROM v m JOIN v u ON m.vid < 91 AND u.vid >= 91 AND u.vid < 91 + 3196)"""


@query(_SERIES + " SELECT model_id, up_id, round(sim, 6) AS similarity FROM (SELECT model_id, up_id, list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)) AS sim FROM p) WHERE sim >= 0.8")
def series_trace(t):
    """91 model vectors against 3,196 upstream ones: exact partners first, then similar ones."""
    e = t("events").select(F.floor(F.col("event_id") / 12).alias("vid"), (F.col("event_id") % 12).alias("i"), "value")
    v = e.groupBy("vid").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("values")).where("n = 12")
    m, u = v.where("vid < 91"), v.where("vid >= 91 AND vid < 91 + 3196")
    s = V.similar(m, u, "vid", "values")
    return s.select("model_id", "up_id", F.round("similarity", 6).alias("similarity"))


@query(_ROWS + """, g5 AS (SELECT length, list(l_orderkey ORDER BY l_orderkey) AS ks FROM runs GROUP BY 1)
SELECT length, len(ks) AS n_vectors, ks[1] AS first_key FROM g5""")  # fmt: skip
def group_by_length(t):
    return row_runs(t).groupBy("length").agg(F.count("*").alias("n_vectors"), F.min("l_orderkey").alias("first_key"))
