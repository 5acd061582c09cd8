"""Exact top-k search by inner product, in tiles.

Candidates and queries are packed into tiles (one row holds a matrix). Candidate tiles are
dealt over ``groups`` keys and every query tile is sent to each key, so an equi-join meets all
pairs of tiles; each pair is one matrix product with a partial selection per query; the
selected lists are merged level by level, ``FAN`` lists at a time, so no task ever holds more
than ``FAN * k`` entries of a query.

Defined results: ids that are null, and vectors that are null, or hold null or non-finite
components, take no part. Vectors are compared with those of equal length only (an empty
vector with empty vectors, score 0). Equal entries of a repeated row are listed once, and a
query id with several vectors gets one list over them. Scores beyond a long are clamped to it.
Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_ROWS, QUERY_ROWS, TILES_PER_GROUP, FAN = 4096, 1024, 8, 16
_TILE = "tile long, dim int, n int, ids binary, mat binary"


def _tiles(rows: DataFrame, rows_per_tile: int, scale: float) -> DataFrame:
    """(id, vector) rows to tiles of ``floor(scale * x)`` as doubles, ids in ascending order."""

    def pack(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def flush(dim: int):
            nonlocal made
            parts = held.pop(dim)
            ids, mat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            made += 1
            cols = [[base + made], [dim], [len(ids)], [ids[order].tobytes()], [np.ascontiguousarray(mat[order]).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["tile", "dim", "n", "ids", "mat"])

        for whole in batches:
            for at in range(0, whole.num_rows, rows_per_tile):
                batch = whole.slice(at, rows_per_tile)
                ids, vecs = batch.column(0), batch.column(1)
                flat = vecs.flatten()  # leaves out null lists
                ok = np.asarray(vecs.is_valid()) & np.asarray(ids.is_valid())
                lens = np.where(np.asarray(vecs.is_valid()), vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
                starts = np.concatenate([[0], np.cumsum(lens)])
                # A null component becomes NaN here; overflow of scale * x becomes infinite.
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False))
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
                ok &= bad[starts[1:]] == bad[starts[:-1]]
                raw = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for dim in np.unique(lens[ok]):
                    pick = np.flatnonzero(ok & (lens == dim))
                    mat = x[(starts[pick][:, None] + np.arange(dim)).ravel()].reshape(len(pick), dim)
                    held.setdefault(int(dim), []).append((raw[pick], mat))
                    if sum(len(p[0]) for p in held[int(dim)]) >= rows_per_tile:
                        yield flush(int(dim))
        for dim in [*held]:
            yield flush(dim)

    return rows.mapInArrow(pack, _TILE)


def tile_scores(q, c):
    """Integer inner products of two matrices of whole doubles, and the value below all of them.

    One product in doubles where every partial sum is below 2**53 by the Cauchy-Schwarz
    inequality; whole numbers of any size otherwise, clamped to a long.
    """
    import numpy as np

    norm = lambda m: float(np.sqrt((m * m).sum(axis=1)).max()) if m.size else 0.0
    with np.errstate(over="ignore"):
        bound = norm(q) * norm(c)
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
    exact = np.dot(whole(q), whole(c).T)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def select(scores, query_ids, ids, k: int):
    """For each query the k best (score descending, id ascending) of other ids; ids ascend."""
    import numpy as np

    n = len(ids)
    clash = bool((np.diff(ids) == 0).any())
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    need = min(n, k + int((last - first).max(initial=0)))
    cut = np.partition(scores, n - need, axis=1)[:, n - need] if n else np.empty(0)
    for i in range(len(query_ids)):
        s = scores[i]
        if clash:
            pick = np.flatnonzero(s >= np.partition(s, 0)[0])
        else:
            above = np.flatnonzero(s > cut[i]) if n else np.empty(0, int)
            level = np.flatnonzero(s == cut[i])[: need - len(above) + int(last[i] - first[i])] if n else above
            pick = np.concatenate([above, level])
        pick = pick[ids[pick] != query_ids[i]]
        pick = pick[np.lexsort((ids[pick], -s[pick]))]
        if clash and len(pick):
            fresh = np.concatenate([[True], (np.diff(ids[pick]) != 0) | (np.diff(s[pick]) != 0)])
            pick = pick[fresh]
        pick = pick[:k]
        yield s[pick], ids[pick]


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0
) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score for each row where ``is_query``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    groups = max(1, -(-vectors.count() // (TILE_ROWS * TILES_PER_GROUP)))
    groups = max(groups, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 2)
    cands = _tiles(rows.select("id", "vec"), TILE_ROWS, scale).withColumn("grp", F.pmod(F.xxhash64("tile"), F.lit(groups)))
    queries = _tiles(rows.where("is_query").select("id", "vec"), QUERY_ROWS, scale).select(
        F.col("dim").alias("q_dim"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("q_grp")
    )
    pairs = cands.join(queries, (F.col("grp") == F.col("q_grp")) & (F.col("dim") == F.col("q_dim")))
    pairs = pairs.select("grp", "dim", "ids", "mat", "q_ids", "q_mat")

    def score(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for r in range(whole.num_rows):
                grp, dim, ids, mat, q_ids, q_mat = (c[0].as_py() for c in whole.slice(r, 1).columns)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                c = np.frombuffer(mat).reshape(len(ids), dim)
                q = np.frombuffer(q_mat).reshape(len(q_ids), dim)
                best = [*select(tile_scores(q, c), q_ids, ids, k)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s, _ in best])]).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(-np.concatenate([s for s, _ in best])), pa.array(np.concatenate([i for _, i in best]))], names=["neg", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.full(len(q_ids), grp, np.int64)), pa.ListArray.from_arrays(pa.array(offsets), entries)], names=["query_id", "grp", "top"])

    lists = pairs.mapInArrow(score, "query_id long, grp long, top array<struct<neg:long,id:long>>")
    while True:
        merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k)
        lists = lists.groupBy("query_id", "grp").agg(merged.alias("top"))
        if groups == 1:
            break
        groups = -(-groups // FAN)
        lists = lists.withColumn("grp", F.floor(F.col("grp") / FAN))
    entry = lists.select("query_id", F.posexplode("top").alias("rank", "entry"))
    return entry.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("entry.id").alias(id_col), (-F.col("entry.neg")).alias("score"))
