"""Runs of consecutive numbers in a grid, and their exact, contained and similar partners."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .graph import cut

MIN_LENGTH = 3
#: Places of a line that are looked through together, and numbers that a task holds in windows.
RUN_BLOCK, WINDOW_CELLS = 4096, 1 << 22
#: Of rows that are paired by a key, left and right: rows in a piece, pieces in a block.
PAIR_PIECES, PAIR_BLOCKS = (64, 128), (16, 64)
#: Pairs that a task makes, about, and most tasks.
TASK_PAIRS, MAX_PAIR_TASKS = 1 << 22, 4096
#: Keys with so many pairs, the first so many of them, are paired without a shuffle of copies. Rows in
#: a piece, left and right, and right rows that a task holds. Parquet packs 504 values in a run at most;
#: of a third of that, pairs took least room.
CROSS_PAIRS, CROSS_KEYS, CROSS_PIECES, CROSS_ROWS = 1 << 22, 1024, (168, 128), 1 << 20
#: Shuffle partitions for each pack of a key.
PACK_PARTITIONS = 4


def runs(cells: DataFrame, lines: list[str], index: str, value: str, min_len: int = MIN_LENGTH, block: int = RUN_BLOCK) -> DataFrame:
    """Maximal runs of consecutive ``index`` along each line: first, last, length, values.

    Runs are found within blocks of ``block`` places of a line, so a line is not one task however
    long it is; the window and the grouping below it share one shuffle. Only runs that touch a
    block's edge (two for each block at most) are then joined with their neighbours.
    """
    w = Window.partitionBy(*lines, "run_block").orderBy(index)
    placed = cells.where(F.col(value).isNotNull()).withColumn("run_block", F.floor(F.col(index) / block))
    grouped = placed.withColumn("island", F.col(index) - F.row_number().over(w)).groupBy(*lines, "run_block", "island")
    part = grouped.agg(
        F.min(index).alias("first_idx"), F.max(index).alias("last_idx"), F.count("*").cast("int").alias("length"),
        F.transform(F.sort_array(F.collect_list(F.struct(index, value))), lambda s: s[value]).alias("values"),
    ).drop("run_block", "island")
    at_edge = (F.pmod("first_idx", F.lit(block)) == 0) | (F.pmod("last_idx", F.lit(block)) == block - 1)
    order = Window.partitionBy(*lines).orderBy("first_idx")
    new = F.when(F.col("first_idx") == F.lag("last_idx").over(order) + 1, 0).otherwise(1)
    edges = part.where(at_edge).withColumn("new", new).withColumn("chain", F.sum("new").over(order)).drop("new")
    joined = edges.groupBy(*lines, "chain").agg(
        F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), F.sum("length").cast("int").alias("length"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first_idx", "values"))), lambda s: s["values"])).alias("values"),
    ).drop("chain")
    return part.where(~at_edge).unionByName(joined).where(F.col("length") >= min_len)


def whole_group_runs(cells: DataFrame, lines: list[str], index: str, min_len: int = MIN_LENGTH) -> DataFrame:
    """Lines whose cells are all consecutive."""
    g = cells.groupBy(*lines).agg(F.min(index).alias("first_idx"), F.max(index).alias("last_idx"), F.count("*").cast("int").alias("length"))
    return g.where((F.col("last_idx") - F.col("first_idx") + 1 == F.col("length")) & (F.col("length") >= min_len))


def rounded(values: Column, places: int = 8) -> Column:
    return F.transform(values, lambda x: F.bround(x, places))


def exact_matches(model: DataFrame, upstream: DataFrame, key: str = "values", places: int = 8) -> DataFrame:
    """Equi-join on the rounded values; columns of ``upstream`` get the prefix ``up_``."""
    up = upstream.select(*[F.col(c).alias(f"up_{c}") for c in upstream.columns]).withColumn("match_key", rounded(F.col(f"up_{key}"), places))
    return model.withColumn("match_key", rounded(F.col(key), places)).join(up, "match_key").drop("match_key")


def contained_places(model: DataFrame, upstream: DataFrame, key: str = "values", head: int = 2, places: int = 8, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(model, places), both with the rounded model vector as ``match_key``.

    The model is ``packed``, so it is read once, with its ``columns`` (all, if not given).

    ``places`` has a row for each place at which a distinct model vector is a window of a
    strictly longer upstream one: ``up_`` columns and ``offset``. Windows are not materialised:
    each position of an upstream vector is keyed by its next ``head`` values, which an equi-join
    meets with the first ``head`` values of the distinct model vectors; the rest is compared
    where the heads agree. ``head`` must not exceed the shortest model vector.
    """
    m = packed(model.select(rounded(F.col(key), places).alias("match_key"), *(columns or model.columns)), "match_key")
    up = upstream.select(*[F.col(c).alias(f"up_{c}") for c in upstream.columns]).withColumn("up_round", rounded(F.col(f"up_{key}"), places))
    up = up.where(F.size("up_round") > head)
    at = up.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("up_round") - head))).withColumn("match_head", F.slice("up_round", F.col("offset") + 1, head))
    n = F.size("match_key")
    same = (F.size("up_round") > n) & (F.size("up_round") >= F.col("offset") + n) & (F.slice("up_round", F.col("offset") + 1, n) == F.col("match_key"))
    vectors = m.select("match_key").distinct().withColumn("match_head", F.slice("match_key", 1, head))
    return m, at.join(vectors, "match_head").where(same).drop("match_head", "up_round")


def contained_matches(model: DataFrame, upstream: DataFrame, key: str = "values", head: int = 2, places: int = 8) -> DataFrame:
    """Each offset at which a model vector is a window of a strictly longer upstream one.

    Places are looked for once for each distinct model vector, then paired with its copies."""
    m, at = contained_places(model, upstream, key, head, places)
    return paired_packs(m, packed(at, "match_key"), "match_key")


def packed(d: DataFrame, on: str) -> DataFrame:
    """The rows of a key as arrays side by side, one for each other column, materialised.

    The rows of a key are dealt by a hash to a pack for each few shuffle partitions, and sorted by
    their columns in their order. Rows whose key is null are left out."""
    n = -(-int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PACK_PARTITIONS)
    rest = [c for c in d.columns if c != on]
    rows = d.where(F.col(on).isNotNull()).groupBy(on, F.pmod(F.xxhash64(*rest), F.lit(n)).alias("pack"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
    return cut(rows.select(on, *[F.col("rows")[c].alias(c) for c in rest]))


def paired(left: DataFrame, right: DataFrame, on: str, pieces: tuple[int, int] = PAIR_PIECES, blocks: tuple[int, int] = PAIR_BLOCKS) -> DataFrame:
    """The equi-join on ``on``, without it, where keys may have very many rows on both sides."""
    return paired_packs(packed(left, on), packed(right, on), on, pieces, blocks)


def paired_packs(left: DataFrame, right: DataFrame, on: str, pieces: tuple[int, int] = PAIR_PIECES, blocks: tuple[int, int] = PAIR_BLOCKS) -> DataFrame:
    """``paired`` for sides that are ``packed``; their other columns must differ.

    The keys with most pairs, a bounded number, go through ``_crossed``, which shuffles a row once
    however many it meets. The rows of other keys are dealt to pieces, which are arrays of about
    ``pieces`` rows, and those to blocks of ``blocks`` pieces; each block meets each of the other
    side once. So no key is one task. Spark holds all that comes of one row in memory: a right
    piece with a left block. As a left piece is repeated for each row of a right one, columns of
    the pairs are encoded in few bytes.
    """
    sides = [[c for c in d.columns if c != on] for d in (left, right)]
    count = lambda k, n: (left, right)[k].groupBy(on).agg(F.sum(F.size(sides[k][0])).alias(f"{n}_rows"), F.count("*").alias(f"{n}_packs"))
    keys = count(0, "left").join(count(1, "right"), on).withColumn("pairs", F.col("left_rows").cast("double") * F.col("right_rows"))
    keys = cut(keys.withColumn("pair_key", F.monotonically_increasing_id()))
    most = keys.where(F.col("pairs") >= CROSS_PAIRS).orderBy(F.desc("pairs"), "pair_key").limit(CROSS_KEYS).drop(on).collect()
    # As many as have more pairs of rows than pairs of pieces, each of which is looked at.
    seen = [list(accumulate(r[f"{side}_packs"] + r[f"{side}_rows"] / n for r in most)) for side, n in zip(("left", "right"), CROSS_PIECES, strict=True)]
    most = most[: max((i for i, (a, b, p) in enumerate(zip(*seen, accumulate(r["pairs"] for r in most), strict=True), 1) if a * b <= p), default=0)]
    hot = F.col("pair_key").isin([r["pair_key"] for r in most])
    crossed = _crossed(left, right, on, keys.where(hot).select(on, "pair_key"), sum(r["pairs"] for r in most), sum(r["right_rows"] for r in most)) if most else None
    keys = keys.where(~hot) if most else keys
    pairs = keys.agg(F.sum("pairs")).first()[0]
    if most and not pairs:
        return crossed
    tasks = int(min(MAX_PAIR_TASKS, (pairs or 0.0) // TASK_PAIRS + 1))
    n_pieces = lambda k, side: F.ceil(F.col(f"{side}_rows") / pieces[k]).alias(f"{side}_pieces")
    keys = keys.select(on, "pair_key", n_pieces(0, "left"), n_pieces(1, "right"))
    tile = ["pair_key", "left_block", "right_block"]

    def dealt(d: DataFrame, own: str, other: str, k: int) -> DataFrame:
        rows = d.join(keys, on).select("pair_key", "left_pieces", "right_pieces", F.posexplode(F.arrays_zip(*sides[k])).alias("at", own))
        piece = F.pmod(F.xxhash64("at", own), F.col(f"{own}_pieces")).alias("piece")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(f"{other}_pieces") - 1) / blocks[1 - k]))).alias(f"{other}_block")
        rows = rows.select("pair_key", piece, every, own).withColumn(f"{own}_block", F.floor(F.col("piece") / blocks[k]))
        return rows.repartition(tasks, *tile).groupBy(*tile, "piece").agg(F.collect_list(own).alias(own)).drop("piece")

    # A broadcast or hashed join might go through the sides the other way round.
    met = _unfolded(dealt(right, "right", "left", 1).hint("merge").join(dealt(left, "left", "right", 0), tile))
    return met.unionByName(crossed) if most else met


def _unfolded(met: DataFrame) -> DataFrame:
    """All pairs of the structs in the arrays ``left`` and ``right`` of a row."""
    met = met.select("left", F.explode("right").alias("right")).select(F.explode("left").alias("left"), "right")
    return met.select("left.*", "right.*")


def _crossed(left: DataFrame, right: DataFrame, on: str, keys: DataFrame, pairs: float, right_rows: int) -> DataFrame:
    """All pairs of the rows of a bounded number of keys, each part of the left side with each of the right one.

    The packs are sliced into pieces, and these dealt to parts evenly, whatever their keys. A task
    goes through a left part and holds a right one, both read anew where the shuffle left them; it
    looks at each pair of pieces, so keys must be few. Disk grows with the rows, not with the pairs.
    """
    n_right = -(-right_rows // CROSS_ROWS)
    n_left = int(min(max(1, MAX_PAIR_TASKS // n_right), pairs // (TASK_PAIRS * n_right) + 1))

    def parts(d: DataFrame, k: int, n: int) -> DataFrame:
        rest, rows = [c for c in d.columns if c != on], CROSS_PIECES[k]
        at = d.join(F.broadcast(keys), on).withColumn("at", F.explode(F.sequence(F.lit(1), F.size(rest[0]), F.lit(rows))))
        return at.select("pair_key", *[F.slice(c, F.col("at"), rows).alias(c) for c in rest]).repartition(n)

    met = parts(left, 0, n_left).hint("shuffle_replicate_nl").join(parts(right, 1, n_right), "pair_key")
    zipped = lambda d: F.arrays_zip(*[c for c in d.columns if c != on])
    return _unfolded(met.select(zipped(left).alias("left"), zipped(right).alias("right")))


def _dealt(model: DataFrame, upstream: DataFrame, partners, shard_rows: int, model_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, vec) as rows of a pair of lengths, an upstream shard and a model block.

    ``partners`` gives the upstream lengths for a model length. Upstream vectors are dealt to
    shards of about ``shard_rows`` by a hash of their id, model vectors to blocks of about
    ``model_rows``, and each shard meets each block of a fitting length once.
    """
    total = lambda f: F.aggregate("vec", F.lit(0.0), lambda a, x: a + f(x))
    sizes = upstream.groupBy(F.size("vec").alias("u_len")).agg(F.count("*").alias("rows"), F.sum(total(lambda x: x)).alias("s1"), F.sum(total(lambda x: x * x)).alias("s2"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("rows") / shard_rows))
    blocks = model.groupBy(F.size("vec").alias("m_len")).agg(F.ceil(F.count("*") / model_rows).alias("blocks"))
    # A row for each pair of lengths that occurs.
    pairs = blocks.withColumn("p_len", F.explode(partners(F.col("m_len")))).join(sizes, F.col("p_len") == F.col("u_len")).drop("p_len")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    up = upstream.withColumn("n", F.size("vec")).join(pairs, F.col("n") == F.col("u_len")).withColumn("block", every("blocks"))
    mod = model.withColumn("n", F.size("vec")).join(pairs, F.col("n") == F.col("m_len")).withColumn("shard", every("shards"))
    key = ["m_len", "u_len", "shard", "block"]
    mod = mod.withColumn("block", deal("blocks")).select(*[F.col(c).alias(f"m_{c}") for c in key], "id", "vec", "rows", "s1", "s2")
    return up.withColumn("shard", deal("shards")).select(*[F.col(c).alias(f"u_{c}") for c in key], "id", "vec"), mod


def _matrix(table, columns: int):
    """The vectors of an Arrow table as a matrix, without a step through Python lists."""
    import numpy as np
    import pyarrow as pa

    flat = table.column("vec").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(table.num_rows, columns)


def _compared(model: DataFrame, upstream: DataFrame, partners, id_col: str, vec_col: str, metric: str, least: float, shard_rows: int, model_rows: int) -> DataFrame:
    kernel = kernels.KERNELS.get(metric, kernels.pearson)
    vec = F.transform(vec_col, lambda x: x.cast("double")).alias("vec")
    side = lambda d: d.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), vec)
    up, mod = _dealt(side(model), side(upstream), partners, shard_rows, model_rows)

    def spread(short, wins):
        import numpy as np

        return float(np.std(np.concatenate([short, wins.ravel()])))

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = pa.schema([("model_id", pa.int64()), ("up_id", pa.int64()), ("offset", pa.int32()), ("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        m_len, u_len = right.column("m_m_len")[0].as_py(), right.column("m_u_len")[0].as_py()
        u, m = _matrix(left, u_len), _matrix(right, m_len)
        u_ids, m_ids = np.asarray(left.column("id").to_pylist()), np.asarray(right.column("id").to_pylist())
        ids, ups, offsets, sims = [], [], [], []

        def keep(rows, best, at):
            i, j = np.nonzero(best >= least)
            ids.append(m_ids[rows][i]), ups.append(u_ids[j]), offsets.append(at[i, j]), sims.append(best[i, j])

        if m_len == u_len:
            sigmas = None
            if kernel is kernels.euclidean:
                n, s1, s2 = (np.asarray(right.column(c).to_pylist(), float) for c in ("rows", "s1", "s2"))
                count = (n + 1) * max(1, m_len)
                mean = (s1 + m.sum(axis=1)) / count
                sigmas = np.sqrt(np.maximum(0.0, (s2 + (m * m).sum(axis=1)) / count - mean * mean))
            best = kernels.table(kernel, m, u, sigmas)
            keep(slice(None), best, np.zeros(best.shape, np.int32))
        else:
            n_win = abs(m_len - u_len) + 1
            step = max(1, WINDOW_CELLS // (n_win * min(m_len, u_len) + n_win * len(u)))
            for at in range(0, len(m), step):
                part = m[at : at + step]
                if u_len > m_len:
                    wins = np.lib.stride_tricks.sliding_window_view(u, m_len, axis=1)
                    if kernel is kernels.euclidean:
                        sim = np.array([[kernel(v, w, spread(v, w)) for w in wins] for v in part])
                    else:
                        sim = kernels.table(kernel, part, wins.reshape(-1, m_len)).reshape(len(part), len(u), n_win)
                else:
                    wins = np.lib.stride_tricks.sliding_window_view(part, u_len, axis=1)
                    if kernel is kernels.euclidean:
                        sim = np.array([[kernel(v, w, spread(v, w)) for v in u] for w in wins])
                    else:
                        sim = kernels.table(kernel, wins.reshape(-1, u_len), u).reshape(len(part), n_win, len(u)).transpose(0, 2, 1)
                # Of windows that are equal but for the last digits the first one counts.
                place = np.round(sim, 12).argmax(axis=2)
                keep(slice(at, at + step), np.take_along_axis(sim, place[..., None], 2)[..., 0], place.astype(np.int32))
        cols = [pa.array(np.concatenate(x), f.type) for x, f in zip((ids, ups, offsets, sims), out, strict=True)]
        return pa.Table.from_arrays(cols, schema=out)

    key = ["m_len", "u_len", "shard", "block"]
    return up.groupBy(*[f"u_{c}" for c in key]).cogroup(mod.groupBy(*[f"m_{c}" for c in key])).applyInArrow(run, "model_id long, up_id long, offset int, similarity double")


def similar(model: DataFrame, upstream: DataFrame, id_col: str, vec_col: str, metric: str = "pearson", least: float = 0.8, shard_rows: int = 4096, model_rows: int = 1024) -> DataFrame:
    """Pairs (model_id, up_id, similarity) of vectors of equal length from ``least`` on: one matrix
    product for each shard of upstream vectors and block of model vectors."""
    return _compared(model, upstream, F.array, id_col, vec_col, metric, least, shard_rows, model_rows).drop("offset")


def best_window(model: DataFrame, upstream: DataFrame, metric: str = "pearson", least: float = 0.8, tolerance: float = 0.5, min_len: int = MIN_LENGTH, id_col: str = "vid", vec_col: str = "values", shard_rows: int = 1024, model_rows: int = 1024) -> DataFrame:
    """Model vectors against upstream ones of another length within the tolerance.

    The shorter one slides over the longer; the first best window counts. All windows of a shard
    are compared with a block of the other side by matrix products. The Euclidean spread is that
    of one pair's windows.
    """

    def partners(n: Column) -> Column:
        low = F.greatest(F.lit(min_len), F.floor(n * (1 - tolerance)).cast("int"))
        high = F.greatest(low, (F.floor(n * (1 + tolerance)) * 2).cast("int"))
        return F.filter(F.sequence(low, high), lambda x: x != n)

    return _compared(model, upstream, partners, id_col, vec_col, metric, least, shard_rows, model_rows)


def rank_matches(matches: DataFrame, model: str, order: list[Column], top: int | None = None, alias: str = "rank") -> DataFrame:
    ranked = matches.withColumn(alias, F.row_number().over(Window.partitionBy(model).orderBy(*order)))
    return ranked if top is None else ranked.where(F.col(alias) <= top)


def unmatched(model: DataFrame, matches: DataFrame, model_key: str, match_key: str) -> DataFrame:
    return model.join(matches.select(F.col(match_key).alias("matched_key")).distinct(), F.col(model_key) == F.col("matched_key"), "left_anti")
