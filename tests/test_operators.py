import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import refs
from gridweave.operators import graph as G
from gridweave.operators import tables as T
from gridweave.operators import vectors as V


def vec(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vid long, values array<double>")


def test_exact_and_contained(spark):
    up = vec(spark, [(1, [10.0, 20, 30, 40, 50]), (2, [5.0, 10, 20, 30, 99]), (3, [20.0, 30, 40])])
    model = vec(spark, [(7, [20.0, 30, 40]), (8, [1.0, 2, 3])])
    assert [r["up_vid"] for r in V.exact_matches(model, up).collect()] == [3]
    assert [(r["up_vid"], r["offset"]) for r in V.contained_matches(model, up).collect()] == [(1, 1)]
    assert [r["vid"] for r in V.unmatched(model, V.exact_matches(model, up), "vid", "vid").collect()] == [8]


def test_paired(spark):
    """Blocks and pieces of few rows; equal rows count, keys that are null or alone don't."""
    rows = [((None, "a", "b", "c")[i % 4], i % 50) for i in range(200)]
    left = spark.createDataFrame(rows, "k string, x long")
    right = spark.createDataFrame([("a", i // 2) for i in range(90)] + [("b", 7), ("d", 8), (None, 9)], "k string, y long")
    want = sorted((r["x"], r["y"]) for r in left.join(right, "k").collect())
    for pieces, blocks in (((3, 2), (2, 4)), ((1, 1), (1, 1)), ((64, 128), (16, 64))):
        assert sorted(tuple(r) for r in V.paired(left, right, "k", pieces, blocks).collect()) == want
    nothing = V.paired(left, right.where("k = 'd'"), "k")
    assert nothing.columns == ["x", "y"] and nothing.isEmpty()
    zeros = V.paired(vec(spark, [(1, [0.0, 1]), (2, [-0.0, 1]), (3, [float("nan"), 1])]), vec(spark, [(4, [-0.0, 1]), (5, [float("nan"), 1])]).withColumnRenamed("vid", "up"), "values")
    assert sorted(map(tuple, zeros.collect())) == [(1, 4), (2, 4), (3, 5)]


@pytest.mark.parametrize("keys, held, pairs", [(1, 7, 100), (2, 1 << 20, 1 << 22), (1024, 40, 30)])
def test_paired_with_keys_crossed(spark, monkeypatch, keys, held, pairs):
    """Keys with many pairs, one of them, two or all, in parts of few rows; the others are paired by blocks."""
    for name, value in (("CROSS_PAIRS", 40), ("CROSS_KEYS", keys), ("CROSS_PIECES", (3, 2)), ("CROSS_ROWS", held), ("TASK_PAIRS", pairs)):
        monkeypatch.setattr(V, name, value)
    rows = [((None, "a", "b", "c")[i % 4], i % 50, None if i % 3 else f"t{i}") for i in range(200)] + [("e", 1, "x")]
    left = spark.createDataFrame(rows, "k string, x long, t string")
    right = spark.createDataFrame([("a", [i // 2]) for i in range(90)] + [("b", [7, 8]), ("b", None), ("d", [8]), ("e", []), (None, [9])], "k string, y array<long>")
    want = sorted(map(str, left.join(right, "k").drop("k").collect()))
    assert sorted(map(str, V.paired(left, right, "k").collect())) == want
    alone = V.paired(left.where("k = 'a'"), right, "k")
    assert alone.columns == ["x", "t", "y"] and alone.count() == 50 * 90


def test_copies_are_shuffled_once(spark):
    """However many rows they meet: two thousand million pairs here, of which one is asked for."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    shuffled = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))
    before = shuffled()
    got = V.paired(spark.range(20_000).selectExpr("'k' AS k", "id AS x"), spark.range(100_000).selectExpr("'k' AS k", "id AS y"), "k")
    assert got.limit(1).count() == 1
    assert shuffled() - before < 2 * 120_000


def copies(spark, n, values, first=0):
    """Vectors of other ids each time, as orders have them."""
    numbers = F.array(*[F.lit(float(x)) for x in values])
    return spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + first).alias("vid"), numbers.alias("values"))


def test_copies_of_a_contained_vector_are_not_one_task(spark):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")
    try:
        got = V.contained_matches(copies(spark, 5000, [2, 3]), copies(spark, 9000, [1, 2, 3]))
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(setting)
    assert sum(tasks) == 45_000_000 and max(tasks) < 0.5 * sum(tasks)


def test_pairs_of_copies_take_few_bytes(spark, tmp_path):
    got = V.contained_matches(copies(spark, 2003, [2, 3]), copies(spark, 3001, [1, 2, 3])).select("vid", "up_vid", "offset")
    got.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 2003 * 3001
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 2003 * 3001


def test_similar_and_windows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(99, None)]
    df = vec(spark, rows)
    got = {(r["model_id"], r["up_id"]): r["similarity"] for r in V.similar(df, df, "vid", "values", "pearson", 0.2, shard_rows=7, model_rows=5).collect()}
    want = {(i, j): c for i, a in rows[:40] for j, b in rows[:40] if (c := np.corrcoef(a, b)[0, 1]) >= 0.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    long = vec(spark, [(1, [9.0, 1, 2, 3, 4, 7, 7, 7])])
    assert [(r["up_id"], r["offset"]) for r in V.best_window(vec(spark, [(5, [10.0, 20, 30, 40])]), long, tolerance=1.0).collect()] == [(1, 1)]


def test_runs_break_on_gaps(spark):
    cells = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3, 5, 6)] + [("b", 1, None)], "line string, i int, v double")
    assert [(r["first_idx"], r["last_idx"]) for r in V.runs(cells, ["line"], "i", "v").collect()] == [(1, 3)]


def test_reach_and_levels(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a", "a")], "start string, node string")
    assert {(r["node"], r["depth"]) for r in G.reach(s, e).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    dag = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    assert {(r["node"], r["level"]) for r in G.depth_levels(dag).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "src long, dst long")
    got = {r["node"]: r["component"] for r in G.components(chain).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(31, 61)} == {31}


def test_overlap_and_containment(spark):
    a = spark.createDataFrame([("s", 1, 9000), ("s", 20000, 20001)], "s string, lo long, hi long")
    b = spark.createDataFrame([("s", 5000, 5001), ("s", 9000, 30000), ("t", 1, 2)], "t string, x long, y long")
    got = {(r["lo"], r["x"]) for r in T.overlapping(a, b, ("s", "t"), ("lo", "hi"), ("x", "y")).collect()}
    assert got == {(1, 5000), (1, 9000), (20000, 9000)}
    p = spark.createDataFrame([("s", 4), ("s", 9001)], "sheet string, at long")
    assert [r["at"] for r in T.contained_points(p, a, "sheet", "at", "lo", "hi", "s").collect()] == [4]


@pytest.mark.parametrize("rng, want", [("B2", (2, 2, 2, 2)), ("$C$9:A1", (1, 1, 9, 3)), ("nonsense", (1, 1, 1_048_576, 16_384))])
def test_rect(spark, rng, want):
    row = spark.range(1).select(refs.rect(F.lit(rng)).alias("x")).first()["x"]
    assert tuple(row) == want


def test_letters(spark):
    got = spark.range(1, 16_385).select("id", refs.idx_to_col(F.col("id").cast("int")).alias("x")).select("id", "x", refs.col_to_idx(F.col("x")).alias("back"))
    assert got.where("id <> back").isEmpty() and got.where("id = 16384").first()["x"] == "XFD"


def test_graph_without_depth_caps(spark, monkeypatch):
    from gridweave.operators import graph

    monkeypatch.setattr(graph, "KEPT_FRONTIERS", 4)
    chain = spark.createDataFrame([(i, i + 1) for i in range(23)], "src long, dst long")
    assert {r["node"]: r["level"] for r in graph.depth_levels(chain).collect()} == {i: i for i in range(24)}
    start = spark.createDataFrame([(0, 0)], "start long, node long")
    assert {r["node"]: r["depth"] for r in graph.reach(start, chain).collect()} == {i: i for i in range(24)}
    assert graph.reach(start, chain, 3).count() == 4
    assert {r["component"] for r in graph.components(chain).collect()} == {0}


def test_levels_open_cycles(spark):
    from gridweave.operators import graph

    edges = [(5, 1), (1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (8, 7), (4, 9), (9, 9), (20, 20)]
    got = {r["node"]: r["level"] for r in graph.depth_levels(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {5: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 5, 7: 0, 8: 1, 20: 0}


def test_runs_across_blocks(spark):
    from gridweave.operators import vectors as V

    places = [*range(0, 23), *range(25, 27), *range(30, 41), 50, *range(-9, -3)]
    cells = spark.createDataFrame([("a", i, float(i)) for i in places] + [("b", 7, 1.0), ("b", 8, None), ("b", 9, 1.0)], "line string, i long, v double")
    for block in (1, 4, 10, 4096):
        got = {(r["line"], r["first_idx"], r["last_idx"], r["length"], tuple(r["values"])) for r in V.runs(cells, ["line"], "i", "v", 3, block).collect()}
        assert got == {("a", a, z, z - a + 1, tuple(float(x) for x in range(a, z + 1))) for a, z in ((0, 22), (30, 40), (-9, -4))}


def test_overlapping_boxes(spark):
    import random

    from gridweave.operators import tables as T

    rng = random.Random(3)
    box = lambda: (lambda r, c: (rng.randint(0, 1), r, c, r + rng.randint(0, 30), c + rng.randint(0, 5)))(rng.randint(1, 60), rng.randint(1, 9))
    left, right = [(i, *box()) for i in range(40)], [(i, *box()) for i in range(40)]
    named = lambda rows, p: spark.createDataFrame(rows, f"{p}_id int, {p}_sheet int, r1 int, c1 int, r2 int, c2 int").select(f"{p}_id", f"{p}_sheet", F.struct("r1", "c1", "r2", "c2").alias(p))
    got = T.overlapping_boxes(named(left, "a"), named(right, "b"), [("a_sheet", "b_sheet")], ("a", "b"), 8).select("a_id", "b_id").collect()
    want = {(i, j) for i, s, a, b, c, d in left for j, t, e, f, g, h in right if s == t and a <= g and e <= c and b <= h and f <= d}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_entry_without_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for broken in (False, True):
        copy = tmp_path / str(broken)
        shutil.copytree(root / "gridweave", copy / "gridweave", ignore=shutil.ignore_patterns("__pycache__", "llm"))
        shutil.copy(root / "__spark_entry__.py", copy)
        if broken:
            (copy / "gridweave" / "llm").mkdir()
            (copy / "gridweave" / "llm" / "__init__.py").write_text("import no_such_module\n")
        run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"], cwd=copy, capture_output=True, text=True, check=True)
        assert run.stdout.split()[1] == "False" and int(run.stdout.split()[0]) > 100
