"""Connected components of an edge table by local union-find and pointer jumping.

In each round every task joins the edges that it holds by union-find and sends on one row for
each vertex: its least neighbour so far. A vertex thus has a row for each task at most, however
many edges it has. A vertex that meets several of these roots hooks them onto the least one,
and every vertex then jumps to the label of its root. The rounds end when no vertex meets two
roots: then all labels are final. Each round at least halves the roots of a component that has
several. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task joins in memory.
EDGES_PER_TASK = 200_000


def join_edges(u: list[int], v: list[int]) -> dict[int, int]:
    """The least vertex that each vertex is joined with."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := above.setdefault(top, top)) != top:
            top = y
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: root(x) for x in [*above]}


def _local(batches: Iterator):
    import pyarrow as pa

    u, v = [], []

    def flush():
        found = join_edges(u, v)
        u.clear(), v.clear()
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["vertex", "root"])

    for batch in batches:
        u += batch.column(0).to_pylist()
        v += batch.column(1).to_pylist()
        if len(u) > EDGES_PER_TASK:
            yield flush()
    if u:
        yield flush()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vertex, component) for each vertex of an edge; component is its smallest vertex."""
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    while True:
        seen = e.mapInArrow(_local, "vertex long, root long").groupBy("vertex")
        label = cut(seen.agg(F.min("root").alias("component"), F.collect_set("root").alias("roots")))
        n, n_open = label.agg(F.count("*"), F.coalesce(F.sum((F.size("roots") > 1).cast("long")), F.lit(0))).first()
        if not n_open:
            return label.select("vertex", "component")
        hooks = label.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("component").alias("v")).where("u <> v")
        above = label.select(F.col("vertex").alias("a_vertex"), F.col("component").alias("a_component"))
        jumped = label.join(above, F.col("component") == F.col("a_vertex")).select(F.col("vertex").alias("u"), F.col("a_component").alias("v"))
        e = cut(jumped.where("u <> v").union(hooks).coalesce(1 + n // EDGES_PER_TASK))
