"""Connections of workbooks: extractors, native formula detection, first-wins deduplication."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as FX
from ..functions import text
from ..functions.sql_text import sql_parts
from ..operators import extractors as E
from ..operators.tables import counts_by, first_wins
from ..sources import workbook as W
from ..sources import writer

CATEGORY_ORDER = ("database", "powerquery", "web", "file", "formula", "pivot", "hyperlink", "vba", "ole", "input", "metadata")


def formula_connections(books: DataFrame) -> DataFrame:
    """Sources in cell, validation, format and chart formulas, through native expressions."""
    cell = W.formulas(W.cells(books)).select("file", F.concat("sheet", F.lit("!"), "ref").alias("location"), "formula")
    other = W.each(books, "file string, location string, formula string", lambda f, b: ((f, a, x) for a, x, o in E.other_formulas(b) if o != "chart"))
    all_f = cell.unionByName(other)
    hits = all_f.select("file", "location", "formula", F.posexplode(FX.detect(F.col("formula"))).alias("seq", "d"))
    kind = F.when(F.col("d.sub_type") == "webservice", "formula").otherwise(F.col("d.category"))
    return hits.select(
        "file", F.lit(3).alias("extractor"), "seq", text.connection_id(kind, F.col("formula"), F.col("location")).alias("id"), F.col("d.category").alias("category"), F.col("d.sub_type").alias("sub_type"),
        F.col("d.source").alias("source"), F.col("formula").alias("raw_connection"), "location", F.lit(None).cast("string").alias("query_text"), F.col("d.confidence").alias("confidence"), F.lit("{}").alias("metadata"),
    )


def connections(books: DataFrame) -> DataFrame:
    """One row per connection id and file, the earliest extractor's; with parsed SQL."""
    rows = W.each(books, E.CONNECTIONS, E.connection_rows).unionByName(formula_connections(books))
    kept = first_wins(rows, ["file", "id"], ["extractor", "seq"])
    parsed = F.when(F.length("query_text") >= 15, sql_parts(F.col("query_text")))
    return kept.withColumn("parsed_query", parsed)


def summary(found: DataFrame) -> DataFrame:
    return counts_by(found, ["category"], ["sub_type"], [])


def sources_by_category(found: DataFrame) -> DataFrame:
    """Distinct sources in the fixed category order."""
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    firsts = first_wins(found.select("category", "source", "extractor", "seq", "sub_type"), ["category", "source"], ["extractor", "seq"])
    return firsts.withColumn("pos", F.when(order > 0, order).otherwise(99)).orderBy("pos", "category", "source")


def hardcoded_vectors(books: DataFrame, min_len: int = 3) -> DataFrame:
    return vectors(W.hardcoded(W.cells(books)), min_len)


def sheet_vectors(books: DataFrame, min_len: int = 3) -> DataFrame:
    """(file, sheet_idx, sheet, vectors): every sheet, those without vectors with an empty list."""
    v = hardcoded_vectors(books, min_len)
    row = F.struct("direction", "cell_range", "length", F.slice("values", 1, 5).alias("samples"))
    lists = v.groupBy(F.col("file").alias("v_file"), F.col("sheet").alias("v_sheet")).agg(F.array_sort(F.collect_list(row)).alias("found"))
    all_sheets = W.sheets(books).select("file", "sheet_idx", "sheet")
    met = all_sheets.join(lists, (F.col("file") == F.col("v_file")) & (F.col("sheet") == F.col("v_sheet")), "left")
    return met.select("file", "sheet_idx", "sheet", F.coalesce("found", F.array().cast(lists.schema["found"].dataType)).alias("vectors"))


def vectors(cells: DataFrame, min_len: int = 3) -> DataFrame:
    """Column and row runs of numbers: file, sheet, direction, start, length, values, range."""
    from ..functions import refs
    from ..operators.vectors import runs

    grid = cells.select("file", "sheet", "row", "col", F.col("num_value").alias("v"))
    down = runs(grid, ["file", "sheet", "col"], "row", "v", min_len).select("file", "sheet", F.lit("column").alias("direction"), F.col("first_idx").alias("r1"), F.col("col").alias("c1"), "length", "values")
    across = runs(grid, ["file", "sheet", "row"], "col", "v", min_len).select("file", "sheet", F.lit("row").alias("direction"), F.col("row").alias("r1"), F.col("first_idx").alias("c1"), "length", "values")
    both = down.unionByName(across)
    return both.withColumn("cell_range", refs.sub_range(F.col("direction"), F.col("r1"), F.col("c1"), F.lit(0), F.col("length")))


def report(books: DataFrame, out_dir: str | Path, stem: str, json_only: bool = False) -> list[Path]:
    """The JSON report, and unless ``json_only`` a workbook and a diagram of the sources."""
    found = connections(books).cache()
    counts = {k: {r[k]: r["n"] for r in found.groupBy(k).agg(F.count("*").alias("n")).collect()} for k in ("category", "sub_type")}
    rows = [r.asDict(True) for r in found.orderBy("file", "extractor", "seq").collect()]
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    made = [out / f"{stem}_lineage.json"]
    made[0].write_text(writer.json_report(stem, dt.datetime.now(dt.UTC).isoformat(), counts["category"], counts["sub_type"], rows))
    if not json_only:
        head = ["id", "category", "sub_type", "source", "location", "query_text", "confidence", "raw_connection"]
        tabs = {"All Connections": (head, [[str(r[h])[:200] if r[h] is not None else None for h in head] for r in rows])}
        for sheet, vs in _by(hardcoded_vectors(books).orderBy("sheet", "cell_range").collect(), "sheet").items():
            tabs[sheet] = (["range", "direction", "length", "sample"], [[v["cell_range"], v["direction"], v["length"], ", ".join(f"{x:g}" for x in v["values"][:5])] for v in vs])
        made.append(writer.write_report(out / f"{stem}_lineage.xlsx", tabs))
        nodes = {"FILE": stem}
        edges, groups = [], {}
        for r in sources_by_category(found).collect():
            n = writer.node_name(f"{r['category']}_{r['source']}")
            nodes[n] = (r["source"] or "")[:60]
            groups.setdefault(r["category"], []).append(n)
            edges.append((n, "FILE", None))
        made.append(out / f"{stem}_lineage.mmd")
        made[-1].write_text(writer.mermaid(nodes, edges, groups, "LR"))
    found.unpersist()
    return made


def _by(rows: list, key: str) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
