"""Report workbooks and summaries of the programs' tables.

A report is read by people: its tables are the programs' result rows, which are small next to the
cells that they come from. Tables for machines are written with ``DataFrame.write``.
"""

from __future__ import annotations

from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.tables import first_wins
from ..sources import workbook as W
from ..sources import writer
from .trace import TraceConfig


def upstream_sources(matches: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Per upstream file: how it was found, best kind of match, sheets, at most five ranges, and
    the first level at which formulas refer to it."""
    hit = matches.groupBy(F.col("up_file").alias("source")).agg(
        F.when(F.max(F.col("match_type") != "approximate"), "exact").otherwise("approximate").alias("best_match"),
        F.array_sort(F.collect_set("up_sheet")).alias("sheets"), F.slice(F.array_sort(F.collect_set("matched_range")), 1, 5).alias("ranges"), F.count("*").alias("n_matches"),
    )
    if refs is None:
        return hit.withColumn("first_level", F.lit(None).cast("int"))
    base = F.lower(F.element_at(F.split("source", r"[\\/]"), -1))
    level = refs.groupBy(F.lower("target_file").alias("target")).agg(F.min("level").alias("first_level"), F.array_sort(F.collect_set("target_sheet")).alias("level_sheets"))
    both = hit.withColumn("base", base).join(level, F.col("base") == F.col("target"), "full")
    return both.select(F.coalesce("source", "target").alias("source"), "best_match", F.coalesce("sheets", "level_sheets").alias("sheets"), "ranges", "n_matches", "first_level")


def trace_summary(matches: DataFrame, unmatched: DataFrame) -> dict[str, int]:
    got = matches.agg(F.count_if(F.col("match_type") == "exact").alias("exact"), F.count_if(F.col("match_type") == "exact_subsequence").alias("subsequence"), F.count_if(F.col("match_type") == "approximate").alias("approximate"), F.countDistinct("model_sheet", "model_cell_range").alias("matched_vectors")).first()
    return got.asDict() | {"unmatched_vectors": unmatched.count()}


def _rows(df: DataFrame, order: list[str]) -> tuple[list[str], list[list]]:
    plain = df.select(*[F.to_json(c).alias(c) if kind.startswith(("struct", "map", "array<struct")) else F.array_join(F.col(c).cast("array<string>"), ", ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
    keys = [c for c in order if c in plain.columns]
    return plain.columns, [list(r) for r in (plain.orderBy(*keys) if keys else plain).collect()]


def trace_report(path: str | Path, config: TraceConfig, matches: DataFrame, unmatched: DataFrame, refs: DataFrame | None = None, model: str = "") -> Path:
    """Config, Upstream Sources, Tracing Results, and a sheet for each level."""
    summary = trace_summary(matches, unmatched)
    tabs: dict = {"Config": (["setting", "value"], [[k, str(v)] for k, v in ({"model_file": model} | asdict(config) | summary).items()])}
    tabs["Upstream Sources"] = _rows(upstream_sources(matches, refs), ["source"])
    results = matches.unionByName(unmatched.select(F.col("file").alias("model_file"), F.col("sheet").alias("model_sheet"), F.col("cell_range").alias("model_cell_range"), F.lit("unmatched").alias("match_type")), allowMissingColumns=True)
    tabs["Tracing Results"] = _rows(results, ["model_sheet", "model_cell_range", "rank"])
    if refs is not None:
        shown = refs.withColumn("chain", text.chain_text(F.col("chain")))
        for level in [r[0] for r in refs.select("level").distinct().orderBy("level").collect()]:
            tabs[f"Level {level}"] = _rows(shown.where(F.col("level") == level), ["file", "sheet", "cell"])
    return writer.write_report(path, tabs)


def read_levels(report: DataFrame) -> DataFrame:
    """The references on the ``Level N`` sheets of trace reports, by their header row, as
    ``level_diagram`` takes them."""
    level = F.regexp_extract("sheet", r"^Level (\d+)$", 1).try_cast("int")
    grid = W.cells(report).where("sheet RLIKE '^Level [0-9]+$'").select("file", level.alias("level"), "row", "col", F.coalesce("text_value", F.col("num_value").cast("string")).alias("v"))
    head = grid.where("row = 1").select(F.col("file").alias("h_file"), F.col("level").alias("h_level"), F.col("col").alias("h_col"), F.col("v").alias("title"))
    cells = grid.where("row > 1").join(head, (F.col("file") == F.col("h_file")) & (F.col("level") == F.col("h_level")) & (F.col("col") == F.col("h_col")))
    cols = ("file", "sheet", "cell", "target_file", "target_sheet", "target", "found")
    wide = cells.groupBy(F.col("file").alias("report"), "level", "row").pivot("title", list(cols)).agg(F.first("v"))
    text_of = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return wide.where("file IS NOT NULL").select("report", "level", *[text_of(c) for c in cols[:-1]], F.lower("found").isin("true", "yes", "1").alias("found"))


def report_model(report: DataFrame) -> DataFrame:
    """(report, model): the model's name on the Config sheet of trace reports."""
    c = W.cells(report, ["Config"]).select("file", "row", "col", "text_value")
    key = c.where("col = 1 AND text_value = 'model_file'").select("file", "row")
    return key.join(c.where("col = 2").withColumnRenamed("text_value", "model"), ["file", "row"]).select(F.col("file").alias("report"), "model")


def sources_summary(tables: dict[str, DataFrame]) -> dict[str, int]:
    refs = tables["formula_refs"].agg(
        F.count("*").alias("formula_refs"), F.countDistinct(F.lower("target_file")).alias("files"), F.countDistinct(F.when(F.col("found"), F.lower("target_file"))).alias("files_found"), F.max("level").alias("levels")
    ).first()
    return refs.asDict() | {name: df.count() for name, df in tables.items() if name != "formula_refs"}


def sources_report(path: str | Path, tables: dict[str, DataFrame]) -> Path:
    tabs: dict = {"Summary": (["what", "count"], [[k, v] for k, v in sources_summary(tables).items()])}
    for name, df in tables.items():
        tabs[name.replace("_", " ").title()] = _rows(df, ["level", "file", "missing", "sheet", "location", "item"])
    return writer.write_report(path, tabs)


def contract_report(path: str | Path, tables: dict[str, DataFrame]) -> Path:
    """Summary by type, variables, transformations and dependencies by name."""
    names = tables["variables"].select("variable_id", "business_name")
    by_type = tables["variables"].groupBy("variable_type").agg(F.count("*").alias("n"))
    named = lambda key: names.select(F.col("variable_id").alias(key), F.col("business_name").alias(f"{key}_name"))
    edges = tables["edges"].join(named("src"), "src", "left").join(named("dst"), "dst", "left").select(F.coalesce("src_name", "src").alias("source"), F.coalesce("dst_name", "dst").alias("target"))
    steps = tables["transformations"].join(names, "variable_id", "left").select("business_name", "formula", "sql_formula", "reads")
    return writer.write_report(path, {
        "Summary": _rows(by_type, ["variable_type"]), "Variables": _rows(tables["variables"], ["sheet", "cell_range"]),
        "Transformations": _rows(steps, ["business_name"]), "Dependencies": _rows(edges, ["source", "target"]),
    })


def source_diagram(tables: dict[str, DataFrame], connections: DataFrame, model: str) -> str:
    """External sources into the model's sheets, and from them to the output sheets."""
    nodes, groups, edges = {"MODEL": model}, {}, []
    firsts = first_wins(connections.where("category NOT IN ('input', 'metadata')").select("category", "source", "extractor"), ["category", "source"], ["extractor"])
    for r in firsts.orderBy("category", "source").collect():
        n = writer.node_name(f"{r['category']}_{r['source']}")
        nodes[n] = r["source"]
        groups.setdefault(r["category"], []).append(n)
        edges.append((n, "MODEL", None))
    for r in tables["variables"].where("variable_type = 'output'").select("sheet").distinct().orderBy("sheet").collect():
        n = writer.node_name(r["sheet"], "OUT_")
        nodes[n] = r["sheet"]
        edges.append(("MODEL", n, None))
    return writer.mermaid(nodes, edges, groups, "LR")
