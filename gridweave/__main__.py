"""python -m gridweave COMMAND: detect, trace, levels, sources, contract, diagram, page."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (
        ("detect", ["file", "--json-only"]), ("trace", ["model", "--sheet", "--upstream-dir", "--config", "--list-sheets"]), ("levels", ["model", "--upstream-dir", "--max-level", "--lr"]),
        ("sources", ["model", "--sheets", "--inputs-dir", "--max-level", "--approximate"]), ("contract", ["model", "--output-sheets"]), ("diagram", ["file"]), ("page", ["file"]),
    ):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a, **({"action": "store_true"} if a in ("--json-only", "--list-sheets", "--lr", "--approximate") else {}))
        s.add_argument("--out-dir", default="output")
    a = p.parse_args(argv)
    out = Path(a.out_dir)
    out.mkdir(parents=True, exist_ok=True)
    if a.command == "page":
        from .plans.sheet_graph import page_of

        (out / f"{Path(a.file).stem}.html").write_text(page_of(Path(a.file).read_text()))
        return 0
    from .plans import contract, detect, raw_sources, reports, sheet_graph, trace
    from .sources import workbook as W

    spark = SparkSession.builder.appName("gridweave").getOrCreate()
    path = str(Path(getattr(a, "file", None) or a.model).resolve())
    mine, stem = W.files(spark, path), Path(path).stem
    if a.command == "detect":
        print(*detect.report(mine, out, stem, a.json_only), sep="\n")
    elif a.command == "trace":
        if a.list_sheets or not a.sheet:
            W.sheets(mine).orderBy("sheet_idx").show(1000, False)
            return 0
        config = trace.TraceConfig.from_text(Path(a.config).read_text()) if a.config else trace.TraceConfig()
        found, none = trace.trace(mine, a.sheet, W.files(spark, a.upstream_dir).where(f"file NOT LIKE '%{Path(path).name}'"), config)
        found.write.mode("overwrite").parquet(str(out / f"{stem}_matches"))
        none.write.mode("overwrite").parquet(str(out / f"{stem}_unmatched"))
        print(reports.trace_report(out / f"{stem}_trace.xlsx", config, found, none, model=Path(path).name))
    elif a.command == "levels":
        refs = trace.levels(mine.union(W.files(spark, a.upstream_dir)).dropDuplicates(["file"]), Path(path).name, int(a.max_level or 10))
        (out / f"{stem}_levels.mmd").write_text(trace.level_diagram(refs, "LR" if a.lr else "TD"))
    elif a.command == "sources":
        tables = raw_sources.detect_sources(mine.union(W.files(spark, a.inputs_dir, True)).dropDuplicates(["file"]), Path(path).name, (a.sheets or "").split(",") if a.sheets else [], int(a.max_level or 5), trace.TraceConfig(approximate=a.approximate, min_similarity=0.85))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(out / f"{stem}_{name}"))
        print(reports.sources_report(out / f"{stem}_sources.xlsx", tables))
    elif a.command == "contract":
        tables = contract.contract(mine, (a.output_sheets or "").split(","))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(out / f"{stem}_{name}"))
        print(reports.contract_report(out / f"{stem}_contract.xlsx", tables))
        (out / f"{stem}_sources.mmd").write_text(reports.source_diagram(tables, detect.connections(mine), stem))
        (out / f"{stem}_variables.mmd").write_text(contract.variable_diagram(tables))
        (out / f"{stem}_calculation.py").write_text(contract.python_code(tables))
    else:
        text, page = sheet_graph.build(mine)
        (out / f"{stem}.mmd").write_text(text)
        (out / f"{stem}.html").write_text(page)
    return 0


if __name__ == "__main__":
    sys.exit(main())
