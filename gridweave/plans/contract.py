"""Business contract: variables, transformations, dependency edges, SQL text, generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as FX
from ..functions import refs, text
from ..operators import formula_refs as R
from ..operators.graph import cut, depth_levels
from ..operators.tables import first_wins, overlapping_boxes
from ..operators.vectors import whole_group_runs
from ..sources import workbook as W
from ..sources import writer
from .detect import vectors

_ID = ("sheet", "cell_range")


def variables(books: DataFrame, output_sheets: list[str]) -> DataFrame:
    """One row per place: named ranges, hardcoded vectors, formula vectors and formula cells.

    Equal places merge and keep the name; output wins over input, input over intermediate.
    """
    cells = cut(W.cells(books))
    hard = vectors(W.hardcoded(cells)).select("file", "sheet", "cell_range", "direction", F.lit("hardcoded").alias("source_type"))
    f = W.formulas(cells).select("file", "sheet", "row", "col", "ref")
    down = whole_group_runs(f, ["file", "sheet", "col"], "row").select("file", "sheet", refs.sub_range(F.lit("column"), F.col("first_idx"), F.col("col"), F.lit(0), F.col("length")).alias("cell_range"), F.lit("column").alias("direction"))
    across = whole_group_runs(f, ["file", "sheet", "row"], "col").select("file", "sheet", refs.sub_range(F.lit("row"), F.col("row"), F.col("first_idx"), F.lit(0), F.col("length")).alias("cell_range"), F.lit("row").alias("direction"))
    lines = cut(down.unionByName(across))
    boxes = lines.select(F.col("file").alias("bf"), F.col("sheet").alias("bs"), refs.rect(F.col("cell_range")).alias("box"))
    single = f.join(boxes, (F.col("file") == F.col("bf")) & (F.col("sheet") == F.col("bs")) & refs.contains(F.col("box"), F.col("row"), F.col("col")), "left_anti")
    made = lines.withColumn("source_type", F.lit("formula")).unionByName(single.select("file", "sheet", F.col("ref").alias("cell_range"), F.lit("scalar").alias("direction"), F.lit("formula").alias("source_type")))
    named = W.names(books).where(F.col("sheet").isNotNull() & ~F.col("hidden") & ~F.col("is_dynamic") & ~F.col("name").startswith("_xlnm"))
    ends = F.split("cell_range", ":")
    one = F.when(F.get(ends, F.lit(0)) == F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).otherwise(F.col("cell_range"))
    named = named.select("file", "sheet", one.alias("cell_range"), "name")
    both = hard.unionByName(made).join(named, ["file", *_ID], "full")
    kind = F.when(F.col("sheet").isin(*output_sheets), "output").when(F.coalesce("source_type", F.lit("hardcoded")) == "hardcoded", "input").otherwise("intermediate")
    both = both.withColumn("variable_type", kind).withColumn("variable_id", F.substring(F.sha2(F.concat_ws("|", "file", *_ID), 256), 1, 12))
    fallback = text.python_name(F.concat_ws("_", *_ID))
    both = both.withColumn("business_name", F.coalesce("name", fallback)).withColumn("direction", F.coalesce("direction", F.lit("range")))
    return first_wins(both, ["file", *_ID], ["source_type", "direction"])


def transformations(books: DataFrame, found: DataFrame) -> DataFrame:
    """Each formula variable's first formula, its SQL text, and the variables that it reads."""
    found = cut(found)
    cells = W.formulas(W.cells(books)).select("file", "sheet", "row", "col", "ref", "formula")
    v = found.where("source_type = 'formula'").select("file", "sheet", "variable_id", "business_name", refs.rect(F.col("cell_range")).alias("box"))
    at = F.struct(F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    v = v.withColumnsRenamed({"file": "v_file", "sheet": "v_sheet"})
    inside = overlapping_boxes(cells.withColumn("at", at), v, [("file", "v_file"), ("sheet", "v_sheet")], ("at", "box"))
    first = cut(first_wins(inside.select("variable_id", "business_name", "file", "sheet", "row", "col", "formula"), ["variable_id"], ["row", "col"]))
    names = found.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("sheet", F.lit("!"), "cell_range"), "business_name"))).alias("names"))

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            ids, files, sheets, fs, maps = (b.column(c).to_pylist() for c in ("variable_id", "file", "sheet", "formula", "names"))
            out = {"variable_id": ids, "file": files, "formula": fs, "sql_formula": [], "reads": []}
            for s, f, m in zip(sheets, fs, maps, strict=True):
                out["sql_formula"].append(FX.to_sql(f, dict(m or [])))
                out["reads"].append([{"sheet": a, "cell_range": c} for a, c in R.inner_refs(f, s)])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("variable_id", pa.string()), ("file", pa.string()), ("formula", pa.string()), ("sql_formula", pa.string()), ("reads", pa.list_(pa.struct([("sheet", pa.string()), ("cell_range", pa.string())])))]))

    return first.join(names, "file").select("variable_id", "file", "sheet", "formula", "names").mapInArrow(rows, "variable_id string, file string, formula string, sql_formula string, reads array<struct<sheet:string,cell_range:string>>")


def dependency_edges(steps: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst): the variables whose cells a transformation reads, by overlap on one sheet."""
    r = steps.select("file", F.col("variable_id").alias("dst"), F.explode("reads").alias("r")).select("file", "dst", F.col("r.sheet").alias("sheet"), refs.rect(F.col("r.cell_range")).alias("a"))
    v = found.select(F.col("file").alias("v_file"), F.col("sheet").alias("v_sheet"), F.col("variable_id").alias("src"), refs.rect(F.col("cell_range")).alias("b"))
    return overlapping_boxes(r, v, [("file", "v_file"), ("sheet", "v_sheet")], ("a", "b")).where("src <> dst").select("src", "dst").distinct()


def contract(books: DataFrame, output_sheets: list[str]) -> dict[str, DataFrame]:
    found = cut(variables(books, output_sheets))
    steps = cut(transformations(books, found))
    return {"variables": found, "transformations": steps, "edges": cut(dependency_edges(steps, found))}


def link_upstream(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Variables with the last overlapping match of their place."""
    m = matches.select(F.col("model_sheet").alias("m_sheet"), refs.rect(F.col("model_cell_range")).alias("a"), "up_file", "up_sheet", "matched_range", "match_type", "rank")
    v = found.withColumn("b", refs.rect(F.col("cell_range")))
    hit = overlapping_boxes(v, m, [("sheet", "m_sheet")], ("b", "a"))
    best = hit.groupBy("variable_id").agg(F.max_by(F.struct("up_file", "up_sheet", "matched_range", "match_type"), F.struct("rank", "up_file", "up_sheet", "matched_range")).alias("upstream"))
    return found.join(best, "variable_id", "left")


def variable_diagram(tables: dict[str, DataFrame]) -> str:
    v = tables["variables"].orderBy("sheet", "cell_range").collect()
    nodes = {f"V_{r['variable_id']}": r["business_name"] for r in v}
    groups: dict[str, list[str]] = {}
    for r in v:
        groups.setdefault(r["sheet"], []).append(f"V_{r['variable_id']}")
    edges = [(f"V_{r['src']}", f"V_{r['dst']}", None) for r in tables["edges"].orderBy("src", "dst").collect()]
    return writer.mermaid(nodes, edges, groups, "LR")


def python_code(tables: dict[str, DataFrame]) -> str:
    """A stub function for each transformation, inputs before what uses them."""
    level = depth_levels(tables["edges"]) if not tables["edges"].isEmpty() else None
    steps = tables["transformations"].join(tables["variables"].select("variable_id", "business_name"), "variable_id")
    steps = steps.join(level.withColumnRenamed("node", "variable_id"), "variable_id", "left") if level is not None else steps.withColumn("level", F.lit(0))
    args = tables["edges"].join(tables["variables"].select(F.col("variable_id").alias("src"), F.col("business_name").alias("arg")), "src").groupBy(F.col("dst").alias("variable_id")).agg(F.array_sort(F.collect_set("arg")).alias("args"))
    rows = steps.join(args, "variable_id", "left").orderBy(F.coalesce("level", F.lit(0)), "business_name").collect()
    name = lambda x: writer.node_name(x.lower(), "") if not x[:1].isdigit() else "v_" + x
    out = ['"""Generated from spreadsheet formulas."""', ""]
    for r in rows:
        out += ["", f"def {name(r['business_name'])}({', '.join(name(a) for a in r['args'] or [])}):", f'    """={(r["formula"] or "").replace(chr(34), chr(39))}"""', f"    # {r['sql_formula']}", "    raise NotImplementedError", ""]
    return "\n".join(out)
