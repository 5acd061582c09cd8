"""Raw sources of a model: the file dependency tree, missing files, and the extra scanners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extractors as E
from ..operators import formula_refs as R
from ..operators.graph import cut
from ..operators.tables import first_wins
from ..sources import workbook as W
from .detect import connections
from .trace import TraceConfig, base_name, external_refs, file_listing, resolved_files, trace

SKIPPED = ("input", "metadata", "hardcoded")


def file_refs(books: DataFrame, model: str, sheets: list[str], max_level: int = 5) -> DataFrame:
    """Level-numbered references from file to file: level 1 from the given sheets of the model
    (all, if none are given), the next levels from all sheets of each file found, once a file."""
    listing = cut(file_listing(books))
    direct = cut(external_refs(books).drop("chain"))
    name = lambda c: F.lower(base_name(c))
    now = direct.where(name("file") == model.lower())
    now = now.where(F.col("sheet").isin(*sheets)) if sheets else now
    seen = listing.sparkSession.createDataFrame([(model.lower(),)], "seen string")
    key = ["file", "sheet", "cell", F.lower("target_file").alias("k_file"), F.lower("target_sheet").alias("k_sheet"), F.upper("target").alias("k_target")]
    out = None
    for level in range(1, max_level + 1):
        placed = resolved_files(now, listing).withColumn("level", F.lit(level)).select("*", *key[3:])
        placed = cut(placed.dropDuplicates(["file", "sheet", "cell", "k_file", "k_sheet", "k_target"]).drop("k_file", "k_sheet", "k_target"))
        out = placed if out is None else out.unionByName(placed)
        fresh = cut(placed.where("found").select("resolved_path", name("target_file").alias("seen")).distinct().join(seen, "seen", "left_anti"))
        if level == max_level or fresh.isEmpty():
            break
        seen = cut(seen.union(fresh.select("seen")).distinct())
        now = direct.join(fresh.select("resolved_path").distinct(), F.col("file") == F.col("resolved_path"), "left_semi")
    return out


def source_files(refs: DataFrame, model: str) -> DataFrame:
    """(file_name, path, level): the model, and each file found with its first level."""
    name = F.lower(base_name("target_file"))
    found = refs.where("found").groupBy(name.alias("key")).agg(F.min(F.struct("level", base_name("target_file").alias("file_name"), F.col("resolved_path").alias("path"))).alias("x"))
    own = refs.sparkSession.createDataFrame([(model, None, 0)], "file_name string, path string, level int")
    return own.unionByName(found.where(F.col("key") != model.lower()).select("x.file_name", "x.path", "x.level"))


def missing_files(refs: DataFrame) -> DataFrame:
    """Files that are referred to but not there: first level and referrer, the sheets that are
    asked of them, and at most ten of the cells that ask."""
    gone = refs.where("NOT found")
    return gone.groupBy(F.lower("target_file").alias("missing")).agg(
        F.min("level").alias("first_level"), F.min_by(base_name("file"), F.struct("level", "file")).alias("first_referrer"), F.array_sort(F.collect_set(F.nullif("target_sheet", F.lit("")))).alias("sheets"),
        F.slice(F.array_sort(F.collect_set(F.concat("sheet", F.lit("!"), "cell"))), 1, 10).alias("cells"), F.countDistinct("file", "sheet", "cell").alias("n_cells"),
    )


def dynamic_refs(books: DataFrame) -> DataFrame:
    """INDIRECT calls whose argument is not a plain text reference."""
    f = W.formulas(W.cells(books), "INDIRECT(")
    plain = F.col("formula").rlike(r'(?i)INDIRECT\s*\(\s*"[^"]+"\s*[,)]')
    return f.where(~plain).select("file", "sheet", "ref", "formula", F.when(F.col("formula").contains("&"), "built from parts").otherwise("read from a cell").alias("note"))


def rtd_calls(books: DataFrame) -> DataFrame:
    f = W.formulas(W.cells(books), "RTD(")
    return f.select("file", "sheet", "ref", "formula", F.regexp_extract("formula", r'(?i)RTD\s*\(\s*"([^"]*)"', 1).alias("program"))


def phantom_links(books: DataFrame) -> DataFrame:
    """Registered external links that no formula uses."""
    used = external_refs(books).select(F.col("file").alias("user"), F.lower("target_file").alias("used"))
    rows = W.links(books).withColumn("link_file", F.lower(text.file_name(F.col("target"))))
    return rows.join(used, (F.col("file") == F.col("user")) & (F.col("link_file") == F.col("used")), "left_anti")


def part_refs(books: DataFrame) -> DataFrame:
    """References to other workbooks in charts and data validations."""

    def rows(file: str, book: W.Book):
        links = {k: v[0] for k, v in book.link_targets().items()}
        for where, formula, origin in E.other_formulas(book):
            for x in R.external_refs(formula, links):
                yield (file, where, origin, x[0], x[1], x[2])

    return W.each(books, "file string, location string, ref_origin string, target_file string, target_sheet string, target string", rows)


def scenarios(books: DataFrame) -> DataFrame:
    return W.each(books, "file string, sheet string, scenario string, cell string, value string", lambda f, b: ((f, *s) for s in E.scenarios(b)))


def binary_workbooks(spark, folder: str, refs: DataFrame) -> DataFrame:
    """Warnings for .xlsb files, which are not read: those in the folder and those referred to."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][bB]").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit("in folder").alias("why"))
    return there.unionByName(refs.where(F.lower("target_file").endswith(".xlsb")).select(F.col("target_file").alias("file"), F.lit("referred to").alias("why")).distinct())


def vector_context(found: DataFrame, books: DataFrame) -> DataFrame:
    """Vectors with the header in row 1 of their column and the label in column 1 of their row."""
    words = W.cells(books).where(F.col("text_value").isNotNull()).select("file", "sheet", "row", "col", "text_value")
    head = words.where("row = 1").select("file", "sheet", F.col("col").alias("c1"), F.col("text_value").alias("header"))
    side = words.where("col = 1").select("file", "sheet", F.col("row").alias("r1"), F.col("text_value").alias("label"))
    return found.join(head, ["file", "sheet", "c1"], "left").join(side, ["file", "sheet", "r1"], "left")


def required_inputs(refs: DataFrame, found: DataFrame) -> DataFrame:
    """Files by lower-case name, then connections, each once."""
    f = refs.select(F.lower("target_file").alias("item"), F.lit(0).alias("pos"), F.lit("file").alias("kind"))
    c = found.where(~F.col("category").isin(*SKIPPED)).select(F.lower("source").alias("item"), F.lit(1).alias("pos"), F.col("category").alias("kind"))
    return first_wins(f.unionByName(c), ["item"], ["pos", "kind"]).orderBy("pos", "item")


def detect_sources(books: DataFrame, model: str, sheets: list[str], max_level: int = 5, config: TraceConfig = TraceConfig(approximate=False, min_similarity=0.85)) -> dict[str, DataFrame]:
    """All tables of the raw-source report by name; ``model`` is the model's file name."""
    own = F.lower(F.element_at(F.split("file", "/"), -1)) == model.lower()
    refs = file_refs(books, model, sheets, max_level)
    mine, rest = books.where(own), books.where(~own)
    out = {"formula_refs": refs, "source_files": source_files(refs, model), "missing_files": missing_files(refs), "connections": connections(books)}
    parts = [trace(mine, s, rest, config) for s in sheets]
    for k, (m, u) in enumerate(parts):
        out["matched"] = m if k == 0 else out["matched"].unionByName(m)
        out["unmatched"] = u if k == 0 else out["unmatched"].unionByName(u)
    return out | {
        "required_inputs": required_inputs(refs, out["connections"]), "dynamic_refs": dynamic_refs(mine), "rtd_calls": rtd_calls(mine), "phantom_links": phantom_links(mine),
        "part_refs": part_refs(books), "scenarios": scenarios(books),
    }
