"""Upstream tracing: vectors of a model sheet against other files, and formula levels."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs as X
from ..operators import formula_refs as R
from ..operators import vectors as V
from ..operators.graph import cut
from ..sources import settings
from ..sources import workbook as W
from .detect import vectors


@dataclass(frozen=True)
class TraceConfig:
    exact: bool = True
    approximate: bool = True
    top_n: int = 5
    decimal_places: int = 8
    subsequence: bool = True
    metric: str = "pearson"
    min_similarity: float = 0.8
    length_tolerance: float = 0.5
    direction_sensitive: bool = False
    min_length: int = 3

    @classmethod
    def from_text(cls, text: str) -> TraceConfig:
        """Settings in JSON or YAML by name, at the top or in ``matching`` and ``performance``;
        others are ignored."""
        got = settings.read(text)
        flat = got | (got.get("matching") or {}) | (got.get("performance") or {})
        return cls(**{k: flat[k] for k in asdict(cls()) if k in flat})


def match(model: DataFrame, upstream: DataFrame, config: TraceConfig = TraceConfig()) -> tuple[DataFrame, DataFrame]:
    """(matches with ranks, model vectors without any): both sides as made by ``vectors``."""
    key = F.xxhash64("file", "sheet", "direction", "cell_range")
    m = cut(model.withColumn("vid", key))
    u = cut(upstream.withColumn("vid", key))
    cols = ["model_id", "up_id", "offset", "similarity", "match_type"]
    found = m.select(F.col("vid").alias("model_id"), F.lit(0).cast("long").alias("up_id"), F.lit(0).alias("offset"), F.lit(0.0).alias("similarity"), F.lit("").alias("match_type")).where("false")
    if config.exact:
        e = V.exact_matches(m, u, places=config.decimal_places)
        found = found.union(e.select(F.col("vid").alias("model_id"), F.col("up_vid").alias("up_id"), F.lit(0).alias("offset"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("match_type")))
        if config.subsequence:
            side = lambda d: d.select("vid", "direction", "values")
            s = V.contained_matches(side(m), side(u), head=min(config.min_length, 3), places=config.decimal_places)
            if config.direction_sensitive:
                s = s.where(F.col("direction") == F.col("up_direction"))
            found = found.union(s.select(F.col("vid").alias("model_id"), F.col("up_vid").alias("up_id"), "offset", F.lit(1.0).alias("similarity"), F.lit("exact_subsequence").alias("match_type")))
    exact = cut(found)
    if config.approximate:
        same = V.similar(m, u, "vid", "values", config.metric, config.min_similarity).select("model_id", "up_id", F.lit(0).alias("offset"), "similarity")
        other = V.best_window(m, u, config.metric, config.min_similarity, config.length_tolerance, config.min_length).select("model_id", "up_id", "offset", "similarity")
        near = same.unionByName(other).join(exact.select("model_id", "up_id"), ["model_id", "up_id"], "left_anti")
        if config.direction_sensitive:
            side = lambda d, n: d.select(F.col("vid").alias(n), F.col("direction").alias(f"d_{n}"))
            near = near.join(side(m, "model_id"), "model_id").join(side(u, "up_id"), "up_id").where("d_model_id = d_up_id")
        near = V.rank_matches(near, "model_id", [F.desc("similarity"), F.col("up_id")], config.top_n, "near_rank")
        exact = exact.unionByName(near.withColumn("match_type", F.lit("approximate")).select(*cols))
    name = lambda d, p: d.select(F.col("vid").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("file", "sheet", "direction", "cell_range", "r1", "c1", "length")])
    rows = exact.join(name(m, "model"), "model_id").join(name(u, "up"), "up_id").withColumn("similarity", F.bround("similarity", 6))
    part = X.sub_range(F.col("up_direction"), F.col("up_r1"), F.col("up_c1"), F.col("offset"), F.least("model_length", "up_length"))
    rows = rows.withColumn("matched_range", F.when(F.col("up_length") > F.col("model_length"), part).otherwise(F.col("up_cell_range")))
    order = [F.col("match_type") == "approximate", F.desc("similarity"), F.col("up_file"), F.col("up_sheet"), F.col("up_cell_range"), F.col("offset")]
    ranked = cut(V.rank_matches(rows, "model_id", order))
    return ranked.drop("model_id", "up_id"), V.unmatched(m, ranked, "vid", "model_id").drop("vid")


def trace(model_book: DataFrame, sheet: str, upstream_books: DataFrame, config: TraceConfig = TraceConfig()) -> tuple[DataFrame, DataFrame]:
    model = vectors(W.hardcoded(W.cells(model_book, [sheet])), config.min_length)
    return match(model, vectors(W.all_numbers(W.cells(upstream_books)), config.min_length), config)


REFS = "file string, sheet string, cell string, formula string, target_file string, target_sheet string, target string, target_path string, ref_type string, chain array<struct<sheet:string,cell:string,formula:string>>"


def external_refs(books: DataFrame, walk: bool = False) -> DataFrame:
    """External references of each formula cell; with ``walk`` also those that its precedents
    in the workbook have, with the chain. A cell with a direct reference is not walked."""

    def rows(file: str, book: W.Book):
        links = {k: v[0] for k, v in book.link_targets().items()}
        strings = []
        formulas = {(s, c[0]): c[5] for s, part, _ in book.sheets() for c in book.cells(part, strings) if c[5]}
        for (s, cell), f in formulas.items():
            direct = R.external_refs(f, links)
            for x in direct:
                yield (file, s, cell, f, x[0], x[1], x[2], x[3], x[4], [])
            if walk and not direct:
                for x, chain in R.walk(s, cell, formulas, links):
                    yield (file, s, cell, f, x[0], x[1], x[2], x[3], x[4], [{"sheet": a, "cell": b, "formula": c} for a, b, c in chain])

    return W.each(books, REFS, rows)


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def file_listing(books: DataFrame) -> DataFrame:
    """(file, folder): the workbooks that references may lead to."""
    return books.select("file").distinct().withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))


def resolved_files(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """``refs`` with ``found`` and ``resolved_path``: a file of that name in the upper folder, else
    one in it whose name differs in case only, else one in a folder below; only the last part of
    the reference's path counts. The upper folder is the shortest one."""
    top = F.min(F.struct(F.length("folder"), "folder"))["folder"]
    upper = listing.agg(top.alias("top")).first()["top"]
    places = listing.select(F.lower(base_name("file")).alias("place_name"), base_name("file").alias("exact_name"), "file", (F.col("folder") != F.lit(upper or "")).alias("below"))
    names = refs.select(base_name("target_file").alias("asked")).distinct()
    phase = F.when(~F.col("below") & (F.col("asked") == F.col("exact_name")), 0).when(~F.col("below"), 1).otherwise(2)
    hits = names.join(places, F.lower("asked") == F.col("place_name")).groupBy("asked").agg(F.min(F.struct(phase.alias("phase"), "file")).alias("hit"))
    hits = hits.select(F.col("asked").alias("hit_name"), F.col("hit.file").alias("resolved_path"))
    return refs.drop("found", "resolved_path").join(hits, base_name("target_file") == F.col("hit_name"), "left").drop("hit_name").withColumn("found", F.col("resolved_path").isNotNull())


def resolved_names(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References by name with what the name stands for in the file that was found: one that leads
    to another workbook, else the name of the sheet that qualifies it, else that of the workbook,
    else the first of other sheets, else a table; ``name_kind`` is null if there is none."""
    t = targets.select(F.col("file").alias("t_file"), F.col("name").alias("t_name"), "seq", "kind", "scope", F.col("sheet").alias("t_sheet"), "cell_range", "other_file")
    asked = refs.where("found AND ref_type <> 'cell'").select("resolved_path", "target", "target_sheet").distinct()
    scoped = (F.col("target_sheet") != "") & (F.lower("scope") == F.lower("target_sheet"))
    order = F.when(F.col("kind") == "external", 0).when(F.col("kind") == "table", 4).when(scoped, 1).when(F.col("scope").isNull(), 2).otherwise(3)
    met = asked.join(t, (F.col("resolved_path") == F.col("t_file")) & (F.lower("target") == F.col("t_name")))
    best = met.groupBy("resolved_path", "target", "target_sheet").agg(F.min(F.struct(order.alias("pos"), "seq", "kind", "t_sheet", "cell_range", "other_file")).alias("b"))
    best = best.select(F.col("resolved_path").alias("n_path"), F.col("target").alias("n_target"), F.col("target_sheet").alias("n_sheet"), F.col("b.kind").alias("name_kind"), F.col("b.t_sheet").alias("name_sheet"), F.col("b.cell_range").alias("name_range"), F.col("b.other_file").alias("name_file"))
    same = (F.col("resolved_path") == F.col("n_path")) & (F.col("target") == F.col("n_target")) & (F.col("target_sheet") == F.col("n_sheet")) & (F.col("ref_type") != "cell")
    return refs.join(best, same, "left").drop("n_path", "n_target", "n_sheet")


def levels(books: DataFrame, model: str, max_level: int = 10) -> DataFrame:
    """Level-numbered external references: level 1 is all of the model's own, the next level
    those cells of each found file that the level before referred to, with their precedents.

    A file is entered once, by lower-case name. Cells are filtered by the rectangles referred to.
    A name or table stands for its rectangle; one that leads to yet another workbook gives a
    reference of the next level; a file with a name that cannot be resolved, or with no rectangle
    at all, is scanned whole, for direct references only.
    """
    listing, targets = cut(file_listing(books)), cut(W.name_targets(books))
    direct = cut(external_refs(books))
    deep = cut(external_refs(books, walk=True))
    name = lambda c: F.lower(base_name(c))
    now = direct.where(name("file") == model.lower())
    seen = listing.sparkSession.createDataFrame([(model.lower(),)], "seen string")
    out = None
    for level in range(1, max_level + 1):
        placed = resolved_files(now, listing).withColumn("level", F.lit(level))
        fresh = placed.join(seen, name("target_file") == F.col("seen"), "left").withColumn("fresh", F.col("seen").isNull()).drop("seen")
        named = cut(resolved_names(fresh, targets))
        far = F.concat("target", F.lit(" → ["), "name_file", F.lit("]"), "name_sheet", F.lit("!"), "name_range")
        near = F.concat("target", F.lit(" → "), "name_range")
        known = F.col("fresh") & F.col("name_kind").isNotNull()
        shown = named.withColumn("shown", F.when(~known | (F.col("ref_type") == "cell"), F.col("target")).when(F.col("name_kind") == "external", far).when(F.col("name_kind") == "dynamic", F.concat("target", F.lit(" (dynamic)"))).otherwise(near))
        shown = shown.withColumn("target_sheet", F.when(known & (F.col("ref_type") != "cell"), F.coalesce("name_sheet", F.lit(""))).otherwise(F.col("target_sheet")))
        kind = F.when(known & (F.col("name_kind") == "table"), "table").when(known, "named_range").otherwise(F.col("ref_type"))
        rows = shown.withColumn("ref_type", F.when(F.col("ref_type") == "cell", "cell").otherwise(kind)).drop("target", "fresh", "name_kind", "name_sheet", "name_range", "name_file").withColumnRenamed("shown", "target")
        out = rows if out is None else out.unionByName(rows)
        ask = cut(named.where("found AND fresh"))
        if level == max_level or ask.isEmpty():
            break
        seen = cut(seen.union(ask.select(name("target_file"))).distinct())
        by_cell = (F.col("ref_type") == "cell") | F.col("name_kind").isin("local", "table")
        pick = lambda a, b: F.when(F.col("ref_type") == "cell", F.col(a)).otherwise(F.col(b))
        boxes = ask.where(by_cell).select("resolved_path", F.lower(pick("target_sheet", "name_sheet")).alias("to_sheet"), X.rect(pick("target", "name_range")).alias("box")).distinct()
        unsure = (F.col("ref_type") != "cell") & (F.col("name_kind").isNull() | (F.col("name_kind") == "dynamic"))
        whole = ask.groupBy("resolved_path").agg(F.max(unsure).alias("unsure"), F.max(by_cell).alias("some")).where("unsure OR NOT some").select(F.col("resolved_path").alias("whole_path"))
        inside = (F.lower("sheet") == F.col("to_sheet")) & X.contains(F.col("box"), X.ref_row(F.col("cell")), X.ref_col(F.col("cell")))
        part = deep.join(whole, F.col("file") == F.col("whole_path"), "left_anti").join(boxes, (F.col("file") == F.col("resolved_path")) & inside, "left_semi")
        entire = direct.join(whole, F.col("file") == F.col("whole_path"), "left_semi")
        redirect = ask.where("name_kind = 'external'").select(
            F.col("resolved_path").alias("file"), F.lit("").alias("sheet"), F.concat(F.lit("(definedName:"), "target", F.lit(")")).alias("cell"), F.concat(F.lit("definedName="), "target").alias("formula"), F.col("name_file").alias("target_file"),
            F.coalesce("name_sheet", F.lit("")).alias("target_sheet"), F.col("name_range").alias("target"), F.col("name_file").alias("target_path"),
            F.when(F.col("name_range").rlike(r"^\$?[A-Za-z]{1,3}\$?[0-9]+(:|$)"), "cell").otherwise("named_range").alias("ref_type"), F.array().cast(deep.schema["chain"].dataType).alias("chain"),
        ).distinct()
        now = part.unionByName(entire).unionByName(redirect)
    return out


def level_diagram(refs: DataFrame, direction: str = "TD") -> str:
    """Level rows as a diagram: a subgraph per file, an edge per pair of sheets with its cells."""
    from ..functions import text
    from ..sources import writer

    edges = refs.groupBy("level", "file", "sheet", "target_file", "target_sheet", "found").agg(F.collect_set("cell").alias("cells"))
    rows = edges.select("*", text.cells_label(F.col("cells")).alias("label")).orderBy("level", "file", "sheet", "target_file", "target_sheet").collect()
    nodes, groups, out = {}, {}, []
    for r in rows:
        ends = []
        for file, sheet in ((R.file_of(r["file"]), r["sheet"]), (r["target_file"], r["target_sheet"])):
            n = writer.node_name(f"{file}_{sheet}")
            nodes[n] = sheet or file
            if n not in groups.setdefault(file, []):
                groups[file].append(n)
            ends.append(n)
        out.append((*ends, f"L{r['level']}: {r['label']}" + ("" if r["found"] else " (missing)")))
    return writer.mermaid(nodes, out, groups, direction)
