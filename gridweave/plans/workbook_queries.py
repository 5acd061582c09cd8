"""Readers, extractors and lineage programs over workbooks that are written from the tables.

``workbook_fixture`` says what the workbooks hold; the SQL says, from the tables alone, what is
to be found in them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import workbook as W
from . import cell_tools, contract, detect, raw_sources, reports, sheet_graph, trace
from .registry import query
from .workbook_fixture import books

_B = """WITH c AS (SELECT *, c_nationkey AS k, c_custkey // 5000 AS blk, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 5000 ORDER BY c_custkey) AS i FROM customer),
b AS (SELECT k, blk, '/books/n' || k || '_' || blk || '.xlsx' AS file, n_regionkey AS r, count(*) AS m, sum(c_acctbal) AS total, sum(c_custkey % 5) AS codes FROM c JOIN nation ON n_nationkey = k GROUP BY ALL),
w AS (SELECT n_nationkey AS k, n_regionkey AS r, '/books/region_' || n_regionkey || '.xlsx' AS region FROM nation)"""


def own(df, col="file"):
    """Rows of the customers' workbooks."""
    return df.where(F.col(col).rlike(r"/n\d+_\d+\.xlsx$"))


def rounded(c, n=4):
    return F.round(c, n)


# --- readers ---------------------------------------------------------------------------------


@query(_B + " SELECT file, CAST(o - 1 AS INTEGER) AS sheet_idx, s AS sheet, false AS hidden FROM b, (SELECT unnest(['Inputs', 'Notes', 'Calc', 'Links', 'Summary', 'Empty']) AS s, unnest(range(1, 7)) AS o)")
def book_sheets(t):
    return own(W.sheets(books(t))).select("file", "sheet_idx", "sheet", "hidden")


@query(_B + """ SELECT file, 'Inputs' AS sheet, 3 * m + 4 AS n_cells, 2 * m AS n_numbers, m + 4 AS n_texts, 0 AS n_formulas FROM b UNION ALL SELECT file, 'Notes', 9, 4, 5, 0 FROM b UNION ALL SELECT file, 'Calc', m + 1, m, 1, m FROM b
UNION ALL SELECT file, 'Links', 8, 0, 0, 8 FROM b UNION ALL SELECT file, 'Summary', 2, 0, 0, 2 FROM b""")  # fmt: skip
def book_cells(t):
    c = own(W.cells(books(t)))
    return c.groupBy("file", "sheet").agg(F.count("*").alias("n_cells"), F.count("num_value").alias("n_numbers"), F.count("text_value").alias("n_texts"), F.count_if("has_formula").alias("n_formulas"))


@query(_B + """ SELECT file, 'Inputs' AS sheet, round(total + codes, 4) AS total, 2 * m AS n FROM b UNION ALL SELECT file, 'Notes', round(0.5 + k + 7 + 0.25 + 3, 4), 4 FROM b""")
def book_hardcoded_numbers(t):
    return own(W.hardcoded(W.cells(books(t)))).groupBy("file", "sheet").agg(rounded(F.sum("num_value")).alias("total"), F.count("*").alias("n"))


@query(_B + " SELECT file, 'Calc' AS sheet, 'A' || (i + 1) AS ref, 'Inputs!B' || (i + 1) || '*2' AS formula, 2 * c_acctbal AS value FROM c JOIN b USING (k, blk)")
def book_formula_values(t):
    """Formulas with their stored values on selected sheets; the others are not parsed."""
    f = W.formulas(W.cells(books(t), ["Calc"]))
    return f.select("file", "sheet", "ref", "formula", F.col("num_value").alias("value"))


@query(_B + """ SELECT file, 'Links' AS sheet, 'A4' AS ref, 'RTD("feed.' || k || '",,"T")' AS formula, 'feed.' || k AS program FROM b""")
def book_rtd_calls(t):
    return own(raw_sources.rtd_calls(books(t))).select("file", "sheet", "ref", "formula", "program")


@query(_B + """ SELECT file, 'Links' AS sheet, 'A3' AS ref, 'built from parts' AS note FROM b""")
def book_dynamic_refs(t):
    return own(raw_sources.dynamic_refs(books(t))).select("file", "sheet", "ref", "note")


@query(_B + """, n AS (SELECT file, 'TaxRate' AS name, 'Notes!$B$2' AS value, NULL AS scope, 'Notes' AS sheet, 'B2' AS cell_range, false AS is_dynamic FROM b UNION ALL SELECT file, 'Balances', 'Inputs!$B$2:$B$' || (m + 1), NULL, 'Inputs', 'B2:B' || (m + 1), false FROM b
UNION ALL SELECT file, 'Outside', '''[budget_' || k || '.xlsx]Plan''!$A$1', NULL, NULL, NULL, false FROM b UNION ALL SELECT file, '_xlnm.Print_Area', 'Inputs!$A$1', 'Inputs', 'Inputs', 'A1', false FROM b UNION ALL SELECT file, 'Dyn', 'OFFSET(Inputs!$A$1,0,0,3,1)', NULL, NULL, NULL, true FROM b)
SELECT * FROM n""")  # fmt: skip
def book_names(t):
    return own(W.names(books(t))).select("file", "name", "value", "scope", "sheet", "cell_range", "is_dynamic")


@query(_B + """ SELECT DISTINCT region AS file, u.* FROM w, (VALUES ('budget', 'local', 'Old', 'Old', 'A1'), ('budget', 'local', NULL, 'Data', 'B2:B4'), ('facts', 'table', NULL, 'Data', 'A1:B26')) u(name, kind, scope, sheet, cell_range)
UNION ALL SELECT file, 'taxrate', 'local', NULL, 'Notes', 'B2' FROM b UNION ALL SELECT file, 'balances', 'local', NULL, 'Inputs', 'B2:B' || (m + 1) FROM b UNION ALL SELECT file, 'outside', 'external', NULL, 'Plan', 'A1' FROM b
UNION ALL SELECT file, 'dyn', 'dynamic', NULL, NULL, 'A1,0,0,3,1)' FROM b""")  # fmt: skip
def book_name_targets(t):
    return W.name_targets(books(t)).select("file", "name", "kind", "scope", "sheet", "cell_range")


@query(_B + """ SELECT file, 1 AS link_idx, 'region_' || r || '.xlsx' AS target FROM b UNION ALL SELECT file, 2, 'https://acme.sharepoint.com/plan%20' || k || '.xlsx' FROM b UNION ALL SELECT file, 3, 'file:///C:/old/unused_' || k || '.xlsx' FROM b""")
def book_links(t):
    return own(W.links(books(t))).select("file", "link_idx", "target")


@query(_B + """ SELECT file, 'xl/worksheets/sheet4.xml' AS part, 'rId1' AS rid, 'https://links.org/' || k AS target, 'External' AS mode FROM b UNION ALL SELECT file, 'xl/worksheets/sheet2.xml', 'rId1', '../comments1.xml', '' FROM b""")
def book_rels(t):
    r = own(W.rels(books(t))).where("(part LIKE '%sheet4.xml' OR part LIKE '%sheet2.xml') AND rid = 'rId1'")
    return r.select("file", "part", "rid", "target", "mode")


@query(_B + " SELECT file, 37 AS n_parts, 6 AS n_sheets FROM b")
def book_parts(t):
    p = own(W.parts(books(t)))
    return p.groupBy("file").agg(F.count("*").cast("int").alias("n_parts"), F.count_if(F.col("part").rlike("^xl/worksheets/sheet")).cast("int").alias("n_sheets"))


_VECTORS = """v AS (SELECT file, 'Inputs' AS sheet, 'column' AS direction, 'B2:B' || (m + 1) AS cell_range, CAST(m AS INTEGER) AS length, round(total, 4) AS total FROM b WHERE m >= 3
UNION ALL SELECT file, 'Inputs', 'column', 'C2:C' || (m + 1), CAST(m AS INTEGER), codes FROM b WHERE m >= 3 UNION ALL SELECT file, 'Notes', 'column', 'B2:B4', 3, round(0.5 + k + 7.25, 4) FROM b)"""


@query(_B + f", {_VECTORS} SELECT * FROM v")
def book_vectors(t):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return own(detect.hardcoded_vectors(books(t))).select("file", "sheet", "direction", "cell_range", "length", rounded(total).alias("total"))


@query(_B + """ SELECT file, 'Calc' AS sheet, 'column' AS direction, 'A2:A' || (m + 1) AS cell_range, CAST(m AS INTEGER) AS length FROM b WHERE m >= 3""")
def book_cached_vectors(t):
    """Runs of all numbers, results of formulas among them."""
    return detect.vectors(W.all_numbers(W.cells(books(t), ["Calc"]))).select("file", "sheet", "direction", "cell_range", "length")


@query(_B + """ SELECT file, s.sheet, CAST(CASE s.sheet WHEN 'Inputs' THEN CASE WHEN m >= 3 THEN 2 ELSE 0 END WHEN 'Notes' THEN 1 ELSE 0 END AS INTEGER) AS n_vectors FROM b, (SELECT unnest(['Inputs', 'Notes', 'Calc', 'Links', 'Summary', 'Empty']) AS sheet) s""")
def book_sheet_vectors(t):
    """Every sheet with its vectors; the empty one has none."""
    return own(detect.sheet_vectors(books(t))).select("file", "sheet", F.size("vectors").alias("n_vectors"))


# --- extractors ------------------------------------------------------------------------------


def found(t, place: int):
    return own(detect.connections(books(t))).where(F.col("extractor") == place)


def brief(df):
    return df.select("file", "category", "sub_type", "source", "confidence")


@query(_B + """ SELECT file, 'database' AS category, 'sql_server' AS sub_type, 'srv' || k || '/db' AS source, 'SELECT a FROM t' || k || ' WHERE a = ' || k AS query_text, ['t' || k] AS tables, 'a = ' || k AS filter FROM b UNION ALL SELECT file, 'web', 'web_query', 'https://example.com/' || k, NULL, NULL, NULL FROM b
UNION ALL SELECT file, 'file', 'text', 'C:\\feeds\\f' || k || '.csv', NULL, NULL, NULL FROM b UNION ALL SELECT file, 'database', 'olap', 'Cube', NULL, NULL, NULL FROM b UNION ALL SELECT file, 'database', 'odbc', 'Query - Q' || k, NULL, NULL, NULL FROM b""")  # fmt: skip
def extract_connections(t):
    return found(t, 1).select("file", "category", "sub_type", "source", "query_text", "parsed_query.tables", "parsed_query.filter")


@query(_B + """ SELECT file, 'sql_server' AS sub_type, 'pq' || k || '/db' AS source, true AS has_text FROM b UNION ALL SELECT file, 'web', 'https://pq.org/' || k, false FROM b UNION ALL SELECT file, 'powerquery', 'Query - Q' || k, false FROM b""")
def extract_power_queries(t):
    """A row for each source of a query's code, the first with the code; and connections by name."""
    return found(t, 2).select("file", "sub_type", "source", F.col("query_text").isNotNull().alias("has_text"))


@query(_B + """ SELECT file, 'Links!A1' AS location, 'external_workbook' AS sub_type, 'region_' || r || '.xlsx' AS source, 0.95::DOUBLE AS confidence FROM b UNION ALL SELECT file, 'Links!A2', 'bloomberg', 'N' || k || ' Index', 0.95 FROM b UNION ALL SELECT file, 'Links!A3', 'indirect_ref', 'A', 0.6 FROM b
UNION ALL SELECT file, 'Links!A4', 'rtd', 'feed.' || k, 0.9 FROM b UNION ALL SELECT file, 'Links!A5', 'external_workbook', 'ghost_' || (k % 3) || '.xlsx', 0.95 FROM b UNION ALL SELECT file, 'Links!A6', 'external_workbook_ref', '[ExternalLink2]', 0.8 FROM b
UNION ALL SELECT file, 'Links!A7', 'external_workbook', 'region_' || r || '.xlsx', 0.95 FROM b UNION ALL SELECT file, 'Links!A8', 'external_workbook', 'region_' || r || '.xlsx', 0.95 FROM b UNION ALL SELECT file, 'Notes!B9', 'external_workbook', 'lists_' || k || '.xlsx', 0.95 FROM b""")  # fmt: skip
def extract_formula_sources(t):
    return found(t, 3).select("file", "location", "sub_type", "source", "confidence")


@query(_B + r""" SELECT file, 'file' AS category, 'external_workbook' AS sub_type, 'region_' || r || '.xlsx' AS source, 0.95::DOUBLE AS confidence FROM b UNION ALL SELECT file, 'file', 'sharepoint_workbook', 'https://acme.sharepoint.com/plan ' || k || '.xlsx', 0.95 FROM b
UNION ALL SELECT file, 'file', 'local_file', 'C:\old\unused_' || k || '.xlsx', 0.95 FROM b UNION ALL SELECT file, 'file', 'dde_link', 'Feed' || k || '|Prices', 0.9 FROM b""")  # fmt: skip
def extract_external_links(t):
    return brief(found(t, 4))


@query(_B + r""" SELECT file, 'database' AS category, 'sql_server' AS sub_type, 'vba' || k || '/ledger' AS source, 0.85::DOUBLE AS confidence, 3 AS line FROM b UNION ALL SELECT file, 'vba', 'sql', 'SQL in xl/vbaProject.bin', 0.8, 4 FROM b
UNION ALL SELECT file, 'file', 'workbooks_open', 'D:\in\book' || k || '.xlsx', 0.9, 5 FROM b UNION ALL SELECT file, 'web', 'xmlhttp_request', 'https://api.example.com/' || k, 0.9, 7 FROM b UNION ALL SELECT file, 'file', 'unc_path', '\\nas' || k || '\share\old.xls', 0.85, 8 FROM b""")  # fmt: skip
def extract_macros(t):
    """Of equal ids the first counts: the path that is opened, not the path as such."""
    return found(t, 5).select("file", "category", "sub_type", "source", "confidence", F.regexp_extract("location", r":(\d+)$", 1).cast("int").alias("line"))


@query(_B + " SELECT file, 'worksheet' AS sub_type, 'Inputs!A1:C9' AS source, 'Summary:P1' AS location FROM b UNION ALL SELECT file, 'external_db', 'connection 1', 'Summary:P2' FROM b")
def extract_pivots(t):
    return found(t, 6).select("file", "sub_type", "source", "location")


@query(_B + " SELECT file, 'querytable' AS sub_type, 'Sales' AS source, 'Inputs:QT' AS location FROM b UNION ALL SELECT file, 'querytable', 'Loose' || k, ':Loose' || k FROM b")
def extract_query_tables(t):
    return found(t, 7).select("file", "sub_type", "source", "location")


@query(_B + r" SELECT file, 'http' AS sub_type, 'https://links.org/' || k AS source, 'Links!B1' AS location FROM b UNION ALL SELECT file, 'unc_path', '\\share' || k || '\x.xlsx', 'Links!B2' FROM b")
def extract_hyperlinks(t):
    return found(t, 8).select("file", "sub_type", "source", "location")


@query(_B + " SELECT file, 'file' AS category, 'named_range_external' AS sub_type, 'budget_' || k || '.xlsx' AS source, 0.9::DOUBLE AS confidence FROM b")
def extract_named_ranges(t):
    return brief(found(t, 9))


@query(_B + r" SELECT file, 'hyperlink' AS category, 'comment_url' AS sub_type, 'https://wiki.example.com/' || k AS source, 0.7::DOUBLE AS confidence FROM b UNION ALL SELECT file, 'file', 'unc_path', '\\files' || k || '\a\b.xlsx', 0.7 FROM b")
def extract_comments(t):
    return brief(found(t, 10))


@query(_B + """ SELECT file, 'core_properties' AS sub_type, 'Writer ' || k AS source FROM b UNION ALL SELECT file, 'app_properties', 'Sheets' FROM b UNION ALL SELECT file, 'hyperlink_base', 'https://base.org/' || k FROM b
UNION ALL SELECT file, 'custom_property_url', 'https://origin.org/' || k FROM b""")  # fmt: skip
def extract_properties(t):
    return found(t, 11).select("file", "sub_type", "source")


@query(_B + " SELECT file, 'external_link' AS sub_type, 'file:///C:/ole/o' || k || '.docx' AS source FROM b UNION ALL SELECT file, 'embedded', '../embeddings/ole1.bin' FROM b")
def extract_ole(t):
    return found(t, 12).select("file", "sub_type", "source")


@query(_B + """ SELECT file, 'source_note' AS sub_type, 'Source: Bloomberg, March' AS source, 'Inputs!A' || (m + 2) AS location, 0.7::DOUBLE AS confidence FROM b UNION ALL SELECT file, 'pasted_table', 'Inputs!B2:C' || (m + 1), 'Inputs!B2:C' || (m + 1), 0.75 FROM b WHERE m >= 2
UNION ALL SELECT file, 'hardcoded_value', c_name, 'Inputs!' || col || '2', 0.9 FROM b JOIN c USING (k, blk), (SELECT unnest(['B', 'C']) AS col) WHERE m = 1
UNION ALL SELECT file, 'named_input', 'TaxRate', 'Notes!B2', 0.95 FROM b UNION ALL SELECT file, 'hardcoded_value', 'Growth', 'Notes!B4', 0.85 FROM b UNION ALL SELECT file, 'hardcoded_value', 'Only a label', 'Notes!F5', 0.75 FROM b""")  # fmt: skip
def extract_hardcoded_values(t):
    """Notes, pasted tables, named and labelled values; the value without a label is left out."""
    return found(t, 13).select("file", "sub_type", "source", "location", "confidence")


@query(_B + """ SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT u.category, u.n + CASE WHEN u.category <> 'input' THEN 0 WHEN m >= 2 THEN 1 ELSE 2 END AS n FROM b, (VALUES ('database', 6), ('web', 2), ('file', 15), ('powerquery', 3), ('formula', 3),
('vba', 1), ('pivot', 2), ('hyperlink', 3), ('metadata', 4), ('ole', 2), ('input', 4)) u(category, n)) GROUP BY 1""")  # fmt: skip
def connection_summary(t):
    return detect.summary(own(detect.connections(books(t)))).where("category IS NOT NULL").select("category", "n")


@query(_B + """ SELECT DISTINCT 'ghost_' || (k % 3) || '.xlsx' AS item FROM b UNION SELECT 'region_' || r || '.xlsx' FROM b WHERE k < 3""")
def connection_sources(t):
    """Distinct sources of one kind over all files, each by its first extractor."""
    s = detect.sources_by_category(own(detect.connections(books(t))).where("category = 'file' AND sub_type = 'external_workbook'"))
    k = F.regexp_extract("source", r"region_(\d+)", 1)
    few = [0, 1, 2]
    regions = books_regions(t, few)
    return s.where("source LIKE 'ghost%'").select(F.col("source").alias("item")).union(s.join(regions, k == F.col("r")).select("source")).distinct()


def books_regions(t, nations):
    used = t("customer").select("c_nationkey").distinct().where(F.col("c_nationkey").isin(nations))
    return t("nation").join(used, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_regionkey").cast("string").alias("r")).distinct()


# --- formulas and levels ---------------------------------------------------------------------

_MODEL = "n3_0.xlsx"
_L1 = """l1 AS (SELECT * FROM (SELECT file, r, k FROM b WHERE k = 3 AND blk = 0) x, (VALUES ('A1', 'region', 'Data', 'B' || 5, 'cell', true), ('A5', 'ghost', 'S', 'A1', 'cell', false), ('A6', 'plan', 'Plan', 'C3', 'cell', false),
('A7', 'region', 'Data', 'Budget → B2:B4', 'named_range', true), ('A8', 'region', 'Data', 'Facts → A1:B26', 'table', true)) u(cell, target_kind, target_sheet, target, ref_type, found))"""


@query(_B + f""", {_L1} SELECT 1 AS level, 'n3_0.xlsx' AS source, 'Links' AS sheet, cell, CASE target_kind WHEN 'region' THEN 'region_' || r || '.xlsx' WHEN 'ghost' THEN 'ghost_0.xlsx' ELSE 'plan 3.xlsx' END AS target_file, target_sheet, target, ref_type, found FROM l1
UNION ALL SELECT 2, 'region_' || (SELECT r FROM l1 LIMIT 1) || '.xlsx', 'Data', 'B' || (n_nationkey + 2), 'world.xlsx', 'W', 'A' || (n_nationkey + 1), 'cell', true FROM nation
UNION ALL SELECT 3, 'World.xlsx', 'W', 'A' || (n_nationkey + 1), 'lost.xlsx', 'L', 'A' || (n_nationkey + 1), 'cell', false FROM nation WHERE n_nationkey % 2 = 1""")  # fmt: skip
def book_levels(t):
    """Three levels: a name of the workbook rather than of a sheet, a table, a file in a folder
    below whose name differs in case, and a file that is not there."""
    refs = trace.levels(books(t), _MODEL)
    return refs.select("level", trace.base_name("file").alias("source"), "sheet", "cell", "target_file", "target_sheet", "target", "ref_type", "found")


@query(_B + f""", {_L1} SELECT 1 AS level, 'n3_0.xlsx' AS source, 'Links' AS sheet, cell, CASE target_kind WHEN 'region' THEN 'region_' || r || '.xlsx' WHEN 'ghost' THEN 'ghost_0.xlsx' ELSE 'plan 3.xlsx' END AS target_file, found FROM l1
UNION ALL SELECT 2, 'region_' || (SELECT r FROM l1 LIMIT 1) || '.xlsx', 'Data', 'B' || (n_nationkey + 2), 'world.xlsx', true FROM nation
UNION ALL SELECT 3, 'World.xlsx', 'W', 'A' || (n_nationkey + 1), 'lost.xlsx', false FROM nation WHERE n_nationkey % 2 = 1""")  # fmt: skip
def book_file_refs(t):
    """From one sheet of the model, then from all sheets of each file."""
    return raw_sources.file_refs(books(t), _MODEL, ["Links"]).select("level", trace.base_name("file").alias("source"), "sheet", "cell", "target_file", "found")


@query("SELECT CAST(0 AS INTEGER) AS n_refs")
def book_file_refs_of_sheet(t):
    """A model's sheet without references leads nowhere, whatever its other sheets refer to."""
    return raw_sources.file_refs(books(t), _MODEL, ["Notes"]).agg(F.count("*").cast("int").alias("n_refs"))


@query(_B + f""", {_L1} SELECT 'n3_0.xlsx' AS file_name, 0 AS level UNION ALL SELECT DISTINCT 'region_' || r || '.xlsx', 1 FROM l1 UNION ALL SELECT 'world.xlsx', 2""")
def book_source_files(t):
    return raw_sources.source_files(raw_sources.file_refs(books(t), _MODEL, ["Links"]), _MODEL).select("file_name", "level")


@query(_B + """ SELECT 'ghost_0.xlsx' AS missing, 1 AS first_level, 'n3_0.xlsx' AS first_referrer, ['S'] AS sheets, CAST(1 AS BIGINT) AS n_cells UNION ALL SELECT 'plan 3.xlsx', 1, 'n3_0.xlsx', ['Plan'], 1
UNION ALL SELECT 'lost.xlsx', 3, 'World.xlsx', ['L'], count(*) FROM nation WHERE n_nationkey % 2 = 1""")  # fmt: skip
def book_missing_files(t):
    return raw_sources.missing_files(raw_sources.file_refs(books(t), _MODEL, ["Links"])).select("missing", "first_level", "first_referrer", "sheets", "n_cells")


@query(_B + " SELECT file, 'unused_' || k || '.xlsx' AS link_file FROM b UNION ALL SELECT file, 'region_' || r || '.xlsx' FROM b WHERE false")
def book_phantom_links(t):
    return own(raw_sources.phantom_links(books(t))).select("file", "link_file")


@query(_B + """ SELECT file, 'chart' AS ref_origin, 'region_' || r || '.xlsx' AS target_file, 'Data' AS target_sheet, 'B2:B4' AS target FROM b UNION ALL SELECT file, 'data_validation', 'lists_' || k || '.xlsx', 'L', 'A1:A9' FROM b""")
def book_part_refs(t):
    return own(raw_sources.part_refs(books(t))).select("file", "ref_origin", "target_file", "target_sheet", "target")


@query(_B + " SELECT file, 'Notes' AS sheet, 'Best' AS scenario, 'B2' AS cell, CAST(k AS VARCHAR) AS value FROM b")
def book_scenarios(t):
    return own(raw_sources.scenarios(books(t))).select("file", "sheet", "scenario", "cell", "value")


@query(_B + f", {_VECTORS} SELECT file, sheet, cell_range, CASE WHEN sheet = 'Notes' THEN 'Rate' WHEN cell_range LIKE 'B%' THEN 'Balance' ELSE 'Code' END AS header, CASE WHEN sheet = 'Notes' THEN 'Tax' ELSE (SELECT min(c_name) FROM c JOIN b USING (k, blk) WHERE b.file = v.file AND i = 1) END AS label FROM v")
def book_vector_context(t):
    w = books(t)
    return own(raw_sources.vector_context(detect.hardcoded_vectors(w), w)).select("file", "sheet", "cell_range", "header", "label")


@query(_B + """ SELECT o.file AS model_file, 'Inputs' AS model_sheet, 'B2:B' || (o.m + 1) AS model_range, o.file AS up_file, 'Inputs' AS up_sheet, 'B2:B' || (o.m + 1) AS matched_range, 'exact' AS match_type FROM b o WHERE o.k = 3 AND o.blk = 0 AND o.m >= 3""")
def book_trace_exact(t):
    """A model's balances among all vectors of all workbooks: its own place is the exact match."""
    w = books(t)
    model = w.where(F.col("file").endswith("/" + _MODEL))
    m, _ = trace.trace(model, "Inputs", w, trace.TraceConfig(approximate=False, subsequence=False))
    m = m.where("model_cell_range LIKE 'B%'")
    return m.select("model_file", "model_sheet", F.col("model_cell_range").alias("model_range"), "up_file", "up_sheet", "matched_range", "match_type")


@query(_B + """ SELECT 'Calc' AS up_sheet, 'approximate' AS match_type, 1.0::DOUBLE AS similarity, 'A2:A' || (m + 1) AS matched_range FROM b WHERE k = 3 AND blk = 0 AND m >= 3""")
def book_trace_similar(t):
    """Doubled balances are perfectly correlated with the balances."""
    w = books(t).where(F.col("file").endswith("/" + _MODEL))
    m, _ = trace.trace(w, "Inputs", w, trace.TraceConfig(exact=False, min_similarity=0.999999, length_tolerance=0.0))
    return m.where("model_cell_range LIKE 'B%' AND up_sheet = 'Calc'").select("up_sheet", "match_type", F.round("similarity", 6).alias("similarity"), "matched_range")


# --- contract and graphs ---------------------------------------------------------------------


@query(_B + """ SELECT file, 'Inputs' AS sheet, 'B2:B' || (m + 1) AS cell_range, 'input' AS variable_type, 'Balances' AS name FROM b WHERE m >= 3 UNION ALL SELECT file, 'Inputs', 'C2:C' || (m + 1), 'input', NULL FROM b WHERE m >= 3 UNION ALL SELECT file, 'Notes', 'B2:B4', 'input', NULL FROM b
UNION ALL SELECT file, 'Notes', 'B2', 'input', 'TaxRate' FROM b UNION ALL SELECT file, 'Calc', 'A2:A' || (m + 1), 'intermediate', NULL FROM b WHERE m >= 3 UNION ALL SELECT file, 'Links', 'A1:A8', 'intermediate', NULL FROM b
UNION ALL SELECT file, 'Summary', 'A1', 'output', NULL FROM b UNION ALL SELECT file, 'Summary', 'A2', 'output', NULL FROM b
UNION ALL SELECT file, 'Inputs', 'B2' || CASE m WHEN 1 THEN '' ELSE ':B3' END, 'input', 'Balances' FROM b WHERE m < 3 UNION ALL SELECT file, 'Calc', 'A' || (i + 1), 'intermediate', NULL FROM c JOIN b USING (k, blk) WHERE m < 3""")  # fmt: skip
def book_variables(t):
    return own(contract.variables(books(t), ["Summary"])).select("file", "sheet", "cell_range", "variable_type", "name")


@query(_B + """ SELECT file, 'Calc' AS sheet, 'Inputs!B2*2' AS formula, 'Inputs!B2*2' AS sql_formula FROM b WHERE m >= 3 UNION ALL SELECT file, 'Summary', 'SUM(Calc!A2:A' || (m + 1) || ')', 'SUM(calc_a2_a' || (m + 1) || ')' FROM b WHERE m >= 3
UNION ALL SELECT file, 'Summary', 'Summary!A1+Links!A1', 'summary_a1+Links!A1' FROM b WHERE m >= 3""")  # fmt: skip
def book_transformations(t):
    w = books(t)
    v = contract.cut(contract.variables(w, ["Summary"]))
    small = v.where("sheet = 'Calc' AND cell_range NOT LIKE '%:%'").select(F.col("file").alias("s_file")).distinct()
    steps = contract.transformations(w, v).join(v.select("variable_id", "sheet"), "variable_id")
    return own(steps).where("sheet IN ('Calc', 'Summary')").join(small, F.col("file") == F.col("s_file"), "left_anti").select("file", "sheet", "formula", "sql_formula")


@query(_B + """ SELECT file, e.* FROM b, (VALUES ('Calc', 'Summary'), ('Inputs', 'Calc'), ('Links', 'Summary'), ('Summary', 'Summary')) e(src, dst) WHERE m >= 3""")
def book_variable_edges(t):
    """Edges between variables, by the sheets they are on."""
    w = books(t)
    v = contract.cut(contract.variables(w, ["Summary"]))
    e = contract.dependency_edges(contract.transformations(w, v), v)
    small = v.where("sheet = 'Calc' AND cell_range NOT LIKE '%:%'").select(F.col("file").alias("s_file")).distinct()
    of = lambda key: v.select(F.col("variable_id").alias(key), F.col("sheet").alias(f"{key}_sheet"), F.col("file").alias(f"{key}_file"))
    named = e.join(of("src"), "src").join(of("dst"), "dst").join(small, F.col("src_file") == F.col("s_file"), "left_anti")
    return own(named, "src_file").select(F.col("src_file").alias("file"), F.col("src_sheet").alias("src"), F.col("dst_sheet").alias("dst")).distinct()


@query(_B + """ SELECT file, NULL AS src_book, e.src, e.dst FROM b, (VALUES ('Inputs', 'Calc'), ('Calc', 'Summary'), ('Links', 'Summary')) e(src, dst) UNION ALL SELECT file, 'region_' || r || '.xlsx', s, 'Links' FROM b, (SELECT unnest(['Data', '']) AS s)
UNION ALL SELECT file, 'ghost_' || (k % 3) || '.xlsx', 'S', 'Links' FROM b UNION ALL SELECT file, 'plan ' || k || '.xlsx', 'Plan', 'Links' FROM b""")  # fmt: skip
def book_sheet_edges(t):
    return own(sheet_graph.sheet_edges(books(t))).select("file", "src_book", "src", "dst")


@query(_B + """ SELECT file, e.connection || CASE WHEN e.connection LIKE 'Query%' THEN CAST(k AS VARCHAR) ELSE '' END AS connection, e.sheet FROM b, (VALUES ('Sales', 'Inputs'), ('Sales', 'Summary'), ('Site', NULL), ('Feed', NULL), ('Cube', NULL), ('Query - Q', NULL)) e(connection, sheet)""")
def book_connection_edges(t):
    """Connections with the sheets whose query tables and pivots use them; others float."""
    return own(sheet_graph.connection_edges(books(t))).select("file", "connection", "sheet")


# --- read tools and reports ------------------------------------------------------------------


@query(_B + """ SELECT file, 'A1' AS ref FROM b UNION ALL SELECT file, x FROM b, (SELECT unnest(['B1', 'A2', 'B2', 'B3']) AS x)""")
def tool_neighbourhood(t):
    return own(cell_tools.neighbourhood(W.cells(books(t)), "Notes", "A2", 1)).select("file", "ref")


@query(_B + """ SELECT file, x.sheet, CAST(x.o AS INTEGER) AS sheet_idx FROM b, (SELECT unnest(['Inputs', 'Notes', 'Calc', 'Links', 'Summary', 'Empty']) AS sheet, unnest(range(6)) AS o) x""")
def tool_list_sheets(t):
    return own(cell_tools.list_sheets(books(t))).select("file", "sheet", "sheet_idx")


@query(_B + """ SELECT file, x AS name, CASE WHEN x = '_xlnm.Print_Area' THEN 'Inputs' END AS scope FROM b, (SELECT unnest(['TaxRate', 'Balances', 'Outside', '_xlnm.Print_Area', 'Dyn']) AS x)""")
def tool_named_ranges(t):
    return own(cell_tools.named_ranges(books(t))).select("file", "name", "scope")


@query(_B + """ SELECT 1 AS col, 'Name' AS header UNION ALL SELECT 2, 'Balance' UNION ALL SELECT 3, 'Code' UNION ALL SELECT 4, NULL""")
def tool_headers(t):
    w = books(t).where(F.col("file").endswith("/" + _MODEL))
    return cell_tools.headers(W.cells(w), "Inputs", "A", "D")


@query(_B + """ SELECT CAST(m + 2 AS INTEGER) AS max_row, 3 AS max_col, 3 * m + 4 AS n_cells, CAST(0 AS BIGINT) AS n_formulas FROM b WHERE k = 3 AND blk = 0""")
def tool_sheet_summary(t):
    w = books(t).where(F.col("file").endswith("/" + _MODEL))
    return cell_tools.sheet_summary(W.cells(w), "Inputs")[0]


@query(_B + """ SELECT 'region_' || r || '.xlsx' AS source, 1 AS first_level FROM b WHERE k = 3 AND blk = 0 UNION ALL SELECT 'ghost_0.xlsx', 1 UNION ALL SELECT 'plan 3.xlsx', 1 UNION ALL SELECT 'world.xlsx', 2 UNION ALL SELECT 'lost.xlsx', 3""")
def report_upstream_sources(t):
    w = books(t)
    refs = trace.levels(w, _MODEL)
    matches, _ = trace.trace(w.where(F.col("file").endswith("/" + _MODEL)), "Summary", w.where("false"), trace.TraceConfig(approximate=False))
    return reports.upstream_sources(matches, refs).select("source", "first_level")


# --- text sinks ------------------------------------------------------------------------------


@query("""SELECT r_regionkey, 'R' || r_regionkey AS src, 'N' || n_nationkey AS dst, n_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, 'N' || n_nationkey, 'Z' || r_regionkey, NULL FROM region JOIN nation ON n_regionkey = r_regionkey""")
def diagram_edges(t):
    """Flowcharts with labels, fans by ``&``, comments and subgraphs, one for each region, as edges."""
    from collections.abc import Iterator

    from ..sources import diagram

    n = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    r = n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "ns")

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, ns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = ["flowchart LR", "%% a comment --> not an edge", f'subgraph S["{k}"]', *[f"R{k}[(Region)] -->|{x['n_name']}| N{x['n_nationkey']}{{{{{x['n_name']}}}}}" for x in ns], "end"]
                lines.append(" & ".join(f"N{x['n_nationkey']}" for x in ns) + f" --> Z{k}([all]);")
                rows += [(k, a, z, label) for a, z, label in diagram.parse("\n".join(lines))[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int32() if i == 0 else pa.string()) for i in range(4)], names=["r_regionkey", "src", "dst", "label"])

    return r.select(F.col("r_regionkey").cast("int"), "ns").mapInArrow(run, "r_regionkey int, src string, dst string, label string")


@query(_B + """ SELECT variable_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'input' AS variable_type, CASE WHEN m >= 3 THEN 4 ELSE 3 END AS n FROM b UNION ALL SELECT 'intermediate', CASE WHEN m >= 3 THEN 2 ELSE m + 1 END FROM b UNION ALL SELECT 'output', 2 FROM b) GROUP BY 1""")
def book_contract_summary(t):
    """Variables by type, as on the contract report's first sheet."""
    return own(contract.variables(books(t), ["Summary"])).groupBy("variable_type").agg(F.count("*").alias("n"))


@query(_B + """ SELECT lower(item) AS item, kind FROM (SELECT DISTINCT 'region_' || r || '.xlsx' AS item, 'file' AS kind FROM b WHERE k = 3 AND blk = 0 UNION SELECT unnest(['ghost_0.xlsx', 'plan 3.xlsx', 'world.xlsx', 'lost.xlsx']), 'file'
UNION SELECT unnest(['budget_3.xlsx', 'lists_3.xlsx']), 'file')""")  # fmt: skip
def book_required_inputs(t):
    """Files that formulas need, then connections to other workbooks, each once."""
    w = books(t)
    refs = raw_sources.file_refs(w, _MODEL, ["Links"])
    mine = detect.connections(w.where(F.col("file").endswith("/" + _MODEL))).where("sub_type IN ('external_workbook', 'named_range_external')")
    return raw_sources.required_inputs(refs, mine).select("item", "kind")


@query(_B + """ SELECT CAST(1 AS BIGINT) AS exact, CAST(0 AS BIGINT) AS approximate, CAST(0 AS BIGINT) AS unmatched FROM b WHERE k = 3 AND blk = 0""")
def book_trace_summary(t):
    """Counts of a trace of the model's notes among its own workbook's vectors."""
    w = books(t).where(F.col("file").endswith("/" + _MODEL))
    m, u = trace.trace(w, "Notes", w, trace.TraceConfig(approximate=False, subsequence=False))
    both = m.select("match_type").union(u.select(F.lit("unmatched")))
    return both.agg(*[F.count_if(F.col("match_type") == k).alias(k) for k in ("exact", "approximate", "unmatched")])


@query(_B + """ SELECT 'level ' || level AS what, n FROM (SELECT 1 AS level, CAST(5 AS BIGINT) AS n UNION ALL SELECT 2, count(*) FROM nation UNION ALL SELECT 3, count(*) FROM nation WHERE n_nationkey % 2 = 1)""")
def report_levels(t):
    """Level rows written to a report workbook and read back from it."""
    from ..sources import writer

    refs = trace.levels(books(t), _MODEL)
    shown = refs.select("level", trace.base_name("file").alias("file"), "sheet", "cell", "target_file", "target_sheet", "target", "found")
    tabs = {f"Level {k}": reports._rows(shown.where(F.col("level") == k), ["file", "sheet", "cell"]) for k in (1, 2, 3)}
    back = reports.read_levels(refs.sparkSession.createDataFrame([("levels.xlsx", writer.report_bytes(tabs))], "file string, content binary"))
    return back.groupBy(F.concat(F.lit("level "), F.col("level")).alias("what")).agg(F.count("*").alias("n"))
