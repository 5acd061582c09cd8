import pytest
from pyspark.sql import functions as F

from gridweave.plans import cell_tools, contract, detect, raw_sources, reports, sheet_graph, trace
from gridweave.sources import workbook as W
from gridweave.sources import writer

LINK = '<externalLink xmlns="x" xmlns:r="r"><externalBook r:id="rId1"/></externalLink>'
LINK_RELS = '<Relationships xmlns="p"><Relationship Id="rId1" Type="t/externalLinkPath" Target="{}" TargetMode="External"/></Relationships>'
CONNECTIONS = (
    '<connections xmlns="x"><connection id="1" name="Sales" type="5"><dbPr connection="Provider=SQLOLEDB;Data Source=srv;Initial Catalog=db" command="SELECT a, b FROM t JOIN u ON t.x = u.x WHERE a = 1"/></connection>'
    '<connection id="2" name="Site" type="4"><webPr url="https://example.com/data"/></connection></connections>'
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    months = [f"M{i}" for i in range(1, 13)]
    prices = [100.5, 101.25, 99.0, 98.5, 97.0, 103.0, 104.5, 101.0, 100.0, 99.5, 98.0, 97.5]
    up_b = {"RawData": [["Date", "Price"], *[[m, p] for m, p in zip(months, prices, strict=True)]], "Gone": [["=[1]Lost!A1"]]}
    (d / "upstream_b.xlsx").write_bytes(writer.workbook_bytes(up_b, extra={"xl/externalLinks/externalLink1.xml": LINK, "xl/externalLinks/_rels/externalLink1.xml.rels": LINK_RELS.format("ghost.xlsx")}))
    up_a = {"Data": [["Quarter", "Revenue"], ["Q1", ("='[upstream_b.xlsx]RawData'!B2*2", 201.0)], ["Q2", ("=Helper!A1", 5.0)]], "Helper": [["=[upstream_b.xlsx]Gone!A1"]]}
    (d / "upstream_a.xlsx").write_bytes(writer.workbook_bytes(up_a))
    model = {
        "Inputs": [["Name", *months], ["Price", *prices], [], ["Scaled", *[p * 3 for p in prices]], [], ["Own", *[float(i * i) for i in range(12)]], ["Source: Bloomberg, May"]],
        "Calc": [["x"], ["=Inputs!B2*2"], ["=Inputs!C2*2"], ["=Inputs!D2*2"], ["='[upstream_a.xlsx]Data'!B2"], ["=[upstream_a.xlsx]Data!B3"], ['=BDP("AAPL US Equity","PX_LAST")'], ['=INDIRECT("A"&B1)']],
        "Summary": [["=SUM(Calc!A2:A4)"]],
    }
    tail = '<hyperlinks><hyperlink ref="A1" r:id="rId1"/></hyperlinks>'
    rels = '<Relationships xmlns="p"><Relationship Id="rId1" Type="t/hyperlink" Target="https://example.com/doc" TargetMode="External"/></Relationships>'
    (d / "model.xlsx").write_bytes(
        writer.workbook_bytes(model, {"PriceRow": "Inputs!$B$2:$M$2", "Budget": "[1]Sheet1!$A$1"}, {"xl/connections.xml": CONNECTIONS, "xl/worksheets/_rels/sheet1.xml.rels": rels, "docProps/core.xml": '<c xmlns:d="d"><d:creator>Ann</d:creator></c>'}, {"Inputs": tail})
    )
    (d / "broken.xlsx").write_bytes(b"not a zip")
    return d


@pytest.fixture(scope="module")
def books(spark, folder):
    return W.files(spark, str(folder)).cache()


def one(books, name):
    return books.where(F.col("file").endswith("/" + name))


def test_cells(books):
    c = W.cells(one(books, "model.xlsx"))
    assert c.where("sheet = 'Inputs' AND ref = 'B2'").first()["num_value"] == 100.5
    assert W.formulas(c).count() == 8 and W.hardcoded(c).count() == 36
    assert [r["sheet"] for r in W.sheets(one(books, "model.xlsx")).orderBy("sheet_idx").collect()] == ["Inputs", "Calc", "Summary"]
    assert W.cells(one(books, "broken.xlsx")).isEmpty()
    assert W.names(one(books, "model.xlsx")).where("name = 'PriceRow'").first()["cell_range"] == "B2:M2"


def test_connections(books, tmp_path):
    found = {(r["category"], r["sub_type"]) for r in detect.connections(one(books, "model.xlsx")).collect()}
    assert found >= {("database", "sql_server"), ("web", "web_query"), ("formula", "bloomberg"), ("formula", "indirect_ref"), ("file", "external_workbook"), ("hyperlink", "http"), ("input", "source_note"), ("metadata", "core_properties"), ("file", "named_range_external")}
    made = detect.report(one(books, "model.xlsx"), tmp_path, "model")
    assert [p.suffix for p in made] == [".json", ".xlsx", ".mmd"] and all(p.stat().st_size for p in made)
    sql = detect.connections(one(books, "model.xlsx")).where("sub_type = 'sql_server'").first()["parsed_query"]
    assert sql["tables"] == ["t", "u"] and sql["columns"] == ["a", "b", "x"] and sql["filter"] == "a = 1"


def test_trace(books):
    matches, unmatched = trace.trace(one(books, "model.xlsx"), "Inputs", books.where("file LIKE '%upstream%'"))
    rows = {(r["model_cell_range"], r["match_type"]) for r in matches.collect()}
    assert ("B2:M2", "exact") in rows and ("B4:M4", "approximate") in rows
    assert [r["cell_range"] for r in unmatched.where("direction = 'row'").collect()] == ["B6:M6"]


def test_levels(books):
    refs = trace.levels(books, "model.xlsx")
    got = {(r["level"], r["target_file"], r["found"]) for r in refs.collect()}
    assert got >= {(1, "upstream_a.xlsx", True), (2, "upstream_b.xlsx", True), (3, "ghost.xlsx", False)}
    assert [r["chain"][0]["cell"] for r in refs.where("level = 2 AND cell = 'B3'").collect()] == ["A1"]
    assert {r["missing"] for r in raw_sources.missing_files(refs).collect()} >= {"ghost.xlsx"}
    assert "(missing)" in trace.level_diagram(refs)


def test_names_by_scope_and_redirect(spark):
    """A name that a sheet qualifies, one that leads on to another workbook, one that is computed,
    one that is not there; and a file in a folder below, in other case."""
    made = writer.workbook_bytes
    model = made({"S": [["=[up.xlsx]B!Rate"], ["='[up.xlsx]'!Rate"], ["='[up.xlsx]'!Far"], ["=[dyn.xlsx]X!Calc"], ["=[none.xlsx]X!Nope"]]})
    names = [("Rate", "A!$A$1", None), ("Rate", "B!$A$2", 1), ("Far", "'[third.xlsx]T'!$C$3", None)]
    files = {
        "/in/m.xlsx": model, "/in/up.xlsx": made({"A": [["=[a.xlsx]S!A1"]], "B": [["=[no.xlsx]S!A1"], ["=[b.xlsx]S!A1"]]}, names), "/in/dyn.xlsx": made({"X": [["=[c.xlsx]S!A1"]], "Y": [["=[d.xlsx]S!A1"]]}, {"Calc": "OFFSET(X!$A$1,0,0)"}),
        "/in/deep/THIRD.xlsx": made({"T": [[None], [None], [None, None, "=[e.xlsx]S!A1"]]}),
    }
    books = spark.createDataFrame([*files.items()], "file string, content binary")
    got = {(r["level"], r["target_file"], r["target"], r["found"]) for r in trace.levels(books, "m.xlsx").collect()}
    assert got == {
        (1, "up.xlsx", "Rate → A2", True), (1, "up.xlsx", "Rate → A1", True), (1, "up.xlsx", "Far → [third.xlsx]T!C3", True), (1, "dyn.xlsx", "Calc (dynamic)", True), (1, "none.xlsx", "Nope", False),
        (2, "a.xlsx", "A1", False), (2, "b.xlsx", "A1", False), (2, "third.xlsx", "C3", True), (2, "c.xlsx", "A1", False), (2, "d.xlsx", "A1", False), (3, "e.xlsx", "A1", False),
    }


def test_files_resolve_by_phase(spark):
    listing = spark.createDataFrame([("/in/a.xlsx", "/in"), ("/in/B.xlsx", "/in"), ("/in/x/a.xlsx", "/in/x"), ("/in/x/b.xlsx", "/in/x"), ("/in/x/y/c.xlsx", "/in/x/y")], "file string, folder string")
    refs = spark.createDataFrame([("a.xlsx",), ("C:\\old\\A.XLSX",), ("b.xlsx",), ("http://h/C.xlsx",), ("d.xlsx",)], "target_file string")
    got = {r["target_file"]: r["resolved_path"] for r in trace.resolved_files(refs, listing).collect()}
    assert got == {"a.xlsx": "/in/a.xlsx", "C:\\old\\A.XLSX": "/in/a.xlsx", "b.xlsx": "/in/B.xlsx", "http://h/C.xlsx": "/in/x/y/c.xlsx", "d.xlsx": None}


def test_file_refs_start_from_given_sheets(books):
    some = raw_sources.file_refs(books, "model.xlsx", ["Calc"])
    assert {(r["level"], r["target_file"]) for r in some.collect()} == {(1, "upstream_a.xlsx"), (2, "upstream_b.xlsx"), (3, "ghost.xlsx")}
    assert raw_sources.file_refs(books, "model.xlsx", ["Inputs"]).isEmpty()
    assert [(r["file_name"], r["level"]) for r in raw_sources.source_files(some, "model.xlsx").orderBy("level").collect()] == [("model.xlsx", 0), ("upstream_a.xlsx", 1), ("upstream_b.xlsx", 2)]


def test_empty_sheets_have_empty_vectors(books):
    got = {r["sheet"]: len(r["vectors"]) for r in detect.sheet_vectors(one(books, "model.xlsx")).collect()}
    assert got == {"Inputs": 3, "Calc": 0, "Summary": 0}


def test_report_is_a_source(spark, books, tmp_path):
    matches, unmatched = trace.trace(one(books, "model.xlsx"), "Inputs", books.where("file LIKE '%upstream%'"), trace.TraceConfig(approximate=False))
    refs = trace.levels(books, "model.xlsx")
    made = reports.trace_report(tmp_path / "t.xlsx", trace.TraceConfig(), matches, unmatched, refs, "model.xlsx")
    report = W.files(spark, str(made))
    back = reports.read_levels(report)
    key = ("level", "sheet", "cell", "target_file", "target_sheet", "target", "found")
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, refs.select(*key).collect()))
    assert trace.level_diagram(back).startswith("flowchart") and reports.report_model(report).first()["model"] == "model.xlsx"


def test_raw_sources(books):
    t = raw_sources.detect_sources(books, "model.xlsx", ["Inputs", "Calc"])
    assert t["dynamic_refs"].first()["note"] == "built from parts"
    assert t["matched"].count() >= 1 and t["required_inputs"].count() >= 3
    assert all(df.columns for df in t.values())


def test_contract(books):
    t = contract.contract(one(books, "model.xlsx"), ["Summary"])
    v = {r["cell_range"]: r for r in t["variables"].collect() if r["sheet"] != "Inputs" or r["name"]}
    assert v["B2:M2"]["business_name"] == "PriceRow" and v["A1"]["variable_type"] == "output"
    step = t["transformations"].where(F.col("variable_id") == v["A1"]["variable_id"]).first()
    assert step["sql_formula"].startswith("SUM(")
    assert t["edges"].count() >= 2
    assert "def " in contract.python_code(t) and "flowchart" in contract.variable_diagram(t)
    compile(contract.python_code(t), "made", "exec")


def test_reports(spark, books, tmp_path):
    matches, unmatched = trace.trace(one(books, "model.xlsx"), "Inputs", books.where("file LIKE '%upstream%'"))
    refs = trace.levels(books, "model.xlsx")
    t = contract.contract(one(books, "model.xlsx"), ["Summary"])
    made = [reports.trace_report(tmp_path / "t.xlsx", trace.TraceConfig(), matches, unmatched, refs), reports.contract_report(tmp_path / "c.xlsx", t)]
    tabs = {r["sheet"] for r in W.sheets(W.files(spark, str(made[0]))).collect()}
    assert tabs >= {"Config", "Upstream Sources", "Tracing Results", "Level 1", "Level 2"}
    assert W.cells(W.files(spark, str(made[1])), ["Variables"]).count() > 10
    assert "OUT_Summary" in reports.source_diagram(t, detect.connections(one(books, "model.xlsx")), "model")


def test_sheet_graph(books):
    e = {(r["src_book"], r["src"], r["dst"]) for r in sheet_graph.sheet_edges(one(books, "model.xlsx")).collect()}
    assert {(None, "Inputs", "Calc"), (None, "Calc", "Summary"), ("upstream_a.xlsx", "Data", "Calc")} <= e
    text, page = sheet_graph.build(one(books, "model.xlsx"))
    assert "CONN__Sales" in text and "const graph" in page and "</script>" not in page.split("const graph = ")[1].split(";\n")[0]


def test_cell_tools(books):
    c = W.cells(one(books, "model.xlsx"))
    assert cell_tools.neighbourhood(c, "Inputs", "B2", 1).count() == 6
    assert [r["header"] for r in cell_tools.headers(c, "Inputs", "A", "C").collect()] == ["Name", "M1", "M2"]


def test_stream(spark, folder, tmp_path):
    from gridweave.streaming import ingest

    q = ingest.stream_cells(spark, str(folder)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").where("sheet = 'Calc'").count() == 8
