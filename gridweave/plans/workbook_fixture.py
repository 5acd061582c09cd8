"""Workbooks written from the tables: what the workbook queries read.

Customers of a nation, 5,000 keys at a time, are one workbook with every kind of part that the
readers know; regions and the world are the workbooks that these refer to. So each query over
workbooks has a counterpart in SQL over the tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import writer

FOLDER, KEYS = "/books", 5_000
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _rels(*rows: tuple[str, str, str, str]) -> str:
    """(id, type, target, mode) rows as a relationships part."""
    made = "".join(f'<Relationship Id="{i}" Type="{_DOC}/{t}" Target="{target}"' + (f' TargetMode="{mode}"' if mode else "") + "/>" for i, t, target, mode in rows)
    return f'<Relationships xmlns="p">{made}</Relationships>'


MACRO = """Sub Load()
  Set c = CreateObject("ADODB.Connection")
  c.ConnectionString = "Provider=SQLOLEDB;Data Source=vba{k};Initial Catalog=ledger"
  Set r = c.Execute("SELECT total FROM ledger{k} WHERE x = 1")
  Workbooks.Open "D:\\in\\book{k}.xlsx"
  Set x = CreateObject("MSXML2.XMLHTTP")
  x.Open "GET", "https://api.example.com/{k}"
  Set o = GetObject("\\\\nas{k}\\share\\old.xls")
End Sub
"""


def customer_book(k: int, region: int, rows: list[tuple[int, str, float]]) -> bytes:
    """The workbook of a nation's customers (key, name, balance)."""
    m = len(rows)
    sheets = {
        "Inputs": [["Name", "Balance", "Code"], *[[name, bal, key % 5] for key, name, bal in rows], ["Source: Bloomberg, March"]],
        "Notes": [["Label", "Rate"], ["Tax", 0.5 + k], [None, 7], ["Growth", 0.25], ["Only a label", None, None, None, None, 3]],
        "Calc": [["Doubled"], *[[(f"=Inputs!B{i}*2", 2 * bal)] for i, (_, _, bal) in enumerate(rows, 2)]],
        "Links": [
            [f"='[region_{region}.xlsx]Data'!B{k + 2}"], [f'=BDP("N{k} Index","PX_LAST")'], ['=INDIRECT("A"&B1)'], [f'=RTD("feed.{k}",,"T")'], [f"=[ghost_{k % 3}.xlsx]S!A1"], ["=[2]Plan!C3"],
            [f"='[region_{region}.xlsx]'!Budget"], [f"=SUM([region_{region}.xlsx]Facts[Amount])"],
        ],
        "Summary": [[f"=SUM(Calc!A2:A{m + 1})"], ["=Summary!A1+Links!A1"]],
        "Empty": [],
    }
    names = [
        ("TaxRate", "Notes!$B$2", None), ("Balances", f"Inputs!$B$2:$B${m + 1}", None), ("Outside", f"'[budget_{k}.xlsx]Plan'!$A$1", None), ("_xlnm.Print_Area", "Inputs!$A$1", 0),
        ("Dyn", "OFFSET(Inputs!$A$1,0,0,3,1)", None),
    ]
    tails = {
        "Notes": f'<scenarios><scenario name="Best"><inputCells r="B2" val="{k}"/></scenario></scenarios><dataValidations><dataValidation sqref="B9"><formula1>[lists_{k}.xlsx]L!$A$1:$A$9</formula1></dataValidation></dataValidations>',
        "Links": '<hyperlinks><hyperlink ref="B1" r:id="rId1"/><hyperlink ref="B2" r:id="rId2"/><hyperlink ref="B3" r:id="rId3"/></hyperlinks>',
    }
    book = lambda rid: f'<externalLink xmlns="x" xmlns:r="r"><externalBook r:id="{rid}"/></externalLink>'
    link = lambda n, target: {f"xl/externalLinks/externalLink{n}.xml": book("rId1"), f"xl/externalLinks/_rels/externalLink{n}.xml.rels": _rels(("rId1", "externalLinkPath", target, "External"))}
    query = {"Queries": [{"Name": f"Q{k}", "Formula": f'let s = Sql.Database("pq{k}", "db"), w = Web.Contents("https://pq.org/{k}") in s'}]}
    extra = {
        "xl/connections.xml": f'<connections xmlns="x"><connection id="1" name="Sales" type="5"><dbPr connection="Provider=SQLOLEDB;Data Source=srv{k};Initial Catalog=db" command="SELECT a FROM t{k} WHERE a = {k}"/></connection>'
        f'<connection id="2" name="Site" type="4"><webPr url="https://example.com/{k}"/></connection><connection id="3" name="Feed" type="6"><textPr sourceFile="C:\\feeds\\f{k}.csv"/></connection>'
        f'<connection id="4" name="Cube" type="5"><olapPr/></connection><connection id="5" name="Query - Q{k}" type="1"/></connections>',
        **link(1, f"region_{region}.xlsx"), **link(2, f"https://acme.sharepoint.com/plan%20{k}.xlsx"), **link(3, f"file:///C:/old/unused_{k}.xlsx"),
        "xl/externalLinks/externalLink4.xml": f'<externalLink xmlns="x"><ddeLink ddeService="Feed{k}" ddeTopic="Prices"/></externalLink>',
        "customXml/item1.xml": json.dumps(query), "xl/vbaProject.bin": MACRO.replace("{k}", str(k)),
        "xl/pivotTables/pivotTable1.xml": '<pivotTableDefinition xmlns="x" name="P1"/>', "xl/pivotTables/_rels/pivotTable1.xml.rels": _rels(("rId1", "pivotCacheDefinition", "../pivotCache/pivotCacheDefinition1.xml", "")),
        "xl/pivotCache/pivotCacheDefinition1.xml": '<pivotCacheDefinition xmlns="x"><cacheSource type="worksheet"><worksheetSource sheet="Inputs" ref="A1:C9"/></cacheSource></pivotCacheDefinition>',
        "xl/pivotTables/pivotTable2.xml": '<pivotTableDefinition xmlns="x" name="P2"/>', "xl/pivotTables/_rels/pivotTable2.xml.rels": _rels(("rId1", "pivotCacheDefinition", "../pivotCache/pivotCacheDefinition2.xml", "")),
        "xl/pivotCache/pivotCacheDefinition2.xml": '<pivotCacheDefinition xmlns="x"><cacheSource type="external" connectionId="1"/></pivotCacheDefinition>',
        "xl/queryTables/queryTable1.xml": '<queryTable xmlns="x" name="QT" connectionId="1"/>', "xl/queryTables/queryTable2.xml": f'<queryTable xmlns="x" name="Loose{k}" connectionId="99"/>',
        "xl/worksheets/_rels/sheet1.xml.rels": _rels(("rId1", "queryTable", "../queryTables/queryTable1.xml", "")),
        "xl/worksheets/_rels/sheet2.xml.rels": _rels(("rId1", "comments", "../comments1.xml", ""), ("rId2", "oleObject", f"file:///C:/ole/o{k}.docx", "External"), ("rId3", "oleObject", "../embeddings/ole1.bin", "")),
        "xl/comments1.xml": f'<comments xmlns="x"><commentList><comment ref="B2"><text><t>see https://wiki.example.com/{k}, or \\\\files{k}\\a\\b.xlsx.</t></text></comment></commentList></comments>',
        "xl/worksheets/_rels/sheet4.xml.rels": _rels(("rId1", "hyperlink", f"https://links.org/{k}", "External"), ("rId2", "hyperlink", f"\\\\share{k}\\x.xlsx", "External"), ("rId3", "hyperlink", "Notes!A1", "")),
        "xl/worksheets/_rels/sheet5.xml.rels": _rels(("rId1", "pivotTable", "../pivotTables/pivotTable1.xml", ""), ("rId2", "pivotTable", "../pivotTables/pivotTable2.xml", "")),
        "docProps/core.xml": f'<c xmlns:d="d"><d:creator>Writer {k}</d:creator></c>', "docProps/app.xml": f'<p xmlns="x"><Application>Sheets</Application><HyperlinkBase>https://base.org/{k}</HyperlinkBase></p>',
        "docProps/custom.xml": f'<p xmlns="x"><property name="Origin"><v>https://origin.org/{k}</v></property><property name="Plain"><v>nothing</v></property></p>',
        "xl/charts/chart1.xml": f"<c xmlns:c='c'><c:f>'[region_{region}.xlsx]Data'!$B$2:$B$4</c:f><c:f>Inputs!$B$2:$B$4</c:f></c>",
    }
    return writer.workbook_bytes(sheets, names, extra, tails)


def region_book(nations: list[int]) -> bytes:
    """``Data`` with a row for each of 25 nations that reads the world's workbook."""
    rows = [["Nation", "Amount"], *[[f"N{k}", (f"='[world.xlsx]W'!A{k + 1}", k)] for k in nations]]
    table = {
        "xl/tables/table1.xml": f'<table xmlns="x" displayName="Facts" name="Facts" ref="A1:B{len(rows)}"/>', "xl/worksheets/_rels/sheet1.xml.rels": _rels(("rId1", "table", "../tables/table1.xml", "")),
    }
    return writer.workbook_bytes({"Data": rows, "Old": [[1, 2]]}, [("Budget", "Old!$A$1", 1), ("Budget", "Data!$B$2:$B$4", None)], table)


def world_book(nations: list[int]) -> bytes:
    """Numbers of even nations, and references into a file that is not there for odd ones."""
    return writer.workbook_bytes({"W": [[k if k % 2 == 0 else f"=[lost.xlsx]L!A{k + 1}"] for k in nations]})


def books(t) -> DataFrame:
    """(file, content) of all workbooks; the world's lies in a folder below, in other case."""
    c = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey", F.floor(F.col("c_custkey") / KEYS).alias("blk"))
    row = F.struct("c_custkey", "c_name", "c_acctbal")
    customers = c.groupBy("c_nationkey", "blk").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    n = t("nation").select(F.col("n_nationkey"), "n_regionkey")
    made = customers.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("customers").alias("kind"), F.col("c_nationkey").alias("k"), "blk", F.col("n_regionkey").alias("region"), "rows", F.lit(None).cast("array<int>").alias("nations"))
    world = n.agg(F.array_sort(F.collect_list("n_nationkey")).alias("nations"), F.collect_set("n_regionkey").alias("regions"))
    none = F.lit(None).cast(made.schema["rows"].dataType).alias("rows")
    regions = world.select(F.lit("region").alias("kind"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("blk"), F.explode("regions").alias("region"), none, "nations")
    top = world.select(F.lit("world").alias("kind"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("blk"), F.lit(0).alias("region"), none, "nations")

    def write(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            for kind, k, blk, region, rows, nations in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == "customers":
                    file, content = f"{FOLDER}/n{k}_{blk}.xlsx", customer_book(k, region, [(r["c_custkey"], r["c_name"], r["c_acctbal"]) for r in rows])
                elif kind == "region":
                    file, content = f"{FOLDER}/region_{region}.xlsx", region_book(nations)
                else:
                    file, content = f"{FOLDER}/below/World.xlsx", world_book(nations)
                yield pa.RecordBatch.from_pydict({"file": [file], "content": [content]})

    return made.unionByName(regions).unionByName(top).mapInArrow(write, "file string, content binary")
