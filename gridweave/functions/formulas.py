"""Spreadsheet formulas: references, data feeds, translation to SQL text, executable functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# Functions of market-data add-ins by vendor, and confidence of each detector.
VENDOR_FUNCTIONS = (
    ("bloomberg", r"BDP|BDH|BDS|BQL|BSRCH|BLPGET|BQ", 0.95), ("reuters", r"RHistory|RData|RKFGET|TR\.", 0.9), ("factset", r"FDS|FQL|FDSC|FEW|FDSQ", 0.9),
    ("capitaliq", r"CIQCONTENT|CIQ|SPCIQDATA|CIQ_CONTENT|CIQ_FORMULAFIELD|SCS", 0.9), ("snl", r"SNL[DC]?", 0.9), ("wind", r"WSD|WSS|WQ|WQS|WSP", 0.9),
)
_BOOK = r"[^\]]+\.(?:xlsx?|xlsm|xlsb|csv)"


def _found(category: str, sub_type: str, source: Column, confidence: float) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(sub_type).alias("sub_type"), source.alias("source"), F.lit(confidence).alias("confidence"))


def detect(formula: Column) -> Column:
    """An array of the external sources that a formula reads, each detector once."""
    text = F.coalesce(formula, F.lit(""))
    hits = []
    for vendor, names, confidence in VENDOR_FUNCTIONS:
        call = rf"(?i)\b({names})\s*\("
        arg = F.regexp_extract(text, call + r'\s*"([^"]*)"', 2)
        hits.append((text.rlike(call), _found("formula", vendor, F.when(arg != "", arg).otherwise(F.substring(text, 1, 100)), confidence)))
    web = r"""(?i)\bWEBSERVICE\s*\(\s*["']?([^"')\s,]+)"""
    hits.append((text.rlike(web), _found("web", "webservice", F.regexp_extract(text, web, 1), 0.95)))
    hits.append((text.rlike(r"(?i)\bRTD\s*\("), _found("formula", "rtd", F.regexp_extract(text, r'(?i)\bRTD\s*\(\s*"?([^",)]*)', 1), 0.9)))
    https = rf"(?i)'(https?://[^']+)\[({_BOOK})\]"
    remote = F.concat(F.regexp_extract(text, https, 1), F.regexp_extract(text, https, 2))
    low = F.lower(remote)
    for kind, when, category in (
        ("sharepoint_workbook", low.contains("sharepoint"), "file"), ("onedrive_workbook", ~low.contains("sharepoint") & low.rlike("onedrive|d\\.docs\\.live"), "file"),
        ("http_workbook", ~low.rlike("sharepoint|onedrive|d\\.docs\\.live"), "web"),
    ):
        hits.append((text.rlike(https) & when, _found(category, kind, remote, 0.95)))
    numbered = r"(?:^|[=(+\-*,\s])\[(\d+)\]([^!\[]+)!"
    hits.append((text.rlike(numbered), _found("file", "external_workbook_ref", F.concat(F.lit("[ExternalLink"), F.regexp_extract(text, numbered, 1), F.lit("]")), 0.8)))
    indirect = r'(?i)\bINDIRECT\s*\(\s*"?([^")]*)'
    hits.append((text.rlike(r"(?i)\bINDIRECT\s*\("), _found("formula", "indirect_ref", F.regexp_extract(text, indirect, 1), 0.6)))
    book = rf"(?i)\[({_BOOK})\]"
    own = text.rlike(book) & ~text.rlike(https)
    unc, drive = r"(?i)'(\\\\[^'\[]+)\[", r"(?i)'([A-Za-z]:\\[^'\[]+)\["
    name = F.regexp_extract(text, book, 1)
    hits.append((own & text.rlike(unc), _found("file", "unc_path", F.concat(F.regexp_extract(text, unc, 1), name), 0.95)))
    hits.append((own & text.rlike(drive), _found("file", "local_file", F.concat(F.regexp_extract(text, drive, 1), name), 0.95)))
    hits.append((own & ~text.rlike(unc) & ~text.rlike(drive), _found("file", "external_workbook", name, 0.95)))
    return F.filter(F.array(*[F.when(c, x) for c, x in hits]), lambda x: x.isNotNull())


def external_reference(formula: Column) -> Column:
    """path, file, sheet and cell of the first reference into another workbook."""
    full = rf"(?i)'?([A-Za-z]:\\[^'\[]*|\\\\[^'\[]*|https?://[^'\[]+)?\[({_BOOK})\]([^'!]*)'?!(\$?[A-Z]+\$?[0-9]+(?::\$?[A-Z]+\$?[0-9]+)?)"
    part = lambda k: F.regexp_extract(formula, full, k)
    loose = rf"(?i)\[({_BOOK})\]([^'!]*)"
    bare = r"(?i)'((?:\\\\|[A-Za-z]:\\)[^']+)'"
    tail = F.element_at(F.split(F.regexp_extract(formula, bare, 1), r"\\"), -1)
    known = formula.rlike(full)
    pick = lambda a, b, c: F.when(known, a).when(formula.rlike(loose), b).when(formula.rlike(bare), c)
    nothing = F.lit("")
    return F.struct(
        pick(part(1), nothing, F.regexp_extract(formula, bare, 1)).alias("path"), pick(part(2), F.regexp_extract(formula, loose, 1), tail).alias("file"),
        pick(part(3), F.regexp_extract(formula, loose, 2), nothing).alias("sheet"), pick(part(4), nothing, nothing).alias("cell"),
    )


def confidence(named: Column, is_input: Column, label: Column, header: Column, labelled: Column) -> Column:
    """How surely a typed-in number is an input; null where nothing speaks for it."""
    return (
        F.when(named, 0.95).when(is_input & label, 0.9).when(is_input, 0.7).when(header, 0.85).when(labelled, 0.75)
    )


# Power Query connector functions in the order in which they are looked for, and
# the kind of source that each names. ``db``: the second argument is a database.
CONNECTORS = (
    ("sql_server", "Sql.Database", "db"), ("azure_sql", "AzureSQLDatabase.Database", "db"), ("azure_sql_dw", "AzureSQLDataWarehouse.Database", "db"), ("oracle", "Oracle.Database", ""),
    ("postgresql", "PostgreSQL.Database", "db"), ("mysql", "MySQL.Database", "db"), ("db2", "DB2.Database", "db"), ("teradata", "Teradata.Database", ""), ("sybase", "Sybase.Database", "db"),
    ("informix", "Informix.Database", "db"), ("sap_hana", "SapHana.Database", ""), ("sap_bw", "SapBusinessWarehouse.Cubes", ""), ("sap_bobj", "SapBusinessObjects.Universe", ""),
    ("snowflake", "Snowflake.Databases", ""), ("bigquery", "GoogleBigQuery.Database", ""), ("redshift", "Amazon.Redshift", ""), ("databricks", "Databricks.Catalogs", ""),
    ("databricks", "Databricks.Contents", ""), ("mongodb", "MongoDB.Find", ""), ("impala", "Impala.Database", "db"), ("access", "Access.Database", "file"), ("odbc", "Odbc.DataSource", ""),
    ("odbc", "Odbc.Query", ""), ("oledb", "OleDb.DataSource", ""), ("oledb", "OleDb.Query", ""), ("azure_blob", "AzureStorage.Blobs", ""), ("azure_datalake", "AzureStorage.DataLake", ""),
    ("azure_datalake", "AzureStorage.DataLakeGen2", ""), ("azure_tables", "AzureStorage.Tables", ""), ("azure_cosmos", "AzureCosmosDB.Feed", ""), ("azure_as", "AzureAnalysisServices.Database", "db"),
    ("hdfs", "Hdfs.Files", ""), ("hdinsight", "AzureHDInsight.Tables", ""), ("sharepoint", "SharePoint.Files", ""), ("sharepoint", "SharePoint.Tables", ""), ("sharepoint", "SharePoint.List", ""),
    ("salesforce", "Salesforce.Data", "optional"), ("salesforce", "Salesforce.Reports", "optional"), ("dynamics", "CommonDataService.Database", ""), ("dynamics", "Dynamics365.BusinessCentral", ""),
    ("exchange", "Exchange.Contents", ""), ("active_directory", "ActiveDirectory.Domains", ""), ("powerbi", "PowerBI.Datasets", "optional"), ("powerbi", "PowerBI.Dataflows", "optional"),
    ("web", "Web.Contents", ""), ("web", "Web.BrowserContents", ""), ("odata", "OData.Feed", ""), ("html_table", "Html.Table", "none"), ("file_excel", "Excel.Workbook", "file"),
    ("file_excel", "File.Contents", "xls"), ("file_csv", "Csv.Document", "file"), ("file_json", "Json.Document", "file"), ("file_xml", "Xml.Document", "file"), ("file_xml", "Xml.Tables", "file"),
    ("file_pdf", "Pdf.Tables", "file"), ("file_text", "Lines.FromBinary", "file"), ("file_text", "File.Contents", ""), ("folder", "Folder.Files", ""), ("folder", "Folder.Contents", ""),
    ("self_workbook", "Excel.CurrentWorkbook", "none"),
)


def _connector_pattern(function: str, shape: str) -> str:
    call = re.escape(function) + r"\s*\("
    quoted = r'\s*"([^"]+)"'
    return {
        "": call + quoted, "db": call + quoted + r"\s*," + quoted, "file": call + r".*?File\.Contents\s*\(" + quoted, "xls": call + r'\s*"([^"]+\.xlsx?[^"]*)"',
        "optional": call + r'\s*(?:["\[]([^"\]]+)["\]])?', "none": call,
    }[shape]


_COMPILED = [(kind, re.compile(_connector_pattern(f, shape), re.I | re.S)) for kind, f, shape in CONNECTORS]


def query_sources(code: str | None) -> list[tuple[str, str]]:
    """(kind, source) of each data source in Power Query code, in the connectors' order; the
    name of some function where no connector is known."""
    found: dict[tuple[str, str], None] = {}
    for kind, pattern in _COMPILED:
        for m in pattern.finditer(code or ""):
            found[kind, "/".join(g for g in m.groups() if g)] = None
    if not found and (m := re.search(r"=\s*([A-Za-z]+\.[A-Za-z]+)\s*\(", code or "")):
        found["m_function", m[1]] = None
    return [*found]


# Spreadsheet functions and the name each has in SQL-like text.
SQL_NAMES = {
    "SUM": "SUM", "AVERAGE": "AVG", "COUNT": "COUNT", "COUNTA": "COUNT", "COUNTIF": "COUNT_IF", "COUNTIFS": "COUNT_IF", "SUMIF": "SUM_IF", "SUMIFS": "SUM_IF", "SUMPRODUCT": "SUM_PRODUCT",
    "MIN": "MIN", "MAX": "MAX", "MEDIAN": "MEDIAN", "STDEV": "STDDEV", "STDEVP": "STDDEV_POP", "VAR": "VARIANCE", "VARP": "VARIANCE_POP",
    "ABS": "ABS", "ROUND": "ROUND", "ROUNDUP": "CEIL", "ROUNDDOWN": "FLOOR", "INT": "FLOOR", "MOD": "MOD", "POWER": "POWER", "SQRT": "SQRT", "LN": "LN", "LOG": "LOG", "LOG10": "LOG10", "EXP": "EXP",
    "LEFT": "LEFT", "RIGHT": "RIGHT", "MID": "SUBSTR", "LEN": "LENGTH", "TRIM": "TRIM", "UPPER": "UPPER", "LOWER": "LOWER", "CONCATENATE": "CONCAT", "SUBSTITUTE": "REPLACE", "FIND": "INSTR", "SEARCH": "INSTR", "TEXT": "FORMAT",
    "IF": "CASE WHEN", "AND": "AND", "OR": "OR", "NOT": "NOT", "IFERROR": "COALESCE", "IFNA": "COALESCE", "IFS": "CASE",
    "VLOOKUP": "JOIN_LOOKUP", "HLOOKUP": "JOIN_LOOKUP", "XLOOKUP": "JOIN_LOOKUP", "INDEX": "INDEX", "MATCH": "MATCH", "OFFSET": "OFFSET",
    "TODAY": "CURRENT_DATE", "NOW": "CURRENT_TIMESTAMP", "YEAR": "YEAR", "MONTH": "MONTH", "DAY": "DAY", "DATE": "DATE", "DATEDIF": "DATEDIFF", "EDATE": "DATE_ADD", "EOMONTH": "LAST_DAY",
}

TOKEN = re.compile(
    r"""(?P<text>"(?:[^"]|"")*")|(?P<ref>(?:(?:'(?P<quoted>[^']+)'|(?P<plain>[A-Za-z0-9_.\[\]]+))!)?(?P<cell>\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?)(?![A-Za-z0-9_(]))"""
    r"""|(?P<call>[A-Za-z][A-Za-z0-9_.]*)\s*\(|(?P<op><>|<=|>=|[-+*/^&=<>])|(?P<open>\()|(?P<close>\))|(?P<comma>,)|(?P<other>[^\s()",&<>=*/^+-]+)|(?P<space>\s+)"""
)


def to_sql(formula: str | None, names: dict[str, str] | None = None) -> str:
    """SQL-like text of a formula: references by name, functions by SQL name, IF as CASE."""
    names = names or {}
    body = (formula or "").removeprefix("=")
    #: Open calls: the name, and the pieces of its arguments so far.
    stack: list[tuple[str | None, list[list[str]]]] = [(None, [[]])]

    def say(piece: str) -> None:
        stack[-1][1][-1].append(piece)

    def close() -> None:
        name, args = stack.pop()
        texts = ["".join(a).strip() if name == "IF" else "".join(a) for a in args]
        if name == "IF" and len(texts) >= 2:
            rest = f" ELSE {','.join(texts[2:])}" if len(texts) > 2 else ""
            say(f"CASE WHEN {texts[0]} THEN {texts[1]}{rest} END")
        else:
            say(f"{SQL_NAMES.get(name, name) if name else ''}({','.join(texts)})")

    at = 0
    while at < len(body):
        m = TOKEN.match(body, at)
        if not m:
            say(body[at])
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("quoted", "plain", "cell") else "ref"
        if m["call"]:
            stack.append((m["call"].upper(), [[]]))
        elif m["open"]:
            stack.append((None, [[]]))
        elif m["close"] and len(stack) > 1:
            close()
        elif m["comma"] and len(stack) > 1:
            stack[-1][1].append([])
        elif m["ref"]:
            cell, sheet = m["cell"].replace("$", ""), (m["quoted"] or m["plain"] or "").strip("[]")
            full = f"{sheet}!{cell}" if sheet else cell
            say(names.get(full) or names.get(cell) or full)
        elif kind == "op":
            say({"<>": "!=", "&": " || "}.get(m[0], m[0]))
        else:
            say(m[0])
    while len(stack) > 1:  # left open: as it stands
        name, args = stack.pop()
        say(f"{SQL_NAMES.get(name, name) if name else ''}({','.join(''.join(a) for a in args)}")
    return "".join(stack[0][1][0]) if len(stack[0][1]) == 1 else ",".join("".join(a) for a in stack[0][1])
