"""Connection extractors: each turns one open workbook into connection rows.

The registry's order is the order in which equal connections win. Cell formulas are detected
natively on the cells relation (``plans.detect``); the functions here read small parts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

from ..functions.formulas import query_sources
from ..sources.macros import modules
from ..sources.workbook import Book, local, split_ref

CONNECTIONS = (
    "file string, extractor int, seq int, id string, category string, sub_type string, source string, raw_connection string, location string, query_text string, "
    "confidence double, metadata string"
)
# The type numbers of workbook connections.
CONNECTION_TYPES = {"1": "odbc", "2": "dao", "3": "text", "4": "web", "5": "oledb", "6": "text", "7": "ado", "8": "dsp"}
ATTRIBUTION = re.compile(r"(?i)\b(source|per|from|bloomberg|reuters|factset|capital iq|according to|based on)\b")
INPUT_SHEET = re.compile(r"(?i)(input|assumption|parameter|driver|config|setting)")
_URL, _PATH = re.compile(r"https?://[^\s<>\"']+"), re.compile(r"(?:\\\\[\w.$-]+\\[^\s<>\"'|?*]+|[A-Za-z]:\\[^\s<>\"'|?*]+)")


def connection_id(category: str, raw: str, location: str) -> str:
    return f"{category[:3]}_{hashlib.sha256(f'{category}|{raw}|{location}'.encode()).hexdigest()[:12]}"


def made(category, sub_type, source, raw, location, confidence=0.9, query=None, **metadata):
    return connection_id(category, raw, location), category, sub_type, source, raw, location, query, confidence, json.dumps({k: v for k, v in metadata.items() if v}, sort_keys=True)


def path_kind(path: str) -> tuple[str, str]:
    low = path.lower()
    if low.startswith(("http://", "https://")):
        kind = "sharepoint_workbook" if "sharepoint" in low else "onedrive_workbook" if re.search(r"onedrive|1drv|d\.docs\.live", low) else "http_workbook"
        return ("web" if kind == "http_workbook" else "file"), kind
    return "file", "unc_path" if path.startswith("\\\\") else "local_file" if re.match(r"[a-z]:|file:", low) else "external_workbook"


def normal_path(target: str) -> str:
    target = unquote(target)
    if re.match(r"file:///[A-Za-z]:", target):
        return target[8:].replace("/", "\\")
    return target[5:].replace("/", "\\") if target.startswith("file://") else target


def _children(el, name: str) -> Iterator:
    return (x for x in el.iter() if local(x.tag) == name)


def settings(text: str) -> dict[str, str]:
    """The first of equal keys of a connection string; semicolons in quotes do not split."""
    out: dict[str, str] = {}
    for m in re.finditer(r"""([^=;]+)=("[^"]*"|'[^']*'|\{[^}]*\}|[^;]*)""", text or ""):
        out.setdefault(m[1].strip().lower(), m[2].strip().strip("\"'{}"))
    return out


def describe(text: str) -> tuple[str, str]:
    """(kind of source, label) of a connection string."""
    from ..functions.text import DRIVERS, PROVIDERS, SETTING_NAMES

    s = settings(text)
    got = {name: next((s[k] for k in keys if s.get(k)), "") for name, keys in SETTING_NAMES.items()}
    kind = next((k for part, k in PROVIDERS if part in got["provider"].lower()), None) or next((k for part, k in DRIVERS if part in got["driver"].lower()), None) or ("odbc_dsn" if got["dsn"] else "odbc")
    label = f"{got['server']}/{got['database']}" if got["server"] and got["database"] else got["server"] or (got["dsn"] and f"DSN:{got['dsn']}") or got["database"] or kind
    return kind, label


def workbook_connections(book: Book) -> Iterator[tuple]:
    root = book.xml("xl/connections.xml")
    for el in _children(root, "connection") if root is not None else ():
        name, number = el.get("name", ""), el.get("type", "")
        category, kind, raw, query = "database", CONNECTION_TYPES.get(number, f"type_{number}"), "", None
        label = name
        for x in el:
            part = local(x.tag)
            if part == "dbPr":
                raw, query = x.get("connection", ""), x.get("command")
                if raw:
                    kind, label = describe(raw)
            elif part == "webPr":
                category, kind, raw = "web", "web_query", x.get("url", "")
                label = raw or name
            elif part == "textPr":
                category, kind, raw = "file", "text", x.get("sourceFile", "")
                label = raw or name
            elif part == "olapPr":
                category, kind = "database", "olap"
        yield made(category, kind, label, raw or name, "xl/connections.xml", 0.95, query, connection_name=name, connection_id=el.get("id"))


def power_queries(book: Book) -> Iterator[tuple]:
    found: list[tuple[str, str, str]] = []
    for part in book.names:
        if re.fullmatch(r"(?:xl/)?customXml/[^/]+\.xml", part) and (data := book.raw(part)):
            text = data.decode("utf-8", "replace")
            if "{" in text and "}" in text:
                try:
                    got = json.loads(text[text.index("{") : text.rindex("}") + 1])
                except ValueError:
                    got = {}
                lists = [got.get("Queries"), got.get("queries"), *[v for v in got.values() if isinstance(v, list)]]
                rows = next((v for v in lists if isinstance(v, list) and v and isinstance(v[0], dict)), [])
                found += [(r.get("Name", ""), r["Formula"], part) for r in rows if isinstance(r, dict) and r.get("Formula")]
            found += [("", m.strip(), part) for m in re.findall(r"<Formula>(.*?)</Formula>", text, re.S) if len(m.strip()) >= 5]
    for name, code, part in found:
        for k, (kind, source) in enumerate(query_sources(code) or [("m_formula", name)]):
            yield made("powerquery", kind, source or name, source or code[:200], f"{part}:{name}", 0.95, code if k == 0 else None, query_name=name)
    root = book.xml("xl/connections.xml")
    for el in _children(root, "connection") if root is not None else ():
        if re.match(r"Query(?: - |_)", el.get("name", "")):
            yield made("powerquery", "powerquery", el.get("name"), el.get("name"), "xl/connections.xml", 0.9)


def external_links(book: Book) -> Iterator[tuple]:
    for part in book.names:
        m = re.fullmatch(r"xl/externalLinks/externalLink(\d+)\.xml", part)
        root = book.xml(part) if m else None
        if root is None:
            continue
        for x in _children(root, "ddeLink"):
            label = f"{x.get('ddeService', '')}|{x.get('ddeTopic', '')}"
            yield made("file", "dde_link", label, label, part, 0.9)
        rels = book.rels(part)
        for x in _children(root, "oleLink"):
            target = next((t for t, _, _ in rels.values()), x.get("progId", ""))
            yield made("ole", "ole_link", target, target, part, 0.9, program=x.get("progId"))
        for x in _children(root, "externalBook"):
            rid = next((v for k, v in x.attrib.items() if local(k) == "id"), "")
            if rid in rels:
                path = normal_path(rels[rid][0])
                tabs = [s.get("val", "") for s in _children(x, "sheetName")]
                yield made(*path_kind(path), path, path, part, 0.95, link_index=int(m[1]), sheets=tabs)


# What macro code says about its sources: (category, sub type, pattern, confidence, least length).
# A sub type of None is read from the connection string or the path that was found.
_VBA = (
    ("database", None, re.compile(r"""(?:ConnectionString|\.Open)\s*=?\s*\(?\s*"([^"]*=[^"]*)\"""", re.I), 0.85, 5),
    ("vba", "sql", re.compile(r'"\s*((?:SELECT|INSERT|UPDATE|DELETE|EXEC(?:UTE)?)\b[^"]{5,500})"', re.I), 0.8, 15),
    ("file", "workbooks_open", re.compile(r'Workbooks\.Open\s*\(?\s*(?:Filename:=)?\s*"([^"]+)"', re.I), 0.9, 1),
    ("web", "xmlhttp_request", re.compile(r'\.Open\s*\(?\s*"(?:GET|POST|PUT|DELETE|PATCH)"\s*,\s*"([^"]+)"', re.I), 0.9, 1),
    ("file", None, re.compile(r'GetObject\s*\(\s*"([^"]+)"', re.I), 0.85, 3),
    ("file", "text", re.compile(r'(?:\bOpen|OpenTextFile|OpenText)\s*\(?\s*(?:Filename:=)?"([A-Za-z]:\\[^"]+|\\\\[^"]+)"', re.I), 0.85, 5),
    ("web", "web_query", re.compile(r'QueryTables\.Add\s*\(?[^"\n]*"URL;([^"]+)"', re.I), 0.85, 5),
    ("file", "local_file", re.compile(r"[A-Za-z]:\\(?:[^\"'\n\\/:*?<>|]+\\)*[^\"'\n\\/:*?<>|]*\.(?:xlsx?|xlsm|xlsb|csv|txt|mdb|accdb)", re.I), 0.85, 5),
    ("file", "unc_path", re.compile(r"\\\\[\w.$-]+\\[^\s\"'\n]+"), 0.8, 5),
    ("web", "url", re.compile(r"https?://[^\s\"'<>)]+", re.I), 0.75, 10),
)
_ADODB, _XMLHTTP = re.compile(r"ADODB\.Connection", re.I), re.compile(r"(?:MSXML2|Microsoft)\.(?:Server)?XMLHTTP|WinHttp\.WinHttpRequest", re.I)
_SETTING = re.compile(r"\b(Provider|Data Source|Server|Initial Catalog|Database|DSN)\s*=\s*([^;\"'\n]+)", re.I)


def macro_sources(code: str, module: str) -> Iterator[tuple]:
    """Sources that macro code names, each once for a pattern, with the line that it stands on.

    Where a database object is made without a whole connection string, its parts are put together.
    """
    whole = False
    for category, kind, pattern, sure, least in _VBA:
        if kind == "xmlhttp_request" and not _XMLHTTP.search(code):
            continue
        seen = set()
        for m in pattern.finditer(code):
            raw = (m[1] if m.groups() else m[0]).strip()
            raw = raw.rstrip(".,;)") if kind in ("url", "unc_path", "xmlhttp_request") else raw
            if len(raw) < least or raw in seen:
                continue
            seen.add(raw)
            where = f"{module}:{code.count(chr(10), 0, m.start()) + 1}"
            if category == "database":
                whole = True
                sub, label = describe(raw)
                yield made(category, sub, label, raw, where, sure, has_adodb=bool(_ADODB.search(code)))
            elif kind is None:
                cat, sub = ("web", "url") if re.match(r"https?://", raw, re.I) else ("file", "unc_path" if raw.startswith("\\\\") else "local_file")
                yield made(cat, sub, raw, raw, where, sure, via="GetObject")
            elif kind == "sql":
                yield made(category, kind, f"SQL in {module}", raw, where, sure, raw)
            else:
                yield made(category, kind, raw[:100], raw, where, sure)
    if not whole and _ADODB.search(code):
        parts = {m[1].lower(): m[2].strip() for m in _SETTING.finditer(code)}
        if parts:
            raw = "; ".join(f"{k}={v}" for k, v in parts.items())
            sub, label = describe(raw)
            yield made("database", sub, label, raw, module, 0.7, components=parts)


def macros(book: Book) -> Iterator[tuple]:
    """Sources in each module of the macro project; in its raw bytes, if no module can be read."""
    data = book.raw("xl/vbaProject.bin")
    found = modules(data) if data else []
    for name, code in found:
        yield from macro_sources(code, f"VBA:{name}")
    if data and not found:
        yield from macro_sources(data.decode("latin-1"), "xl/vbaProject.bin")


def _sheet_of(book: Book, part: str, kind: str) -> str:
    """The sheet whose relationships lead to a part."""
    for name, sheet_part, _ in book.sheets():
        if any(t[1].endswith(kind) and book.resolve(sheet_part, t[0]) == part for t in book.rels(sheet_part).values()):
            return name
    return ""


def pivots(book: Book) -> Iterator[tuple]:
    for part in book.names:
        if not re.fullmatch(r"xl/pivotTables/[^/]+\.xml", part) or book.xml(part) is None:
            continue
        cache = next((book.resolve(part, t[0]) for t in book.rels(part).values() if t[1].endswith("pivotCacheDefinition")), "")
        root = book.xml(cache) if cache else None
        where = f"{_sheet_of(book, part, 'pivotTable')}:{book.xml(part).get('name', '')}"
        src = next(_children(root, "cacheSource"), None) if root is not None else None
        if src is None:
            yield made("pivot", "internal", cache or part, cache or part, where, 0.6)
            continue
        ws = next(_children(src, "worksheetSource"), None)
        if src.get("type") == "external":
            label = f"connection {src.get('connectionId', '')}"
            yield made("pivot", "external_db", label, label, where, 0.7)
        elif src.get("type") == "consolidation":
            yield made("pivot", "consolidation", cache, cache, where, 0.7)
        elif ws is not None:
            label = f"{ws.get('sheet', '')}!{ws.get('ref') or ws.get('name', '')}"
            yield made("pivot", "worksheet", label, label, where, 0.7)


def query_tables(book: Book) -> Iterator[tuple]:
    root = book.xml("xl/connections.xml")
    known = {el.get("id"): el for el in _children(root, "connection")} if root is not None else {}
    for part in book.names:
        if re.fullmatch(r"xl/queryTables/[^/]+\.xml", part) and (el := book.xml(part)) is not None:
            con = known.get(el.get("connectionId"))
            label = con.get("name") if con is not None else el.get("name", part)
            raw = next((x.get("connection", "") for x in con if local(x.tag) == "dbPr"), "") if con is not None else ""
            yield made("database", "querytable", label, raw or label, f"{_sheet_of(book, part, 'queryTable')}:{el.get('name', '')}", 0.9)


def hyperlinks(book: Book) -> Iterator[tuple]:
    for sheet, part, _ in book.sheets():
        root, rels = book.xml(part), book.rels(part)
        for x in _children(root, "hyperlink") if root is not None else ():
            rid = next((v for k, v in x.attrib.items() if local(k) == "id"), "")
            if rid not in rels:
                continue
            target, _, mode = rels[rid]
            if mode != "External" and not re.match(r"(?i)https?:|file:|mailto:|\\\\|[a-z]:\\", target):
                continue
            low = target.lower()
            kind = "http" if low.startswith(("http:", "https:")) else "file_url" if low.startswith("file:") else "unc_path" if target.startswith("\\\\") else "mailto" if low.startswith("mailto:") else "local_file" if re.match(r"[a-z]:[\\/]", low) else "hyperlink"
            yield made("hyperlink", kind, target, target, f"{sheet}!{x.get('ref', '')}", 0.95, display=x.get("display"))


def named_ranges(book: Book) -> Iterator[tuple]:
    for name, _, value, *_ in book.defined_names():
        if m := re.search(r"\[([^\]]+)\]", value):
            source = m[1]
            if source.isdigit():
                source = book.link_targets().get(int(source), (f"[ExternalLink{source}]", ""))[0]
            yield made("file", "named_range_external", source, value, f"definedName:{name}", 0.9, name=name)


def comments(book: Book) -> Iterator[tuple]:
    for sheet, part, _ in book.sheets():
        for target, kind, _ in book.rels(part).values():
            if kind.endswith(("/comments", "/threadedComment")) and (root := book.xml(book.resolve(part, target))) is not None:
                for c in root.iter():
                    if local(c.tag) in ("comment", "threadedComment"):
                        text = "".join(t.text or "" for t in c.iter() if local(t.tag) in ("t", "text"))
                        for url in _URL.findall(text):
                            url = url.rstrip(".,;)")
                            if len(url) >= 10:
                                yield made("hyperlink", "comment_url", url, url, sheet, 0.7)
                        for path in _PATH.findall(text):
                            path = path.rstrip(".,;)")
                            if len(path) >= 5:
                                yield made(*path_kind(path), path, path, sheet, 0.7)


def document_properties(book: Book) -> Iterator[tuple]:
    for part, kind in (("docProps/core.xml", "core_properties"), ("docProps/app.xml", "app_properties")):
        root = book.xml(part)
        if root is None:
            continue
        got = {local(x.tag): x.text for x in root if x.text and x.text.strip()}
        if kind == "app_properties" and got.get("HyperlinkBase"):
            yield made("metadata", "hyperlink_base", got["HyperlinkBase"], got["HyperlinkBase"], part, 0.9)
        if got:
            label = got.get("creator") or got.get("Application") or kind
            yield made("metadata", kind, label, json.dumps(got, sort_keys=True), part, 0.5, **got)
    root = book.xml("docProps/custom.xml")
    for x in _children(root, "property") if root is not None else ():
        value = "".join(t.text or "" for t in x)
        hit = _URL.search(value) or _PATH.search(value)
        if hit:
            kind = "custom_property_url" if _URL.search(value) else "custom_property_file_path"
            yield made("metadata", kind, hit[0], value, f"docProps/custom.xml:{x.get('name', '')}", 0.8)


def ole_objects(book: Book) -> Iterator[tuple]:
    for n in book.names:
        if re.fullmatch(r"xl/(?:drawings|worksheets)/_rels/[^/]+\.rels", n):
            owner = n.replace("_rels/", "").removesuffix(".rels")
            for rid, (target, kind, mode) in book.rels(owner).items():
                if "oleObject" in kind:
                    out = mode == "External" or bool(re.match(r"(?i)https?:|file:|\\\\|[a-z]:\\", target))
                    yield made("ole", "external_link" if out else "embedded", target, target, f"{owner}:{rid}", 0.9)


def table_regions(places: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """Groups of cells that touch along rows or columns."""
    left, out = set(places), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            r, c = at = todo.pop()
            group.add(at)
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
        out.append(group)
    return out


def hardcoded_values(book: Book) -> Iterator[tuple]:
    from ..sources.workbook import column_letters

    strings = book.shared_strings()
    named = {(s, r): n for n, _, _, s, r, *_ in book.defined_names() if s and r and ":" not in r}
    for sheet, part, _ in book.sheets():
        grid = {(row, col): (ref, kind, has, number, text) for ref, row, col, kind, has, _, number, text in book.cells(part, strings)}
        labels: dict[int, str] = {}
        headers: dict[int, tuple[int, str]] = {}
        for (row, col), (ref, _, has, _, text) in sorted(grid.items()):
            if text and not has:
                if col <= 4:
                    labels.setdefault(row, text)
                if row <= 2:
                    headers.setdefault(col, (row, text))
                if len(text) >= 8 and ATTRIBUTION.search(text):
                    yield made("input", "source_note", text[:100], text, f"{sheet}!{ref}", 0.7)
        values = {at for at, (_, kind, has, number, _) in grid.items() if number is not None and not has and kind not in ("s", "b", "e")}
        inside: set[tuple[int, int]] = set()
        for group in sorted(table_regions(values), key=min):
            rows, cols = {r for r, _ in group}, {c for _, c in group}
            if len(group) >= 4 and len(rows) >= 2 and len(cols) >= 2 and sum(c in headers for c in cols) >= 2:
                inside |= group
                rng = f"{column_letters(min(cols))}{min(rows)}:{column_letters(max(cols))}{max(rows)}"
                yield made("input", "pasted_table", f"{sheet}!{rng}", f"{sheet}!{rng}", f"{sheet}!{rng}", 0.75, headers=[headers[c][1] for c in sorted(cols) if c in headers])
        entry = bool(INPUT_SHEET.search(sheet))
        for row, col in sorted(values - inside):
            ref, _, _, number, _ = grid[row, col]
            label, header, name = labels.get(row), headers.get(col, (0, ""))[1], named.get((sheet, ref))
            sure = 0.95 if name else (0.9 if label else 0.7) if entry else 0.85 if label and header else 0.75 if label else None
            if sure:
                where = f"{sheet}!{ref}"
                shown = int(number) if number == int(number) and abs(number) < 1e15 else number
                yield (connection_id("input", where, where), "input", "named_input" if name else "hardcoded_value", name or label or where, str(shown), where, None, sure, json.dumps({"label": label, "header": header}, sort_keys=True))


#: Extractors by their place among equals; 3 is the native formula detection.
REGISTRY = (
    (1, workbook_connections), (2, power_queries), (4, external_links), (5, macros), (6, pivots), (7, query_tables), (8, hyperlinks), (9, named_ranges), (10, comments),
    (11, document_properties), (12, ole_objects), (13, hardcoded_values),
)


def connection_rows(file: str, book: Book, registry=REGISTRY) -> Iterator[tuple]:
    """All extractors' rows; one that fails on a workbook costs its own rows only."""
    for place, extract in registry:
        try:
            found = [*extract(book)]
        except Exception:  # noqa: BLE001  an extractor must not end the scan of a damaged workbook
            continue
        for seq, row in enumerate(found):
            yield (file, place, seq, *row)


def other_formulas(book: Book) -> Iterator[tuple[str, str, str]]:
    """(location, formula, origin) of data validations, conditional formats and charts."""
    for sheet, part, _ in book.sheets():
        root = book.xml(part)
        for x in root.iter() if root is not None else ():
            kind = local(x.tag)
            if kind in ("dataValidation", "cfRule"):
                for f in x.iter():
                    if local(f.tag) in ("formula1", "formula2", "formula") and f.text:
                        yield f"{sheet}!{x.get('sqref', '')}", f.text, "data_validation" if kind == "dataValidation" else "conditional_format"
    for part in book.names:
        if re.fullmatch(r"xl/charts/[^/]+\.xml", part) and (root := book.xml(part)) is not None:
            for f in _children(root, "f"):
                if f.text:
                    yield part, f.text, "chart"


def scenarios(book: Book) -> Iterator[tuple[str, str, str, str]]:
    """(sheet, scenario, cell, value) of the scenario manager."""
    for sheet, part, _ in book.sheets():
        root = book.xml(part)
        for s in _children(root, "scenario") if root is not None else ():
            for c in _children(s, "inputCells"):
                if split_ref(c.get("r", "")):
                    yield sheet, s.get("name", ""), c.get("r"), c.get("val", "")
