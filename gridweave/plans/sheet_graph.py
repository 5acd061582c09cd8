"""Sheet-level dependency graph of workbooks, with their connections, as diagram and page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extractors as E
from ..operators import formula_refs as R
from ..sources import diagram, writer
from ..sources import workbook as W


def sheet_edges(books: DataFrame) -> DataFrame:
    """(file, src_book, src, dst): distinct; ``src_book`` is null within the file. References of
    a sheet to itself and to sheets that do not exist are dropped; a file's own name is itself."""

    def rows(file: str, book: W.Book):
        own = R.file_of(file).lower()
        known = {s.lower(): s for s, _, _ in book.sheets()}
        links = {k: v[0] for k, v in book.link_targets().items()}
        seen = set()
        for sheet, part, _ in book.sheets():
            for c in book.cells(part, []):
                if not c[5]:
                    continue
                for target, tab, *_ in R.external_refs(c[5], links):
                    inside = target.lower() == own and tab.lower() in known
                    seen.add((None, known[tab.lower()], sheet) if inside else (target, tab, sheet))
                seen |= {(None, known[s.lower()], sheet) for s, _ in R.inner_refs(c[5], sheet) if s.lower() in known}
        for b, s, d in sorted(seen, key=str):
            if b is not None or s != d:
                yield (file, b, s, d)

    return W.each(books, "file string, src_book string, src string, dst string", rows)


def connection_edges(books: DataFrame) -> DataFrame:
    """(file, connection, kind, sheet): sheet is null for connections that no sheet uses."""

    def rows(file: str, book: W.Book):
        root = book.xml("xl/connections.xml")
        names = {c.get("id"): c.get("name", "") for c in root.iter() if W.local(c.tag) == "connection"} if root is not None else {}
        kinds = {n: (r[2], r[3]) for r in E.workbook_connections(book) if (n := re.search(r'"connection_name": "([^"]*)"', r[8]) and re.search(r'"connection_name": "([^"]*)"', r[8])[1])}
        placed = set()
        for sheet, part, _ in book.sheets():
            for target, kind, _ in book.rels(part).values():
                if kind.endswith(("queryTable", "pivotTable")):
                    inner = book.resolve(part, target)
                    el = book.xml(inner)
                    ids = {el.get("connectionId")} if el is not None and el.get("connectionId") else set()
                    for t, k, _ in book.rels(inner).values():
                        cache = book.xml(book.resolve(inner, t)) if k.endswith("pivotCacheDefinition") else None
                        ids |= {x.get("connectionId") for x in cache.iter() if x.get("connectionId")} if cache is not None else set()
                    placed |= {(i, sheet) for i in ids if i in names}
        for i, n in sorted(names.items()):
            for sheet in sorted(s for j, s in placed if i == j) or [None]:
                yield (file, n, kinds.get(n, ("", ""))[0], sheet)

    return W.each(books, "file string, connection string, kind string, sheet string", rows)


def build(books: DataFrame) -> tuple[str, str]:
    """(diagram text, HTML page) of the books' sheets and connections."""
    nodes: dict[str, str] = {}
    edges: list[tuple[str, str, None]] = []
    classes: dict[str, str] = {}

    def node(book: str | None, sheet: str, kind: str) -> str:
        n = writer.node_name(f"{book or ''}__{sheet}", "EXT__" if book else "CUR__")
        nodes[n], classes[n] = (f"{book}: {sheet}" if book else sheet), kind
        return n

    for r in sheet_edges(books).select("src_book", "src", "dst").distinct().orderBy("src_book", "src", "dst").collect():
        edges.append((node(r["src_book"], r["src"], "external" if r["src_book"] else "sheet"), node(None, r["dst"], "sheet"), None))
    for r in connection_edges(books).select("connection", "kind", "sheet").distinct().orderBy("connection", "sheet").collect():
        n = writer.node_name(r["connection"], "CONN__")
        nodes[n], classes[n] = r["connection"], "connection"
        if r["sheet"]:
            edges.append((n, node(None, r["sheet"], "sheet"), None))
    text = writer.mermaid(nodes, edges, None, "LR", classes)
    return text, writer.html_page(text, nodes, [(a, b) for a, b, _ in edges])


def page_of(text: str, title: str = "Diagram") -> str:
    """Any flowchart text as an interactive page."""
    nodes, edges = diagram.parse(text)
    return writer.html_page(text, nodes, [(a, b) for a, b, _ in edges], title)
