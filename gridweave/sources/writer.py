"""Writers: workbook archives by the standard library, JSON reports, diagram text, HTML."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path

from .workbook import column_letters

_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def workbook_bytes(sheets: dict[str, Iterable[Iterable]], names: dict[str, str] | list[tuple[str, str, int | None]] | None = None, extra: dict[str, str] | None = None, sheet_tails: dict[str, str] | None = None) -> bytes:
    """An .xlsx archive. Strings that begin with ``=`` are formulas, ``(formula, value)`` pairs
    formulas with a stored value; ``names`` are values by name, or (name, value, place of the sheet
    that it belongs to); ``extra`` adds parts, ``sheet_tails`` XML at a sheet's end."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        many = [*sheets]
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(many) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_REL}"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{html.escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(many, 1))
        listed_names = [(n, v, None) for n, v in names.items()] if isinstance(names, dict) else names or []
        defined = "".join(f'<definedName name="{n}"' + (f' localSheetId="{k}"' if k is not None else "") + f">{html.escape(v)}</definedName>" for n, v, k in listed_names)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{listed}</sheets>' + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(many) + 1)) + "</Relationships>")
        for k, s in enumerate(many, 1):
            rows = []
            for r, row in enumerate(sheets[s], 1):
                rows.append(f'<row r="{r}">' + "".join(_cell(f"{column_letters(c)}{r}", v) for c, v in enumerate(row, 1) if v is not None) + "</row>")
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheetData>{"".join(rows)}</sheetData>{(sheet_tails or {}).get(s, "")}</worksheet>')
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def _cell(ref: str, v) -> str:
    stored = ""
    if isinstance(v, tuple):
        v, stored = v[0], f"<v>{v[1]}</v>"
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if str(v).startswith("="):
        return f'<c r="{ref}"><f>{html.escape(str(v)[1:])}</f>{stored}</c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{html.escape(str(v))}</t></is></c>'


def safe_sheet_name(name: str, used: set[str], longest: int = 31) -> str:
    base = re.sub(r"[\\/*?:\[\]]", "_", name)[:longest] or "Sheet"
    out, k = base, 1
    while out.lower() in used:
        k += 1
        out = f"{base[: longest - len(str(k)) - 1]}_{k}"
    used.add(out.lower())
    return out


def report_bytes(tables: dict[str, tuple[list[str], Iterable[Iterable]]]) -> bytes:
    """A workbook of report tables: a sheet each, with a header row. Reports are summaries whose
    rows a person reads; large results are written with ``DataFrame.write``."""
    used: set[str] = set()
    return workbook_bytes({safe_sheet_name(n, used): [head, *([x if x is None or isinstance(x, (int, float, bool)) else str(x)[:32_000].lstrip("=") for x in r] for r in rows)] for n, (head, rows) in tables.items()})


def write_report(path: str | Path, tables: dict[str, tuple[list[str], Iterable[Iterable]]]) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(report_bytes(tables))
    return path


def json_report(file: str, scanned_at: str, by_category: dict[str, int], by_type: dict[str, int], connections: list[dict]) -> str:
    summary = {"total_connections": len(connections), "by_category": by_category, "by_sub_type": by_type}
    return json.dumps({"file": file, "scanned_at": scanned_at, "summary": summary, "connections": connections}, indent=2, default=str)


def node_name(text: str, prefix: str = "N_") -> str:
    return (prefix + re.sub(r"[^A-Za-z0-9]", "_", text))[:80]


def mermaid(nodes: dict[str, str], edges: Iterable[tuple[str, str, str | None]], groups: dict[str, list[str]] | None = None, direction: str = "TD", classes: dict[str, str] | None = None) -> str:
    """Flowchart text: nodes by id with labels, edges with optional labels, subgraphs by title."""
    quote = lambda s: s.replace('"', "'")
    lines, placed = [f"flowchart {direction}"], set()
    for k, (title, members) in enumerate((groups or {}).items()):
        lines.append(f'    subgraph SG{k}["{quote(title)}"]')
        for n in members:
            placed.add(n)
            lines.append(f'        {n}["{quote(nodes[n])}"]')
        lines.append("    end")
    lines += [f'    {n}["{quote(label)}"]' for n, label in nodes.items() if n not in placed]
    lines += [f"    {a} -->|{quote(label)}| {b}" if label else f"    {a} --> {b}" for a, b, label in edges]
    for n, c in (classes or {}).items():
        lines.append(f"    class {n} {c}")
    return "\n".join(lines) + "\n"


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>%s</title><style>
body{font:14px sans-serif;margin:1rem}li{cursor:pointer}.off{opacity:.25}
</style></head><body><h1>%s</h1><pre>%s</pre><ul id="nodes"></ul><script>
const graph = %s;
const near = (from, to, id) => {
  const seen = new Set([id]);
  for (const todo = [id]; todo.length;) {
    const at = todo.pop();
    for (const e of graph.edges) if (e[from] === at && !seen.has(e[to])) { seen.add(e[to]); todo.push(e[to]); }
  }
  return seen;
};
const list = document.getElementById("nodes");
for (const n of graph.nodes) {
  const li = document.createElement("li");
  li.textContent = n.label;
  li.dataset.id = n.id;
  li.onclick = () => {
    const on = new Set([...near("source", "target", n.id), ...near("target", "source", n.id)]);
    for (const x of list.children) x.classList.toggle("off", !on.has(x.dataset.id));
  };
  list.append(li);
}
</script></body></html>
"""


def html_page(text: str, nodes: dict[str, str], edges: Iterable[tuple[str, str]], title: str = "Lineage") -> str:
    """A page on which a click on a node leaves its ancestors and descendants lit."""
    graph = {"nodes": [{"id": i, "label": n} for i, n in nodes.items()], "edges": [{"source": a, "target": b} for a, b in edges]}
    data = json.dumps(graph, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return _PAGE % (html.escape(title), html.escape(title), html.escape(text), data)
