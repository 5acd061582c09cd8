"""References inside formulas with their places: external, named, and within the workbook."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from ..sources.workbook import column_letters, column_number

MAX_EXPANDED, MAX_COL, MAX_DEPTH, MAX_CELLS = 10_000, 16_384, 20, 10_000
_CELL = r"\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}"
_OUTER = re.compile(rf"(?:'([^'\[]*)\[([^\]]+)\]([^']*)'|\[([^\]]+)\]([A-Za-z0-9_.]+))!({_CELL})(?![A-Za-z0-9_(])")
_NAMED = re.compile(r"(?:'([^'\[]*)\[([^\]]+)\]([^']*)'|\[([^\]]+)\]([A-Za-z0-9_.]*)|'([^']+\.xls[xmb]?)'|([A-Za-z0-9_]+\.xls[xmb]?))!([A-Za-z_\\][A-Za-z0-9_.]*)(?![A-Za-z0-9_(!])")
_COLUMNS = r"\[(?:[^\[\]]|\[[^\]]*\])*\]"
_TABLE = re.compile(rf"(?:'?\[([^\]]+\.xls[xmb]?)\]'?|'?([A-Za-z0-9_]+\.xls[xmb]?)'?)!([A-Za-z_][A-Za-z0-9_]*){_COLUMNS}")
#: A table of another workbook without ``!``: ``[book.xlsx]Table``, ``'folder[book.xlsx]'Table[Column]``.
_BARE_TABLE = re.compile(rf"(?:'([^'\[]*)\[([^\]]+\.[^\]]+)\]'|\[([^\]]+\.[^\]]+)\])([A-Za-z_][A-Za-z0-9_]*)(?:{_COLUMNS})?(?![A-Za-z0-9_.!'(])")
_INNER = re.compile(r"(?:(?:'((?:[^'\[]|'')+)'|([A-Za-z_][A-Za-z0-9_.]*))!)?(\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)(?![A-Za-z0-9_(!.])")
_TEXT = re.compile(r'"(?:[^"]|"")*"')


def blank_text(formula: str) -> str:
    """String literals as blanks, so that places stay and their content never matches."""
    return _TEXT.sub(lambda m: " " * len(m[0]), formula)


def file_of(path: str) -> str:
    """The last part of a path or address: escapes resolved, no query and no fragment."""
    return re.split(r"[\\/]", re.sub(r"[?#].*$", "", re.sub(r"^file:/*", "", unquote(path))))[-1]


def external_refs(formula: str, links: dict[int, str]) -> list[tuple[str, str, str, str, str]]:
    """(file, sheet, cell or name, path, kind) of each distinct reference into another workbook.

    A number in brackets is an external link's; one without a target stays ``[ExternalLinkN]``.
    """
    if "[" not in formula and ".xls" not in formula.lower():
        return []
    text = blank_text(formula)
    found: dict[tuple[str, str, str], tuple[str, str, str, str, str]] = {}
    spans: list[tuple[int, int]] = []

    def name_of(book: str, folder: str) -> tuple[str, str]:
        if book.isdigit():
            target = links.get(int(book), f"[ExternalLink{book}]")
            return file_of(target) if not target.startswith("[") else target, target
        return book, folder + book

    for m in _OUTER.finditer(text):
        file, path = name_of(m[2] or m[4], m[1] or "")
        sheet, cell = m[3] or m[5] or "", m[6].replace("$", "").upper()
        spans.append(m.span())
        found.setdefault((file.lower(), sheet.lower(), cell), (file, sheet, cell, path, "cell"))
    free = lambda m: all(m.end() <= a or m.start() >= z for a, z in spans)
    for m in _TABLE.finditer(text):
        if free(m):
            spans.append(m.span())
            file = m[1] or m[2]
            found.setdefault((file.lower(), "", m[3].lower()), (file, "", m[3], file, "table"))
    for m in _NAMED.finditer(text):
        name = m[8]
        if free(m) and not re.fullmatch(r"[A-Za-z]{1,3}\d+", name):
            file, path = name_of(m[2] or m[4] or m[6] or m[7], m[1] or "")
            qualifier = m[3] or m[5] or ""
            found.setdefault((file.lower(), qualifier.lower(), name.lower()), (file, qualifier, name, path, "named_range"))
            spans.append(m.span())
    for m in _BARE_TABLE.finditer(text):
        if free(m) and not re.fullmatch(r"[A-Za-z]{1,3}\d+", m[4]):
            file = m[2] or m[3]
            found.setdefault((file.lower(), "", m[4].lower()), (file, "", m[4], (m[1] or "") + file, "table"))
    return [*found.values()]


def inner_refs(formula: str, sheet: str) -> list[tuple[str, str]]:
    """(sheet, cell or range) of references within the workbook, in their order."""
    text = blank_text(formula)
    spans = [m.span() for p in (_OUTER, _TABLE, _NAMED, _BARE_TABLE) for m in p.finditer(text)]
    out: dict[tuple[str, str], None] = {}
    for m in _INNER.finditer(text):
        if any(m.start() < z and a < m.end() for a, z in spans) or (m.start() and re.match(r"[A-Za-z0-9_\]]", text[m.start() - 1])):
            continue
        ref = m[3].replace("$", "").upper()
        if all(column_number(re.match(r"[A-Z]+", x)[0]) <= MAX_COL for x in ref.split(":")):
            out[(m[1] or m[2] or sheet).replace("''", "'"), ref] = None
    return [*out]


def expand(rng: str) -> list[str]:
    """The cells of a range row by row; none where there are too many."""
    m = re.fullmatch(r"([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?", rng.replace("$", "").upper())
    if not m:
        return []
    c1, r1 = column_number(m[1]), int(m[2])
    c2, r2 = (column_number(m[3]), int(m[4])) if m[3] else (c1, r1)
    c1, c2, r1, r2 = min(c1, c2), max(c1, c2), min(r1, r2), max(r1, r2)
    if (c2 - c1 + 1) * (r2 - r1 + 1) > MAX_EXPANDED:
        return []
    return [f"{column_letters(c)}{r}" for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)]


def walk(sheet: str, cell: str, formulas: dict[tuple[str, str], str], links: dict[int, str]) -> Iterator[tuple[tuple, list[tuple[str, str, str]]]]:
    """External references among a cell's precedents, each with the chain by which it was first
    found; breadth first, cycles and very wide or deep graphs end."""
    seen, level = {(sheet, cell)}, [(sheet, cell, [])]
    for _ in range(MAX_DEPTH):
        nxt = []
        for s, c, chain in level:
            for s2, ref in inner_refs(formulas.get((s, c), ""), s):
                for c2 in expand(ref):
                    if (s2, c2) in seen or len(seen) >= MAX_CELLS:
                        continue
                    seen.add((s2, c2))
                    f = formulas.get((s2, c2))
                    if f is None:
                        continue
                    here = [*chain, (s2, c2, f)]
                    for x in external_refs(f, links):
                        yield x, here
                    nxt.append((s2, c2, here))
        level = nxt
        if not level:
            return
