"""Flowchart text as nodes and edges, through ``spark.read.text`` or plain strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHAPES = re.compile(r"""^([A-Za-z0-9_.-]+?)\s*(?:(\[\[|\[\(|\(\[|\(\(|\{\{|\[/|\[\\|\[|\(|\{|>)(.*?)(?:\]\]|\)\]|\]\)|\)\)|\}\}|/\]|\\\]|\]|\)|\}))?(?::::\w+)?$""", re.S)
_ARROW = re.compile(r"""\s*(?:--\s+(?P<mid>[^->|]+?)\s+-->|<?(?:-{2,}|={2,}|-\.+-)(?:>|x|o)?(?:\s*\|(?P<label>[^|]*)\|)?)\s*""")
_SKIP = re.compile(r"^(?:%%|subgraph\b|end\b|style\b|class\b|classDef\b|click\b|linkStyle\b|direction\b|(?:flowchart|graph)\b|---|title:)")
_OTHER = re.compile(r"^(?:sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|journey|gitGraph|mindmap|timeline)\b")


def _node(token: str) -> tuple[str, str] | None:
    m = _SHAPES.match(token.strip())
    if not m:
        return None
    label = (m[3] or m[1]).strip().strip("\"'")
    return m[1], re.sub(r"<br\s*/?>", " ", label)


def _split(text: str, sep: str) -> list[str]:
    """Split outside brackets and quotes."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "[({") - (c in "])}")
            if c == sep and depth <= 0:
                out.append(text[start:i])
                start = i + 1
    return [*out, text[start:]]


def parse_line(line: str) -> tuple[dict[str, str], list[tuple[str, str, str | None]]]:
    """Nodes and edges of one statement: chains make an edge per hop, ``&`` a cross product."""
    line = line.strip().rstrip(";")
    if not line or _SKIP.match(line):
        return {}, []
    hops, labels, at, depth, quoted, start = [], [], 0, 0, False, 0
    while at < len(line):
        c = line[at]
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "[({") - (c in "])}")
            if depth <= 0 and c in "-=<" and at > start and (m := _ARROW.match(line, at)) and m.end() > at + 1:
                hops.append(line[start:at])
                labels.append((m["label"] or m["mid"] or "").strip() or None)
                at = start = m.end()
                continue
        at += 1
    hops.append(line[start:])
    groups = [[n for t in _split(h, "&") if (n := _node(t))] for h in hops]
    nodes: dict[str, str] = {}
    for i, label in (n for g in groups for n in g):
        if i not in nodes or label != i:
            nodes[i] = label
    edges = [(a[0], b[0], lab) for left, right, lab in zip(groups, groups[1:], labels, strict=False) for a in left for b in right]
    return nodes, edges


def parse(text: str) -> tuple[dict[str, str], list[tuple[str, str, str | None]]]:
    """All nodes, labels first seen with a shape winning, and all edges of a flowchart."""
    nodes: dict[str, str] = {}
    edges: list[tuple[str, str, str | None]] = []
    front = False
    for line in text.splitlines():
        if line.strip() == "---":
            front = not front
            continue
        if front:
            continue
        if _OTHER.match(line.strip()):
            return {}, []
        for piece in _split(line, ";"):
            n, e = parse_line(piece)
            for i, label in n.items():
                if i not in nodes or (nodes[i] == i and label != i):
                    nodes[i] = label
            edges += e
    return nodes, edges


def edges_of(lines: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """(file, src, dst, label) of flowchart lines."""

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            out = [(f, a, z, lab) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a, z, lab in parse_line(t or "")[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["file", "src", "dst", "label"])

    return lines.where(F.col(text_col).rlike("-|=")).select(F.col(file_col).cast("string"), text_col).mapInArrow(run, "file string, src string, dst string, label string")
