"""Workbook archives as relations: parts, sheets, cells, names, relationships.

A workbook is one ``binaryFile`` row, so files are the unit of parallelism; each relation is
parsed by one ``mapInArrow`` pass that opens only the parts it needs. Unreadable archives and
parts give no rows. XML with a document type is refused, so entities are never expanded.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CELLS = "file string, sheet string, sheet_idx int, ref string, row int, col int, cell_type string, has_formula boolean, formula string, num_value double, text_value string"
NAMES = "file string, name string, scope string, value string, sheet string, cell_range string, is_dynamic boolean, hidden boolean"
SHEETS = "file string, sheet_idx int, sheet string, part string, hidden boolean"
RELS = "file string, part string, rid string, target string, type string, mode string"
PARTS = "file string, part string, size long"
LINKS = "file string, link_idx int, target string, mode string"
TARGETS = "file string, name string, seq int, kind string, scope string, sheet string, cell_range string, other_file string"
_LETTERS = re.compile(r"^\$?([A-Za-z]{1,3})\$?([0-9]+)$")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(letters: str) -> int:
    n = 0
    for x in letters.upper():
        n = n * 26 + ord(x) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def split_ref(ref: str) -> tuple[int, int] | None:
    m = _LETTERS.match(ref)
    return (int(m[2]), column_number(m[1])) if m else None


class Book:
    """One open archive; parts that are missing or broken read as None."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()

    def raw(self, part: str) -> bytes | None:
        try:
            return self.zip.read(part)
        except (KeyError, zipfile.BadZipFile, OSError, RuntimeError):
            return None

    def xml(self, part: str):
        data = self.raw(part)
        if not data or b"<!DOCTYPE" in data[:4096]:
            return None
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError:
            return None

    def rels(self, part: str) -> dict[str, tuple[str, str, str]]:
        """rId to (target, type, mode) of a part."""
        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        return {} if root is None else {r.get("Id", ""): (r.get("Target", ""), r.get("Type", ""), r.get("TargetMode", "")) for r in root}

    @staticmethod
    def resolve(part: str, target: str) -> str:
        """A relationship's target as a part name."""
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))

    def sheets(self) -> list[tuple[str, str, bool]]:
        """(name, part, hidden) in workbook order; by file name where the workbook part is gone."""
        root, rels = self.xml("xl/workbook.xml"), self.rels("xl/workbook.xml")
        out = []
        for el in root.iter() if root is not None else ():
            if local(el.tag) == "sheet" and el.get("name") is not None:
                rid = next((v for k, v in el.attrib.items() if local(k) == "id"), "")
                if rid in rels:
                    out.append((el.get("name"), self.resolve("xl/workbook.xml", rels[rid][0]), el.get("state", "visible") != "visible"))
        if not out:
            found = sorted((int(m[1]), n) for n in self.names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
            out = [(f"Sheet{i}", n, False) for i, n in found]
        return out

    def shared_strings(self) -> list[str]:
        root = self.xml("xl/sharedStrings.xml")
        return [] if root is None else ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in root if local(si.tag) == "si"]

    def cells(self, part: str, strings: list[str]) -> Iterator[tuple]:
        """(ref, row, col, type, has_formula, formula, number, text) of a sheet, streamed."""
        data = self.raw(part)
        if not data or b"<!DOCTYPE" in data[:4096]:
            return
        try:
            for _, el in ElementTree.iterparse(io.BytesIO(data)):
                if local(el.tag) == "row":
                    el.clear()
                if local(el.tag) != "c" or not (at := split_ref(el.get("r", ""))):
                    continue
                kind, formula, has, value, inline = el.get("t", "n"), None, False, None, None
                for x in el:
                    name = local(x.tag)
                    if name == "f":
                        has, formula = True, x.text or None
                    elif name == "v":
                        value = x.text
                    elif name == "is":
                        inline = "".join(t.text or "" for t in x.iter() if local(t.tag) == "t")
                number = text = None
                if kind == "s" and value is not None:
                    text = strings[int(value)] if value.isdigit() and int(value) < len(strings) else value
                elif kind == "inlineStr":
                    text = inline
                elif kind in ("str", "e", "b"):
                    text = value
                elif value is not None:
                    try:
                        number = float(value)
                    except ValueError:
                        text = value
                yield el.get("r"), *at, kind, has, formula, number, text
        except ElementTree.ParseError:
            return

    def defined_names(self) -> Iterator[tuple]:
        """(name, scope, value, sheet, cell_range, is_dynamic, hidden)."""
        root = self.xml("xl/workbook.xml")
        order = [s[0] for s in self.sheets()]
        for el in root.iter() if root is not None else ():
            if local(el.tag) == "definedName" and el.get("name"):
                value = (el.text or "").strip()
                scope = el.get("localSheetId")
                m = re.fullmatch(r"'?((?:[^'!\[]|'')+)'?!(\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?)", value)
                yield el.get("name"), order[int(scope)] if scope and int(scope) < len(order) else None, value, m[1].replace("''", "'") if m else None, m[2].replace("$", "") if m else None, "(" in value, el.get("hidden") in ("1", "true")

    def tables(self) -> Iterator[tuple[str, str, str]]:
        """(name, sheet, range) of the tables on the sheets."""
        for sheet, part, _ in self.sheets():
            for target, kind, _ in self.rels(part).values():
                root = self.xml(self.resolve(part, target)) if kind.endswith("/table") else None
                if root is not None and root.get("ref"):
                    yield root.get("displayName") or root.get("name", ""), sheet, root.get("ref")

    def link_targets(self) -> dict[int, tuple[str, str]]:
        """External link number to (target, mode)."""
        out = {}
        for n in self.names:
            if m := re.fullmatch(r"xl/externalLinks/externalLink(\d+)\.xml", n):
                for target, _, mode in self.rels(n).values():
                    out.setdefault(int(m[1]), (target, mode))
        return out


def files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(file, content) of the .xlsx and .xlsm files at ``paths``, each path once; others are not
    listed, so they are not opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[xX][lL][sS][xXmM]")
    listed = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    return reader.load(listed).where(F.lower("path").rlike(r"\.xls[xm]$")).select(F.col("path").alias("file"), "content")


def each(books: DataFrame, schema: str, rows: Callable[[str, Book], Iterator[tuple]]) -> DataFrame:
    """Rows of every readable workbook; a workbook's failure costs its own rows only."""

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                file, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    book = Book(content)
                except (zipfile.BadZipFile, OSError):
                    continue
                held = []
                for r in rows(file, book):
                    held.append(r)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    return books.select("file", "content").mapInArrow(run, schema)


def cells(books: DataFrame, only_sheets: list[str] | None = None) -> DataFrame:
    """All cells; ``only_sheets`` is pushed into the reader, so other parts are not parsed."""

    def rows(file: str, book: Book):
        strings = book.shared_strings()
        for k, (sheet, part, _) in enumerate(book.sheets()):
            if only_sheets is None or sheet in only_sheets:
                for c in book.cells(part, strings):
                    yield (file, sheet, k, *c)

    return each(books, CELLS, rows)


def sheets(books: DataFrame) -> DataFrame:
    return each(books, SHEETS, lambda file, b: ((file, k, *s) for k, s in enumerate(b.sheets())))


def names(books: DataFrame) -> DataFrame:
    return each(books, NAMES, lambda file, b: ((file, *n) for n in b.defined_names()))


def name_targets(books: DataFrame) -> DataFrame:
    """What each defined name (built-in ones aside) and table stands for, in file order: kind is
    ``external`` (with the other file), ``local``, ``dynamic`` (its value is a call) or ``table``."""
    from ..operators.formula_refs import external_refs

    def rows(file: str, book: Book):
        links = {k: v[0] for k, v in book.link_targets().items()}
        seq = 0
        for name, scope, value, *_ in book.defined_names():
            seq += 1
            if name.startswith("_xlnm"):
                continue
            if "[" in value:
                for other, sheet, target, *_ in external_refs(f"={value}", links)[:1]:
                    yield file, name.lower(), seq, "external", scope, sheet, target, other
            elif "!" in value:
                sheet, _, rng = value.removeprefix("=").partition("!")
                yield file, name.lower(), seq, "dynamic" if "(" in value else "local", scope, sheet.strip("'").replace("''", "'") if "(" not in sheet else None, rng.replace("$", ""), None
            elif "(" in value:
                yield file, name.lower(), seq, "dynamic", scope, None, value, None
        for name, sheet, rng in book.tables():
            seq += 1
            yield file, name.lower(), seq, "table", None, sheet, rng.replace("$", ""), None

    return each(books, TARGETS, rows)


def parts(books: DataFrame) -> DataFrame:
    return each(books, PARTS, lambda file, b: ((file, i.filename, i.file_size) for i in b.zip.infolist()))


def links(books: DataFrame) -> DataFrame:
    return each(books, LINKS, lambda file, b: ((file, k, *v) for k, v in sorted(b.link_targets().items())))


def rels(books: DataFrame) -> DataFrame:
    def rows(file: str, book: Book):
        for n in book.names:
            if n.endswith(".rels"):
                owner = n.replace("_rels/", "").removesuffix(".rels")
                for rid, r in book.rels(owner).items():
                    yield (file, owner, rid, *r)

    return each(books, RELS, rows)


def hardcoded(c: DataFrame) -> DataFrame:
    """Typed-in numbers: no formula of any kind."""
    return c.where(~F.col("has_formula") & F.col("num_value").isNotNull())


def all_numbers(c: DataFrame) -> DataFrame:
    return c.where(F.col("num_value").isNotNull())


def formulas(c: DataFrame, containing: str | None = None) -> DataFrame:
    f = c.where(F.col("formula").isNotNull() & (F.col("formula") != ""))
    return f if containing is None else f.where(F.contains(F.upper("formula"), F.lit(containing.upper())))
