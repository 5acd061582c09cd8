"""A1 references as Catalyst expressions: letters, cells, ranges, rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest row and column of a sheet.
MAX_ROW, MAX_COL = 1_048_576, 16_384
#: Ranges with more cells than this expand to nothing.
MAX_EXPANDED = 10_000


def col_to_idx(letters: Column) -> Column:
    """Bijective base 26: A is 1, Z 26, AA 27."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0), lambda n, x: n * 26 + (F.ascii(x) - 64))


def idx_to_col(n: Column) -> Column:
    """The inverse, for up to three letters."""
    letter = lambda x: F.char(F.lit(64) + x)
    low = lambda x: (x - 1) % 26 + 1
    up = lambda x: F.floor((x - 1) / 26)
    two = F.concat(letter(up(n)), letter(low(n)))
    three = F.concat(letter(up(up(n))), letter(low(up(n))), letter(low(n)))
    return F.when(n <= 26, letter(n)).when(n <= 702, two).otherwise(three)


def cell(row: Column, col: Column) -> Column:
    return F.concat(idx_to_col(col), row.cast("string"))


def a1_range(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """One cell as ``B2``, more as ``B2:C9``."""
    a, z = cell(r1, c1), cell(r2, c2)
    return F.when(a == z, a).otherwise(F.concat(a, F.lit(":"), z))


def ref_row(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^\$?[A-Za-z]{1,3}\$?([0-9]+)$", 1).try_cast("int")


def ref_col(ref: Column) -> Column:
    letters = F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?[0-9]+$", 1)
    return F.when(letters != "", col_to_idx(letters))


def rect(rng: Column) -> Column:
    """``struct(r1, c1, r2, c2)`` with ordered corners; an unreadable range is the whole sheet."""
    parts = F.split(F.regexp_replace(rng, r"\$", ""), ":")
    a, z = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    r = [ref_row(a), ref_row(z)]
    c = [ref_col(a), ref_col(z)]
    ok = r[0].isNotNull() & r[1].isNotNull() & c[0].isNotNull() & c[1].isNotNull()
    pick = lambda f, xs, other: F.when(ok, f(*xs)).otherwise(F.lit(other))
    return F.struct(
        pick(F.least, r, 1).alias("r1"), pick(F.least, c, 1).alias("c1"), pick(F.greatest, r, MAX_ROW).alias("r2"), pick(F.greatest, c, MAX_COL).alias("c2")
    )


def contains(box: Column, row: Column, col: Column) -> Column:
    return (row >= box["r1"]) & (row <= box["r2"]) & (col >= box["c1"]) & (col <= box["c2"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["r1"] <= b["r2"]) & (b["r1"] <= a["r2"]) & (a["c1"] <= b["c2"]) & (b["c1"] <= a["c2"])


def expand(rng: Column) -> Column:
    """The cells of a range, row by row; empty beyond ``MAX_EXPANDED``."""
    box = rect(rng)
    many = (box["r2"] - box["r1"] + 1).cast("long") * (box["c2"] - box["c1"] + 1)
    rows = F.transform(F.sequence(box["r1"], box["r2"]), lambda r: F.transform(F.sequence(box["c1"], box["c2"]), lambda c: F.concat(idx_to_col(c), r.cast("string"))))
    return F.when(many <= MAX_EXPANDED, F.flatten(rows)).otherwise(F.array().cast("array<string>"))


def sub_range(direction: Column, start_row: Column, start_col: Column, offset: Column, length: Column) -> Column:
    """The range of ``length`` cells from ``offset`` on within a run along ``direction``."""
    down = direction == "column"
    r1, c1 = F.when(down, start_row + offset).otherwise(start_row), F.when(down, start_col).otherwise(start_col + offset)
    r2, c2 = F.when(down, r1 + length - 1).otherwise(r1), F.when(down, c1).otherwise(c1 + length - 1)
    return a1_range(r1, c1, r2, c2)
