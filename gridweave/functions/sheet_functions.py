"""Executable spreadsheet functions as Columns, and formulas compiled to one Column.

Errors (division by zero, nothing found, a text where a number is needed) are null, so IFERROR
and IFNA are ``coalesce`` and nothing raises under ANSI rules. Arguments are Columns or Python
values; formats, units and match modes must be Python values. A range is an array Column: one
row or column of cells, or an array of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formulas import TOKEN
from .refs import a1_range, rect
from .text import any_of


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _number(x) -> Column:
    return col(x).try_cast("double")


def _digits(x, digits, cut: Callable) -> Column:
    """``cut`` (ceil or floor) of the absolute value at so many digits. Scaling leaves dust in the
    last places, which is rounded off first."""
    scale = F.pow(F.lit(10.0), col(digits))
    return F.signum(_number(x)) * cut(F.round(F.abs(_number(x)) * scale, 9)).cast("double") / scale


def _mod(a, b) -> Column:
    a, b = _number(a), _number(b)
    return a - b * F.floor(F.try_divide(a, b))


def _months(a: Column, z: Column) -> Column:
    """Whole months from one date to a later one."""
    return (F.year(z) - F.year(a)) * 12 + F.month(z) - F.month(a) - (F.day(z) < F.day(a)).cast("int")


def _date_difference(a, z, unit: str = "D") -> Column:
    a, z = col(a).cast("date"), col(z).cast("date")
    m = _months(a, z)
    made = {
        "D": lambda: F.datediff(z, a), "M": lambda: m, "Y": lambda: F.floor(m / 12).cast("int"), "YM": lambda: m % 12,
        "MD": lambda: F.datediff(z, F.add_months(a, m)), "YD": lambda: F.datediff(z, F.add_months(a, F.floor(m / 12).cast("int") * 12)),
    }[unit.upper()]()
    return F.when(a <= z, made)


def _substitute(text, old, new, which: int | None = None) -> Column:
    text, old, new = col(text), col(old), col(new)
    if which is None:
        return F.replace(text, old, new)
    parts = F.split(text, F.concat(F.lit(r"\Q"), old, F.lit(r"\E")))
    head, tail = F.array_join(F.slice(parts, 1, which), "\0"), F.array_join(F.slice(parts, which + 1, F.greatest(F.size(parts), F.lit(1))), "\0")
    joined = F.concat(F.replace(head, F.lit("\0"), old), new, F.replace(tail, F.lit("\0"), old))
    return F.when(F.size(parts) > which, joined).otherwise(text)


def _find(needle, text, start=1) -> Column:
    return F.nullif(F.position(col(needle), col(text), col(start)), F.lit(0))


def _search(needle, text, start=1) -> Column:
    """Like FIND without regard to case; a needle given as text may hold ``?`` and ``*``."""
    if not isinstance(needle, str) or not re.search(r"[?*]", needle):
        return _find(F.lower(col(needle)), F.lower(col(text)), start)
    pattern = "(?is)" + "".join({"?": ".", "*": ".*?"}.get(c, re.escape(c)) for c in needle)
    rest = F.substr(col(text), col(start))
    at = F.length(F.regexp_extract(rest, f"(?is)^(.*?){pattern[5:]}", 1)) + col(start)
    return F.when(rest.rlike(pattern), at)


# Parts of date formats and Spark's patterns for them.
DATE_PARTS = {"yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss", "s": "s"}


def _date_pattern(form: str) -> str:
    out, before = [], ""
    for part in re.findall(r"y+|m+|d+|h+|s+|[^ymdhs]+", form.lower()):
        # After hours, m means minutes.
        out.append({"mm": "mm", "m": "m"}[part] if part in ("mm", "m") and before.startswith("h") else DATE_PARTS.get(part, part if not part.isalpha() else f"'{part}'"))
        before = part if part.isalpha() else before
    return "".join(out)


def _formatted(x, form: str) -> Column:
    """TEXT: number formats of digits, thousands and per cent, and date formats."""
    if re.search(r"[ymdhs]", form, re.I):
        return F.date_format(col(x), _date_pattern(form))
    m = re.fullmatch(r"([^0#.,]*)([#0,]*)(?:\.([0#]+))?(%?)(.*)", form)
    before, whole, places, percent, after = m.groups()
    n = len(places or "")
    value = F.round(_number(x) * (100 if percent else 1), n)
    shown = F.format_number(F.abs(value), n)
    shown = shown if "," in whole else F.replace(shown, F.lit(","), F.lit(""))
    width = whole.count("0")
    if "," not in whole and width > 1:
        shown = F.lpad(shown, F.greatest(F.length(shown), F.lit(width + (n + 1 if n else 0))), F.lit("0"))
    if places and "#" in places:
        shown = F.regexp_replace(shown, rf"0{{0,{places.count('#')}}}$", "")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit(before), shown, F.lit(percent + after))


def _match(x, cells, mode: int = 1) -> Column:
    """Place (from 1) of a value among cells: the first equal one (0), the last of those up to it
    in ascending cells (1), or the last of those down to it in descending cells (-1)."""
    x, cells = col(x), col(cells)
    if mode == 0:
        return F.nullif(F.array_position(cells, x), F.lit(0)).cast("int")
    fits = F.filter(cells, lambda c: (c <= x) if mode > 0 else (c >= x))
    return F.nullif(F.size(fits), F.lit(0))


def _at(cells, place) -> Column:
    return F.get(col(cells), col(place).cast("int") - 1)


def _index(grid, row, column=None) -> Column:
    return _at(grid, row) if column is None else _at(_at(grid, row), column)


def _column_of(grid, k: int) -> Column:
    return F.transform(col(grid), lambda r: F.get(r, F.lit(k - 1)))


def _vlookup(x, grid, k: int, near=True) -> Column:
    return _at(_column_of(grid, k), _match(x, _column_of(grid, 1), 1 if near else 0))


def _hlookup(x, grid, k: int, near=True) -> Column:
    return _at(_at(grid, k), _match(x, _at(grid, 1), 1 if near else 0))


def _xlookup(x, keys, values, other=None, mode: int = 0) -> Column:
    """The value beside the first equal key; else beside the next smaller (-1) or larger (1) one,
    whatever the keys' order; else ``other``."""
    x, keys = col(x), col(keys)
    place = _match(x, keys, 0)
    if mode:
        beside = F.array_max(F.filter(keys, lambda c: c <= x)) if mode < 0 else F.array_min(F.filter(keys, lambda c: c >= x))
        place = F.coalesce(place, F.nullif(F.array_position(keys, beside), F.lit(0)).cast("int"))
    return F.coalesce(_at(values, place), col(other))


def _offset(ref, rows, columns, height=None, width=None) -> Column:
    """The A1 text of a reference moved by rows and columns; null beyond the sheet's edge."""
    box = rect(col(ref))
    r, c = box["r1"] + col(rows), box["c1"] + col(columns)
    r2 = r + (col(height) if height is not None else box["r2"] - box["r1"] + 1) - 1
    c2 = c + (col(width) if width is not None else box["c2"] - box["c1"] + 1) - 1
    r, c, r2, c2 = (x.cast("int") for x in (r, c, r2, c2))
    return F.when((r >= 1) & (c >= 1) & (r2 <= 1_048_576) & (c2 <= 16_384), a1_range(r, c, r2, c2))


def _choose(pairs) -> Column:
    out = F.when(pairs[0], col(pairs[1]))
    for when, then in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(when, col(then))
    return out


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ABS": lambda x: F.abs(_number(x)), "ROUND": lambda x, n=0: F.round(_number(x), n), "ROUNDUP": lambda x, n=0: _digits(x, n, F.ceil), "ROUNDDOWN": lambda x, n=0: _digits(x, n, F.floor),
    "INT": lambda x: F.floor(_number(x)).cast("double"), "MOD": _mod, "POWER": lambda x, y: F.pow(_number(x), _number(y)), "SQRT": lambda x: F.when(_number(x) >= 0, F.sqrt(_number(x))),
    "LN": lambda x: F.when(_number(x) > 0, F.ln(_number(x))), "LOG": lambda x, b=10: F.when(_number(x) > 0, F.try_divide(F.ln(_number(x)), F.ln(_number(b)))),
    "LOG10": lambda x: F.when(_number(x) > 0, F.log10(_number(x))), "EXP": lambda x: F.exp(_number(x)),
    "LEFT": lambda t, n=1: F.left(col(t), col(n)), "RIGHT": lambda t, n=1: F.right(col(t), col(n)), "MID": lambda t, i, n: F.substr(col(t), col(i), col(n)), "LEN": lambda t: F.length(col(t)),
    "TRIM": lambda t: F.trim(F.regexp_replace(col(t), " +", " ")), "UPPER": lambda t: F.upper(col(t)), "LOWER": lambda t: F.lower(col(t)), "CONCATENATE": lambda *a: F.concat(*[F.coalesce(col(x).cast("string"), F.lit("")) for x in a]),
    "SUBSTITUTE": _substitute, "FIND": _find, "SEARCH": _search, "TEXT": _formatted,
    "IF": lambda c, a, b=None: F.when(c, col(a)).otherwise(col(b)), "AND": lambda *a: ~any_of([~x for x in a]), "OR": lambda *a: any_of([*a]), "NOT": lambda x: ~x,
    "IFERROR": lambda *a: F.coalesce(*[col(x) for x in a]), "IFNA": lambda *a: F.coalesce(*[col(x) for x in a]), "IFS": lambda *a: _choose(a),
    "VLOOKUP": _vlookup, "HLOOKUP": _hlookup, "XLOOKUP": _xlookup, "INDEX": _index, "MATCH": _match, "OFFSET": _offset,
    "TODAY": lambda: F.current_date(), "NOW": lambda: F.current_timestamp(), "YEAR": lambda d: F.year(col(d)), "MONTH": lambda d: F.month(col(d)), "DAY": lambda d: F.day(col(d)),
    # Months and days beyond their range carry over.
    "DATE": lambda y, m, d: F.date_add(F.add_months(F.make_date(col(y), F.lit(1), F.lit(1)), col(m).cast("int") - 1), col(d).cast("int") - 1), "DATEDIF": _date_difference,
    "EDATE": lambda d, n: F.add_months(col(d), col(n).cast("int")), "EOMONTH": lambda d, n: F.last_day(F.add_months(col(d), col(n).cast("int"))),
}


def scalar(name: str, *args) -> Column:
    """A spreadsheet function as an executable expression."""
    return FUNCTIONS[name.upper()](*args)


def aggregate(name: str, x: Column, *conditions: Column, weight: Column | None = None) -> Column:
    """A spreadsheet aggregate as an executable one; all ``conditions`` must hold."""
    when = ~any_of([~c for c in conditions])
    number = x.try_cast("double")
    return {
        "SUM": lambda: F.sum(number), "AVERAGE": lambda: F.avg(number), "COUNT": lambda: F.count(number), "COUNTA": lambda: F.count(x), "MIN": lambda: F.min(number), "MAX": lambda: F.max(number),
        "MEDIAN": lambda: F.median(number), "STDEV": lambda: F.stddev_samp(number), "STDEVP": lambda: F.stddev_pop(number), "VAR": lambda: F.var_samp(number), "VARP": lambda: F.var_pop(number),
        "COUNTIF": lambda: F.count_if(when), "COUNTIFS": lambda: F.count_if(when), "SUMIF": lambda: F.coalesce(F.sum(F.when(when, number)), F.lit(0.0)),
        "SUMIFS": lambda: F.coalesce(F.sum(F.when(when, number)), F.lit(0.0)), "SUMPRODUCT": lambda: F.sum(number * weight),
    }[name.upper()]()


# Operators from the loosest to the tightest.
LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))


def _apply(op: str, a, b) -> Column:
    if op == "&":
        return F.concat(col(a).cast("string"), col(b).cast("string"))
    if op in LEVELS[0]:
        a, b = col(a), col(b)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    a, b = _number(a), _number(b)
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "^": F.pow}[op](a, b)


def compiled(formula: str, names: dict[str, Column]) -> Column:
    """A formula as one Column; ``names`` has its references (``Sheet!A1``, ``A1``, ``A1:A9``) and
    defined names. A name that is not there is a KeyError."""
    tokens = [m for m in TOKEN.finditer(formula.removeprefix("=")) if not m["space"]]
    at = 0

    def peek(group: str) -> str | None:
        return tokens[at][group] if at < len(tokens) else None

    def level(k: int):
        nonlocal at
        if k == len(LEVELS):
            return operand()
        left = level(k + 1)
        while peek("op") in LEVELS[k]:
            op = peek("op")
            at += 1
            left = _apply(op, left, level(k + 1))
        return left

    def operand():
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"formula ends early: {formula}")
        m = tokens[at]
        at += 1
        if m["op"] in ("-", "+"):
            x = operand()
            return x if m["op"] == "+" else -x if not isinstance(x, Column) else -_number(x)
        if m["open"]:
            x = level(0)
            at += 1
            return x
        if m["call"]:
            args = []
            while not peek("close"):
                args.append(None if peek("comma") else level(0))
                at += bool(peek("comma"))
            at += 1
            return scalar(m["call"], *args)
        if m["text"]:
            return m["text"][1:-1].replace('""', '"')
        if m["ref"]:
            bare = m["ref"].replace("$", "").replace("'", "")
            return names[bare] if bare in names else names[m["cell"].replace("$", "")]
        word = m["other"] or m[0]
        if word.upper() in ("TRUE", "FALSE"):
            return word.upper() == "TRUE"
        if re.fullmatch(r"[0-9.]+%?", word):
            x = float(word.rstrip("%")) / (100 if word.endswith("%") else 1)
            return int(x) if x == int(x) and "." not in word else x
        return names[word]

    made = level(0)
    if at < len(tokens):
        raise ValueError(f"cannot read {formula!r} from {tokens[at][0]!r} on")
    return col(made)
