"""Classification and normalisation of paths, links, connection strings and labels."""

from __future__ import annotations

import functools
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider and driver fragments of connection strings and the kind of source that
# each names; the first fragment found, in this order, counts.
PROVIDERS = (
    ("sqloledb", "sql_server"), ("sqlncli", "sql_server"), ("msoledbsql", "sql_server"), ("sqlserver", "sql_server"),
    ("microsoft.ace.oledb", "access"), ("microsoft.jet.oledb", "access"), ("oraoledb", "oracle"), ("msdaora", "oracle"),
    ("msdasql", "odbc"), ("ibmda400", "as400"), ("sybase", "sybase"), ("mysql", "mysql"), ("postgresql", "postgresql"),
)
DRIVERS = (
    ("sql server", "sql_server"), ("oracle", "oracle"), ("mysql", "mysql"), ("postgresql", "postgresql"), ("sqlite", "sqlite"),
    ("access", "access"), ("excel", "excel"), ("text", "text"), ("sybase", "sybase"), ("db2", "db2"), ("informix", "informix"), ("teradata", "teradata"),
)
# Names of the same connection-string setting.
SETTING_NAMES = {
    "server": ("server", "data source", "host", "address", "addr", "network address"),
    "database": ("database", "initial catalog", "dbq", "dbname"),
    "provider": ("provider",), "dsn": ("dsn",), "driver": ("driver",),
}
#: Attribution of a figure to a source.
SOURCE_NOTE = r"(?i)\b(source|per|from|bloomberg|reuters|factset|capital iq|according to|based on)\b"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def connection_id(category: Column, raw: Column, location: Column) -> Column:
    """Three letters of the category, and twelve hex digits of a hash of all three."""
    return F.concat(F.substring(category, 1, 3), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", category, raw, location), 256), 1, 12))


def file_name(path: Column) -> Column:
    """What follows the last slash of either kind, without query and fragment, after ``%xx``
    escapes are resolved (once; what is not valid stays as it is)."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    bare = F.regexp_replace(F.regexp_replace(plain, r"^file:/*", ""), r"[?#].*$", "")
    return F.element_at(F.split(bare, r"[\\/]"), -1)


def normalise_path(target: Column) -> Column:
    """``file:///C:/x`` to ``C:\\x`` and ``file://server/x`` to ``\\\\server\\x``."""
    drive = F.regexp_replace(F.regexp_replace(target, "^file:///", ""), "/", r"\\")
    share = F.regexp_replace(F.regexp_replace(target, "^file:", ""), "/", r"\\")
    return F.when(target.rlike("^file:///[A-Za-z]:"), drive).when(target.rlike("^file://[^/]"), share).otherwise(target)


def path_kind(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.rlike("^https?://.*sharepoint"), "sharepoint_workbook").when(low.rlike("^https?://.*(onedrive|1drv|d\\.docs\\.live)"), "onedrive_workbook")
        .when(low.rlike("^https?://"), "http_workbook").when(path.startswith("\\\\"), "unc_path").when(low.rlike("^([a-z]:|file:)"), "local_file").otherwise("external_workbook")
    )


def link_kind(target: Column) -> Column:
    low = F.lower(target)
    return (
        F.when(low.rlike("^https?://"), "http").when(low.startswith("file:"), "file_url").when(target.startswith("\\\\"), "unc_path")
        .when(low.startswith("mailto:"), "mailto").when(low.rlike("^[a-z]:[\\\\/]"), "local_file").otherwise("hyperlink")
    )


def connection_settings(text: Column) -> Column:
    """``key=value`` pairs split at semicolons outside quotes, as a map with lower-case keys."""
    pairs = F.regexp_extract_all(text, F.lit(r"""([^=;]+)=("[^"]*"|'[^']*'|\{[^}]*\}|[^;]*)"""), F.lit(0))
    key = lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))
    value = lambda p: F.regexp_replace(F.trim(F.substr(p, F.instr(p, "=") + F.lit(1))), r"""^["'{]|["'}]$""", "")
    entries = F.transform(pairs, lambda p: F.struct(key(p).alias("k"), value(p).alias("v")))
    # The first of equal keys counts.
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def connection_parts(settings: Column) -> dict[str, Column]:
    """server, database, provider, dsn, driver (null if absent) and the kind of source."""
    got = {name: F.coalesce(*[empty_to_null(F.try_element_at(settings, F.lit(k))) for k in keys]) for name, keys in SETTING_NAMES.items()}

    def first_hit(c: Column, table) -> Column:
        out = F.lit(None).cast("string")
        for part, kind in reversed(table):
            out = F.when(F.contains(F.lower(c), F.lit(part)), kind).otherwise(out)
        return out

    kind = F.coalesce(first_hit(got["provider"], PROVIDERS), first_hit(got["driver"], DRIVERS), F.when(got["dsn"].isNotNull(), "odbc_dsn"), F.lit("odbc"))
    return got | {"kind": kind}


def source_label(parts: dict[str, Column]) -> Column:
    server, database = parts["server"], parts["database"]
    return F.coalesce(F.concat(server, F.lit("/"), database), server, F.concat(F.lit("DSN:"), parts["dsn"]), database, parts["kind"], F.lit("unknown"))


def node_id(text: Column, prefix: str = "EXT__", longest: int = 80) -> Column:
    return F.substring(F.concat(F.lit(prefix), F.regexp_replace(text, "[^A-Za-z0-9]", "_")), 1, longest)


def python_name(text: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(bare.rlike("^[0-9]"), F.concat(F.lit("v_"), bare)).when(bare == "", "value").otherwise(bare)


def number_text(x: Column) -> Column:
    """Whole numbers under 1e12 without a fraction, others with four significant digits as C's
    ``%.4g`` shows them. Java's formatter rounds the shortest decimal form instead of the number
    itself, so the few cells of reports go through an Arrow batch."""
    @F.pandas_udf("string")
    def four(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.4g}")

    whole = (x == F.floor(x)) & (F.abs(x) < 1e12)
    shown = F.when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(four(x.cast("double")))
    return F.when(x.isNotNull(), shown)


def chain_text(chain: Column) -> Column:
    """``sheet!cell (=formula)`` steps joined by arrows; none is ``(direct)``."""
    steps = F.transform(chain, lambda s: F.concat(s["sheet"], F.lit("!"), s["cell"], F.lit(" (="), F.substring(s["formula"], 1, 80), F.lit(")")))
    return F.when(F.size(chain) > 0, F.array_join(steps, " → ")).otherwise("(direct)")


def cells_label(cells: Column, shown: int = 3) -> Column:
    """Up to three cells by name, more as ``first, ... (N cells)``."""
    sorted_cells = F.array_sort(cells)
    more = F.concat(F.element_at(sorted_cells, 1), F.lit(", ... ("), F.size(cells).cast("string"), F.lit(" cells)"))
    return F.when(F.size(cells) <= shown, F.array_join(sorted_cells, ", ")).otherwise(more)


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))
