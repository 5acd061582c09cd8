from gridweave.functions import formulas as FX
from gridweave.functions import kernels as K
from gridweave.functions import sheet_functions as S
from gridweave.functions import sql_text, text
from gridweave.operators import extractors as E
from gridweave.operators import formula_refs as R
from gridweave.sources import diagram, settings

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "formula, names, want",
    [
        ("=SUM(A1:A3)", {}, "SUM(A1:A3)"),
        ("=IF(A1>0,B1,C1)", {}, "CASE WHEN A1>0 THEN B1 ELSE C1 END"),
        ("=IF(A1>0,IF(B1<>2,1,2),C1)", {}, "CASE WHEN A1>0 THEN CASE WHEN B1!=2 THEN 1 ELSE 2 END ELSE C1 END"),
        ('=A1&"x<>y"', {"A1": "price"}, 'price || "x<>y"'),
        ("=AVERAGE(Inputs!$B$2:$B$13)", {"Inputs!B2:B13": "revenue"}, "AVG(revenue)"),
        ("=FOO(A1)", {}, "FOO(A1)"),
        ("=IF(SUM(A1,B1)>1,2)", {}, "CASE WHEN SUM(A1,B1)>1 THEN 2 END"),
        ("", {}, ""),
        (None, {}, ""),
    ],
)
def test_to_sql(formula, names, want):
    assert FX.to_sql(formula, names) == want


def test_query_sources():
    code = 'let Source = Sql.Database("srv", "db"), f = Excel.Workbook(File.Contents("C:\\a.xlsx")) in Source'
    assert FX.query_sources(code)[:2] == [("sql_server", "srv/db"), ("file_excel", "C:\\a.xlsx")]
    assert ("file_text", "C:\\a.xlsx") in FX.query_sources(code)
    assert FX.query_sources("x = Foo.Bar(1)") == [("m_function", "Foo.Bar")]
    assert FX.query_sources("") == [] and FX.query_sources(None) == []


def test_kernels():
    m = np.array([1.0, 2, 3, 4])
    assert K.pearson(m, np.array([[10.0, 20, 30, 40]]))[0] > 0.99
    assert K.cosine(m, np.array([[2.0, 4, 6, 8]]))[0] > 0.99
    flat = np.full(4, 5.0)
    assert K.pearson(flat, np.array([[5.0] * 4, [6.0] * 4, [1.0, 2, 3, 4]])).tolist() == [1.0, 0.0, 0.0]
    assert K.euclidean(m, m[None], 1.0)[0] == 1.0


def test_expand():
    assert R.expand("A1:B2") == ["A1", "B1", "A2", "B2"]
    assert R.expand("A1:A1000000") == []


def test_external_refs():
    got = R.external_refs("='C:\\d\\[src.xlsx]Sheet 1'!$B$2+[2]Data!C3+[1]!Rate", {1: "up.xlsx", 2: "http://x/y%20z.xlsx"})
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [("src.xlsx", "Sheet 1", "B2", "cell"), ("y z.xlsx", "Data", "C3", "cell"), ("up.xlsx", "", "Rate", "named_range")]
    assert R.external_refs('="[no.xlsx]Sheet1!A1"', {}) == []
    assert R.external_refs("=[3]S!A1", {})[0][0] == "[ExternalLink3]"


def test_inner_refs():
    assert R.inner_refs("=A1+'My Sheet'!B2:C3+SUM(Other!$D$4)", "S") == [("S", "A1"), ("My Sheet", "B2:C3"), ("Other", "D4")]
    assert R.inner_refs("='[x.xlsx]S'!A1+LOG10(B1)", "S") == [("S", "B1")]


def test_walk():
    two_hops = {("S", "A1"): "=B1", ("S", "B1"): "=C1", ("S", "C1"): "=[1]U!A1"}
    hits = [*R.walk("S", "A1", two_hops, {1: "u.xlsx"})]
    assert [(x[0], [c for _, c, _ in chain]) for x, chain in hits] == [("u.xlsx", ["B1", "C1"])]
    assert [*R.walk("S", "A1", {("S", "A1"): "=B1", ("S", "B1"): "=A1"}, {})] == []
    branches = {("S", "A1"): "=B1+C1", ("S", "B1"): "=[1]U!A1", ("S", "C1"): "=[1]U!A2"}
    assert len([*R.walk("S", "A1", branches, {1: "u.xlsx"})]) == 2


def test_describe_connection():
    assert E.describe("Provider=SQLOLEDB;Data Source=s1;Initial Catalog=d1") == ("sql_server", "s1/d1")
    assert E.describe("DSN=warehouse;UID=x") == ("odbc_dsn", "DSN:warehouse")
    assert E.describe('Driver={Oracle in home};Server="a;b"') == ("oracle", "a;b")
    assert E.describe("") == ("odbc", "odbc")


def test_table_regions():
    assert sorted(map(len, E.table_regions({(1, 1), (1, 2), (2, 1), (9, 9)}))) == [1, 3]


def test_diagram():
    nodes, edges = diagram.parse('flowchart LR\n A["x --> y"] --> B & C -->|go| D\n%% no\nsubgraph Q\nE -- via --> A\nend')
    assert nodes["A"] == "x --> y" and set(nodes) == {"A", "B", "C", "D", "E"}
    assert edges == [("A", "B", None), ("A", "C", None), ("B", "D", "go"), ("C", "D", "go"), ("E", "A", "via")]
    assert diagram.parse("sequenceDiagram\nA->>B: x") == ({}, [])
    chain = "graph TD\n" + "\n".join(f"N{i} --> N{i + 1}" for i in range(500))
    assert len(diagram.parse(chain)[1]) == 500


def columns(spark, **exprs):
    """Values of expressions over one row."""
    return spark.range(1).select(*[x.alias(n) for n, x in exprs.items()]).first().asDict()


def test_sheet_functions(spark):
    import datetime as dt

    names = {"A1": F.lit(3.14159), "B1": F.lit(-3.14159), "C1": F.lit(0.0), "D1": F.lit("2024-01-31").cast("date"), "T1": F.lit("abcabc"), "N1": F.lit(None).cast("string"), "Sheet 2!A1": F.lit(7)}
    f = lambda text: S.compiled(text, names)
    got = columns(
        spark, up=f("=ROUNDUP(A1,2)"), up_neg=f("=ROUNDUP(B1,2)"), down=f("=ROUNDDOWN(B1,1)"), tens=f("=ROUNDUP(1234,-2)"), exact=f("=ROUNDUP(3.15,2)"), mod=f("=MOD(5,-3)"), mod2=f("=MOD(-5,3)"), mod0=f("=MOD(5,C1)"),
        months=f('=DATEDIF(D1,DATE(2024,3,31),"M")'), short=f('=DATEDIF(D1,DATE(2024,2,29),"m")'), back=f('=DATEDIF(DATE(2025,1,1),D1,"D")'), md=f('=DATEDIF(D1,DATE(2024,3,5),"MD")'), left=f("=LEFT(T1)"), right=f("=RIGHT(T1)"),
        error=f("=IFERROR(1/0,-1)"), text_error=f('=IFERROR("x"+1,-9)'), power=f("=-2^2"), order=f("=1+2*3^2-4/2"), percent=f("=50%*4"), both=f('=T1&"-"&1'), quoted=f("='Sheet 2'!A1+1"), compare=f('=IF(T1<>"x",1,2)'),
        sub=f('=SUBSTITUTE(T1,"b","X",2)'), sub9=f('=SUBSTITUTE(T1,"b","X",9)'), find=f('=FIND("c",T1,4)'), none=f('=FIND("z",T1)'), wild=f('=SEARCH("B?A",T1)'), join=f('=CONCATENATE(N1,"x")'), date=f("=DATE(2023,14,0)"),
    )
    assert got == {
        "up": 3.15, "up_neg": -3.15, "down": -3.1, "tens": 1300.0, "exact": 3.15, "mod": -1.0, "mod2": 1.0, "mod0": None, "months": 2, "short": 0, "back": None, "md": 5, "left": "a", "right": "c", "error": -1.0, "text_error": -9.0, "power": 4.0, "order": 17.0,
        "percent": 2.0, "both": "abcabc-1", "quoted": 8.0, "compare": 1, "sub": "abcaXc", "sub9": "abcabc", "find": 6, "none": None, "wild": 2, "join": "x", "date": dt.date(2024, 1, 31),
    }
    with pytest.raises(KeyError):
        S.compiled("=Z9+1", names)
    with pytest.raises(ValueError):
        S.compiled("=A1 B1", names)
    with pytest.raises(ValueError):
        S.compiled("=A1+", names)


def test_text_formats(spark):
    shown = lambda x, form: S.scalar("TEXT", F.lit(x), form)
    got = columns(spark, a=shown(1234.5, "#,##0.00"), b=shown(0.256, "0.0%"), c=shown(-1234.567, "0.00"), d=shown(7, "000"), e=shown(2.5, "0"), f=shown(1.5, "$0.00"), g=shown(3.0, "0.##"), h=S.scalar("TEXT", F.lit("2024-03-09 14:05:06").cast("timestamp"), "yyyy-mm-dd hh:mm:ss"))
    assert got == {"a": "1,234.50", "b": "25.6%", "c": "-1234.57", "d": "007", "e": "3", "f": "$1.50", "g": "3.", "h": "2024-03-09 14:05:06"}


def test_lookups(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    grid = F.array(a(1, 10), a(5, 50), a(9, 90))
    at = lambda r, c: S.scalar("OFFSET", F.lit("B2:C3"), F.lit(r), F.lit(c))
    got = columns(
        spark, near=S.scalar("VLOOKUP", F.lit(6), grid, 2), under=S.scalar("VLOOKUP", F.lit(0), grid, 2), exact=S.scalar("VLOOKUP", F.lit(6), grid, 2, False), h=S.scalar("HLOOKUP", F.lit(5), F.array(a(1, 5), a(7, 8)), 2, False),
        x=S.scalar("XLOOKUP", F.lit(6), a(9, 1, 5), a("n", "o", "f"), "none"), below=S.scalar("XLOOKUP", F.lit(6), a(9, 1, 5), a("n", "o", "f"), "none", -1), i=S.scalar("INDEX", grid, F.lit(2), F.lit(1)), out=S.scalar("INDEX", a(1), F.lit(5)),
        down=S.scalar("MATCH", F.lit(6), a(9, 7, 3), -1), moved=at(1, 2), edge=at(-2, 0), one=S.scalar("OFFSET", F.lit("B2"), F.lit(0), F.lit(0), F.lit(3), F.lit(2)),
    )
    assert got == {"near": 50, "under": None, "exact": None, "h": 8, "x": "none", "below": "f", "i": 5, "out": None, "down": 2, "moved": "D3:E4", "edge": None, "one": "B2:C4"}


@pytest.mark.parametrize(
    "sql, tables, joins, filter_text",
    [
        ("SELECT a, max(b, c) FROM x.y z, [w w] WHERE f(a, 'from q') > 1 ORDER BY 1", ["y", "w w"], [], "f(a, 'from q') > 1"),
        ("select * from t left join u as v on t.a = v.b cross join w", ["t", "u", "w"], [("LEFT", "u", "t.a = v.b"), ("CROSS", "w", "")], None),
        ("WITH c AS (SELECT 1 FROM d WHERE e = 1) SELECT * FROM c WHERE g = 2 GROUP BY h", ["d", "c"], [], "g = 2"),
        ("no sql", [], [], None),
    ],
)
def test_sql_text(sql, tables, joins, filter_text):
    got = sql_text.read(sql)
    assert got["tables"] == tables and [(j["type"], j["table"], j["on"]) for j in got["joins"]] == joins and got["filter"] == filter_text
    assert sql_text.read(" ") is None and sql_text.read(None) is None


def test_number_text(spark):
    xs = [0.000123456, 1234567.891, 12.345, 1234.5, 5.0, -3.0, 1e12, 1e-5, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(text.number_text(F.col("x"))).collect()]
    assert got == ["0.0001235", "1.235e+06", "12.35", "1234", "5", "-3", "1e+12", "1e-05", None, "nan"]


def test_table_references():
    got = lambda f: [(x[0], x[1], x[2], x[4]) for x in R.external_refs(f, {})]
    assert got("=SUM([Budget.xlsx]SalesTable[Amount])") == [("Budget.xlsx", "", "SalesTable", "table")]
    assert got("=[Budget.xlsx]SalesTable") == [("Budget.xlsx", "", "SalesTable", "table")]
    assert got("='[data.xlsx]Sheet1'!A1") == [("data.xlsx", "Sheet1", "A1", "cell")]
    assert got("='C:\\x\\[b.xlsx]'T[[#All],[q]]") == [("b.xlsx", "", "T", "table")]
    assert R.inner_refs("=[Budget.xlsx]Sales2024+B2", "S") == [("S", "B2")]


def test_settings():
    assert settings.read('{"top_n": 3}') == {"top_n": 3}
    got = settings.read("# how\ntop_n: 3\nmatching:\n  metric: 'cosine'  # kind\n  min_similarity: 0.9\n  exact: no\nsheets:\n  - A\n  - B 2\nnames: [x, y]\nempty:\n")
    assert got == {"top_n": 3, "matching": {"metric": "cosine", "min_similarity": 0.9, "exact": False}, "sheets": ["A", "B 2"], "names": ["x", "y"], "empty": {}}
    assert settings.read("") == {}


def test_macro_families():
    code = 'Set c = New ADODB.Connection\n c.Provider = "x"\nData Source=srv9;\nInitial Catalog=db9;\nGetObject("https://o.org/a.xls")\nGetObject("C:\\x\\y.doc")\n.Open "DELETE", "http://no.such/kind"\n'
    got = {(r[1], r[2], r[3]) for r in E.macro_sources(code, "M")}
    assert ("database", "odbc", "srv9/db9") in got and ("web", "url", "https://o.org/a.xls") in got and ("file", "local_file", "C:\\x\\y.doc") in got
    assert not any(k == "xmlhttp_request" for _, k, _ in got)


def packed_plain(text: bytes) -> bytes:
    """A compressed container without copies."""
    out = b"\x01"
    for at in range(0, len(text), 3600):
        part = text[at : at + 3600]
        body = b"".join(b"\0" + part[k : k + 8] for k in range(0, len(part), 8))
        out += (0xB000 | (len(body) - 1)).to_bytes(2, "little") + body
    return out


def compound(streams: dict[str, bytes], cutoff: int) -> bytes:
    """A compound file with sectors of 512 bytes; streams under ``cutoff`` are in the mini stream."""
    import struct

    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    fat, body, mini, mini_fat, entries = [0xFFFFFFFD], [b"\0" * 512], b"", [], []

    def store(data: bytes) -> int:
        first = len(fat)
        parts = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
        for k, p in enumerate(parts):
            fat.append(first + k + 1 if k + 1 < len(parts) else end)
            body.append(p)
        return first

    for name, data in streams.items():
        if len(data) < cutoff:
            first, n = len(mini_fat), -(-len(data) // 64)
            mini_fat += [first + k + 1 for k in range(n - 1)] + [end]
            mini += data.ljust(n * 64, b"\0")
        else:
            first = store(data)
        entries.append((name, 2, first, len(data)))
    root = store(mini) if mini else end
    mini_at = store(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini_fat else end
    rows = b""
    for name, kind, start, size in [("Root Entry", 5, root, len(mini)), *entries]:
        text = name.encode("utf-16-le")
        rows += (text.ljust(64, b"\0") + struct.pack("<HB", len(text) + 2, kind)).ljust(116, b"\0") + struct.pack("<IQ", start, size)
    directory = store(rows.ljust(-(-len(rows) // 512) * 512, b"\0"))
    body[0] = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = bytes.fromhex("d0cf11e0a1b11ae1").ljust(0x1E, b"\0") + struct.pack("<HH", 9, 6)
    head = head.ljust(0x30, b"\0") + struct.pack("<I4xIIIII", directory, cutoff, mini_at, int(bool(mini_fat)), end, 0)
    return head.ljust(0x4C, b"\0") + struct.pack("<109I", 0, *[free] * 108) + b"".join(body)


def test_macro_modules():
    from gridweave.sources import macros

    # A worked example of the format's specification.
    example = bytes.fromhex("012fb000236161616263646582660070616768696a013808616b6c00306d6e6f70067102700410727374757610777879 7a003c".replace(" ", ""))
    assert macros.unpacked(example) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"
    code = b'Attribute VB_Name = "M"\r\n' + b"' a line\r\n" * 700 + b'Workbooks.Open "D:\\in\\b.xlsx"\r\n'
    small = b'Attribute VB_Name = "S"\r\nx = "https://small.org/one"\r\n'
    project = compound({"M": b"junk" * 9 + packed_plain(code), "S": b"ab" + packed_plain(small), "dir": packed_plain(b"no module")}, 1024)
    assert [(n, t.encode()) for n, t in macros.modules(project)] == [("M", code), ("S", small)]

    class Holder:
        def raw(self, part):
            return project

    got = {(r[2], r[3], r[5]) for r in E.macros(Holder())}
    assert ("workbooks_open", "D:\\in\\b.xlsx", "VBA:M:702") in got and ("url", "https://small.org/one", "VBA:S:2") in got
    for cut in (b"", b"not a project", project[:700], project[:2000], b"\xff" * 600, project[:8] + b"\xff" * 900):
        assert isinstance(macros.modules(cut), list)
