"""Executable spreadsheet functions, group by group, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formulas import to_sql
from ..functions.sheet_functions import aggregate, compiled, scalar
from .registry import query


# The SQL beside each formula works in decimals, lists and intervals, not by the code's ways.
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, abs(l_discount - 0.05) AS f_abs, CAST(floor(d) AS DOUBLE) AS f_int, CAST(sign(d) * ceil(abs(d) * 10) / 10 AS DOUBLE) AS f_up1, CAST(sign(d) * ceil(abs(d)) AS DOUBLE) AS f_up,
CAST(sign(d) * floor(abs(d) / 100) * 100 AS DOUBLE) AS f_down_hundreds, CAST(sign(d) * floor(abs(d) * 10) / 10 AS DOUBLE) AS f_down1, CAST(round(d, 1) AS DOUBLE) AS f_round, CAST(((k % 7) + 7) % 7 AS DOUBLE) AS f_mod,
CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k > 0 THEN k % 7 - 7 ELSE k % 7 END AS DOUBLE) AS f_mod_negative, round(sqrt(l_quantity), 8) AS f_sqrt, CASE WHEN d < 0 THEN NULL ELSE round(sqrt(d), 8) END AS f_sqrt_error, round(ln(l_quantity), 8) AS f_ln,
round(log2(l_quantity), 8) AS f_log, round(log10(l_quantity), 8) AS f_log10, round(exp(l_discount), 8) AS f_exp, power(l_quantity, 2) AS f_power, -1.0::DOUBLE AS f_error, CASE WHEN l_discount = 0.05 THEN -2.0::DOUBLE ELSE round(1 / (l_discount - 0.05), 6) END AS f_divide
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18, 2)) - 40000 AS d, l_orderkey - 7000 AS k FROM lineitem)""")  # fmt: skip
def excel_fn_math(t):
    li = t("lineitem")
    names = {"A1": F.round(F.col("l_extendedprice") - 40000, 2), "B1": F.col("l_orderkey") - 7000, "C1": F.col("l_discount"), "Q1": F.col("l_quantity")}
    f = lambda text, n=None: compiled(text, names) if n is None else F.round(compiled(text, names), n)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", f("=ABS(C1-0.05)").alias("f_abs"), f("=INT(A1)").alias("f_int"), f("=ROUNDUP(A1,1)", 1).alias("f_up1"), f("=ROUNDUP(A1,0)").alias("f_up"), f("=ROUNDDOWN(A1,-2)").alias("f_down_hundreds"),
        f("=ROUNDDOWN(A1,1)", 1).alias("f_down1"), f("=ROUND(A1,1)").alias("f_round"), f("=MOD(B1,7)").alias("f_mod"), f("=MOD(B1,-7)").alias("f_mod_negative"), f("=SQRT(Q1)", 8).alias("f_sqrt"), f("=SQRT(A1)", 8).alias("f_sqrt_error"), f("=LN(Q1)", 8).alias("f_ln"),
        f("=LOG(Q1,2)", 8).alias("f_log"), f("=LOG10(Q1)", 8).alias("f_log10"), f("=EXP(C1)", 8).alias("f_exp"), f("=POWER(Q1,2)").alias("f_power"), f("=IFERROR(Q1/(Q1-Q1),-1)").alias("f_error"),
        f("=IFERROR(1/(C1-0.05),-2)", 6).alias("f_divide"),
    )


@query("""SELECT p_partkey, p_name[1:1] AS f_left1, p_name[1:3] AS f_left, p_name[-1:] AS f_right1, p_name[-3:] AS f_right, p_name[2:5] AS f_mid, CAST(length(p_name) AS BIGINT) AS f_len, upper(p_name) AS f_upper, lower(p_type) AS f_lower, p_name || ' x ' || p_brand AS f_trim,
p_name || '-' || p_brand || '-' || p_size AS f_concat, replace(p_name, 'e', 'EE') AS f_subst, CASE WHEN len(string_split(p_name, 'l')) > 2 THEN array_to_string(list_slice(string_split(p_name, 'l'), 1, 2), 'l') || 'L' || array_to_string(list_slice(string_split(p_name, 'l'), 3, 99), 'l') ELSE p_name END AS f_subst2,
CAST(nullif(instr(p_name, 'dg'), 0) AS BIGINT) AS f_find, CAST(nullif(instr(lower(p_brand), 'd#1'), 0) AS BIGINT) AS f_search, CAST(CASE WHEN p_brand SIMILAR TO '.*#1.+' THEN 6 END AS BIGINT) AS f_search_any, format('{:,.2f}', p_retailprice * 10) AS f_text_comma,
CAST(CAST(p_retailprice + 0.2 AS DECIMAL(18, 0)) AS VARCHAR) AS f_text_whole, format('{:05d}', p_size) AS f_text_wide, format('{:d}.5%', p_size * 10) AS f_text_percent, 'ends "' || p_size || '"' AS f_quote FROM part""")  # fmt: skip
def excel_fn_text(t):
    names = {"A1": F.col("p_name"), "B1": F.col("p_brand"), "C1": F.col("p_type"), "D1": F.col("p_size"), "E1": F.col("p_retailprice")}
    f = lambda text: compiled(text, names)
    n = lambda text: compiled(text, names).cast("long")
    return t("part").select(
        "p_partkey", f("=LEFT(A1)").alias("f_left1"), f("=LEFT(A1,3)").alias("f_left"), f("=RIGHT(A1)").alias("f_right1"), f("=RIGHT(A1,3)").alias("f_right"), f("=MID(A1,2,4)").alias("f_mid"), n("=LEN(A1)").alias("f_len"), f("=UPPER(A1)").alias("f_upper"), f("=LOWER(C1)").alias("f_lower"),
        f('=TRIM("  "&A1&"   x "&B1&" ")').alias("f_trim"), f('=CONCATENATE(A1,"-",B1,"-",D1)').alias("f_concat"), f('=SUBSTITUTE(A1,"e","EE")').alias("f_subst"), f('=SUBSTITUTE(A1,"l","L",2)').alias("f_subst2"), n('=FIND("dg",A1)').alias("f_find"), n('=SEARCH("D#1",B1)').alias("f_search"),
        n('=SEARCH("#1?",B1)').alias("f_search_any"), f('=TEXT(E1*10,"#,##0.00")').alias("f_text_comma"), f('=TEXT(E1+0.2,"0")').alias("f_text_whole"), f('=TEXT(D1,"00000")').alias("f_text_wide"), f('=TEXT(D1/10+0.005,"0.0%")').alias("f_text_percent"), f('="ends """&D1&""""').alias("f_quote"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS f_if, (o_totalprice > 100000 AND o_orderstatus = 'O') AS f_and, (o_totalprice > 100000 OR o_orderstatus = 'O') AS f_or,
NOT (o_orderstatus = 'F') AS f_not, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS f_ifs, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE -1 END AS f_ifna,
CASE WHEN o_orderkey % 3 = 0 THEN -1.0::DOUBLE ELSE 12.0 / (o_orderkey % 3) END AS f_iferror, CASE WHEN o_totalprice > 300000 THEN 'a' WHEN o_totalprice > 150000 THEN 'b' ELSE 'c' END AS f_nested FROM orders""")  # fmt: skip
def excel_fn_logic(t):
    names = {"A1": F.col("o_totalprice"), "B1": F.col("o_orderstatus"), "C1": F.col("o_orderkey")}
    f = lambda text: compiled(text, names)
    return t("orders").select(
        "o_orderkey", f('=IF(A1>200000,"high","low")').alias("f_if"), f('=AND(A1>100000,B1="O")').alias("f_and"), f('=OR(A1>100000,B1="O")').alias("f_or"), f('=NOT(B1="F")').alias("f_not"), f('=IFS(B1="F","final",B1="O","open")').alias("f_ifs"),
        f('=IFNA(IFS(B1="F",1,B1="O",2),-1)').alias("f_ifna"), f("=IFERROR(12/MOD(C1,3),-1)").alias("f_iferror"), f('=IF(A1>300000,"a",IF(A1>150000,"b","c"))').alias("f_nested"),
    )


@query("""SELECT o_orderkey, year(d) AS f_year, month(d) AS f_month, day(d) AS f_day, CAST(d + INTERVAL 3 MONTH AS DATE) AS f_edate, last_day(d + INTERVAL 1 MONTH) AS f_eomonth, make_date(year(d), 1, 1) AS f_date,
CAST(make_date(year(d) + 1, 2, 1) + INTERVAL 29 DAY AS DATE) AS f_date_over, date_diff('day', d, DATE '2004-02-29') AS f_days, (2004 - year(d)) * 12 + 2 - month(d) - CASE WHEN day(d) > 29 THEN 1 ELSE 0 END AS f_months, ((2004 - year(d)) * 12 + 2 - month(d) - CASE WHEN day(d) > 29 THEN 1 ELSE 0 END) // 12 AS f_years, ((2004 - year(d)) * 12 + 2 - month(d) - CASE WHEN day(d) > 29 THEN 1 ELSE 0 END) % 12 AS f_year_months,
strftime(d, '%d/%m/%Y') AS f_text, strftime(d, '%y-%b') AS f_text_short FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")  # fmt: skip
def excel_fn_date(t):
    names = {"A1": F.to_date("o_orderdate"), "B1": F.lit("2004-02-29").cast("date")}
    f = lambda text: compiled(text, names)
    n = lambda text: compiled(text, names).cast("long")
    return t("orders").select(
        "o_orderkey", n("=YEAR(A1)").alias("f_year"), n("=MONTH(A1)").alias("f_month"), n("=DAY(A1)").alias("f_day"), f("=EDATE(A1,3)").alias("f_edate"), f("=EOMONTH(A1,1)").alias("f_eomonth"), f("=DATE(YEAR(A1),1,1)").alias("f_date"), f("=DATE(YEAR(A1),14,30)").alias("f_date_over"),
        n('=DATEDIF(A1,B1,"D")').alias("f_days"), n('=DATEDIF(A1,B1,"M")').alias("f_months"), n('=DATEDIF(A1,B1,"Y")').alias("f_years"), n('=DATEDIF(A1,B1,"YM")').alias("f_year_months"), f('=TEXT(A1,"dd/mm/yyyy")').alias("f_text"), f('=TEXT(A1,"yy-mmm")').alias("f_text_short"),
    )


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS f_sum, round(avg(l_quantity), 6) AS f_avg, count(l_quantity) AS f_count, min(l_tax) AS f_min, max(l_extendedprice) AS f_max, round(median(l_quantity), 6) AS f_median,
round(stddev_samp(l_quantity), 6) AS f_stdev, round(stddev_pop(l_quantity), 6) AS f_stdevp, round(var_samp(l_quantity), 5) AS f_var, round(var_pop(l_quantity), 5) AS f_varp, count(*) FILTER (l_quantity > 25) AS f_countif,
count(*) FILTER (l_quantity > 25 AND l_discount < 0.04 AND l_linenumber <> 2) AS f_countifs, sum(l_quantity) FILTER (l_quantity > 25) AS f_sumif, coalesce(sum(l_quantity) FILTER (l_quantity > 49 AND l_discount < 0.01 AND l_tax = 0.08), 0) AS f_sumifs,
count(CASE WHEN l_linenumber > 3 THEN 'x' || l_linenumber END) AS f_counta, CAST(0 AS BIGINT) AS f_count_text, round(sum(l_quantity * l_discount), 4) AS f_sumproduct FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def excel_fn_aggregate(t):
    q, d, big = F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity") > 25
    r = lambda name, n, **k: F.round(aggregate(name, q, **k), n)
    words = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("x"), F.col("l_linenumber")))
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        aggregate("SUM", q).alias("f_sum"), r("AVERAGE", 6).alias("f_avg"), aggregate("COUNT", q).alias("f_count"), aggregate("MIN", F.col("l_tax")).alias("f_min"), aggregate("MAX", F.col("l_extendedprice")).alias("f_max"),
        r("MEDIAN", 6).alias("f_median"), r("STDEV", 6).alias("f_stdev"), r("STDEVP", 6).alias("f_stdevp"), r("VAR", 5).alias("f_var"), r("VARP", 5).alias("f_varp"), aggregate("COUNTIF", q, big).alias("f_countif"),
        aggregate("COUNTIFS", q, big, d < 0.04, F.col("l_linenumber") != 2).alias("f_countifs"), aggregate("SUMIF", q, big).alias("f_sumif"), aggregate("SUMIFS", q, q > 49, d < 0.01, F.col("l_tax") == 0.08).alias("f_sumifs"),
        aggregate("COUNTA", words).alias("f_counta"), aggregate("COUNT", words).alias("f_count_text"), r("SUMPRODUCT", 4, weight=d).alias("f_sumproduct"),
    )


@query("""WITH p AS (SELECT * FROM (VALUES ('1-URGENT', 1, 24), ('2-HIGH', 2, 48), ('3-MEDIUM', 3, 72), ('4-NOT SPECIFIED', 4, NULL)) v(name, place, hours)),
b AS (SELECT * FROM (VALUES (0, 'small'), (100000, 'middle'), (250000, 'large')) v(least, size)), x AS (SELECT * FROM (VALUES (400000, 1), (200000, 2), (0, 3)) v(bound, place))
SELECT o_orderkey, p.place AS f_match, CAST(p.hours AS DOUBLE) AS f_vlookup, coalesce(p.hours, 999)::DOUBLE AS f_xlookup, (SELECT size FROM b WHERE least <= o_totalprice ORDER BY least DESC LIMIT 1) AS f_vlookup_near,
(SELECT size FROM b WHERE least <= o_totalprice ORDER BY least DESC LIMIT 1) AS f_hlookup, (SELECT max(place) FROM x WHERE bound >= o_totalprice) AS f_match_down, (SELECT size FROM b WHERE least >= o_totalprice ORDER BY least LIMIT 1) AS f_xlookup_up,
['a', 'b', 'c', 'd', 'e'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS f_index, CAST([[1, 2, 3], [4, 5, 6]][CAST(o_orderkey % 2 AS INTEGER) + 1][CAST(o_orderkey % 3 AS INTEGER) + 1] AS DOUBLE) AS f_index2,
CASE WHEN o_orderkey % 9 < 2 THEN NULL ELSE chr(CAST(65 + o_orderkey % 9 - 2 AS INTEGER)) || (o_orderkey % 100 + 3) || ':' || chr(CAST(65 + o_orderkey % 9 - 1 AS INTEGER)) || (o_orderkey % 100 + 4) END AS f_offset
FROM orders LEFT JOIN p ON p.name = o_orderpriority""")  # fmt: skip
def excel_fn_lookup(t):
    row = lambda *xs: F.array(*[F.lit(x) for x in xs])
    names = {
        "A1": F.col("o_orderpriority"), "B1": F.col("o_totalprice"), "C1": (F.col("o_orderkey") % 6 + 1), "kinds": row("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), "hours": row(24.0, 48.0, 72.0, None),
        "terms": F.array(row("1-URGENT", "24"), row("2-HIGH", "48"), row("3-MEDIUM", "72"), row("4-NOT SPECIFIED", None)), "bands": F.array(row("0", "small"), row("100000", "middle"), row("250000", "large")),
        "bounds": row(400000.0, 200000.0, 0.0), "leasts": row(0.0, 100000.0, 250000.0), "sizes": row("small", "middle", "large"), "letters": row(*"abcde"), "grid": F.array(row(1.0, 2.0, 3.0), row(4.0, 5.0, 6.0)), "k": F.col("o_orderkey"),
        "corner": F.concat(F.lit("C"), F.col("o_orderkey") % 100 + 1, F.lit(":D"), F.col("o_orderkey") % 100 + 2),
    }
    f = lambda text: compiled(text, names)
    near = F.array(names["leasts"].cast("array<string>"), names["sizes"])
    bands = F.transform(names["bands"], lambda r: F.struct(F.get(r, F.lit(0)).cast("double").alias("least"), F.get(r, F.lit(1)).alias("size")))
    place = scalar("MATCH", F.col("o_totalprice"), F.transform(bands, lambda b: b["least"]), 1)
    return t("orders").select(
        "o_orderkey", f("=MATCH(A1,kinds,0)").alias("f_match"), f("=VLOOKUP(A1,terms,2,FALSE)").cast("double").alias("f_vlookup"), f("=XLOOKUP(A1,kinds,hours,999)").alias("f_xlookup"), scalar("INDEX", F.transform(bands, lambda b: b["size"]), place).alias("f_vlookup_near"),
        scalar("INDEX", scalar("INDEX", near, 2), scalar("MATCH", F.col("o_totalprice"), names["leasts"])).alias("f_hlookup"), f("=MATCH(B1,bounds,-1)").alias("f_match_down"), f("=XLOOKUP(B1,leasts,sizes,,1)").alias("f_xlookup_up"), f("=INDEX(letters,C1)").alias("f_index"),
        f("=INDEX(grid,MOD(k,2)+1,MOD(k,3)+1)").alias("f_index2"), f("=OFFSET(corner,2,MOD(k,9)-4)").alias("f_offset"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'CASE WHEN A' || l_orderkey || '!=0 THEN SUM(B1:B' || l_linenumber || ') ELSE price || "x" END' AS sql_text FROM lineitem""")
def formula_to_sql(t):
    """Formulas with a name for one cell, through the translator in Arrow batches."""
    from collections.abc import Iterator

    f = F.concat(F.lit("=IF(A"), F.col("l_orderkey"), F.lit("<>0, SUM($B$1:B"), F.col("l_linenumber"), F.lit('), Sheet1!C1&"x")'))

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([to_sql(x, {"Sheet1!C1": "price"}) for x in b.column(3).to_pylist()])], names=["l_orderkey", "l_linenumber", "l_partkey", "sql_text"])

    src = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey", f.alias("f"))
    return src.mapInArrow(run, "l_orderkey long, l_linenumber int, l_partkey long, sql_text string")
