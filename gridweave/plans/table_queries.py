"""Joins, aggregates, windows, set operations, text functions and graphs over the tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import refs, text
from ..operators import graph as G
from ..operators import tables as T
from .registry import query


@query("""WITH b AS (SELECT o_custkey, min(o_orderkey) AS lo, min(o_orderkey) + 50 AS hi FROM orders GROUP BY 1)
SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM b WHERE b.o_custkey = o.o_custkey AND o.o_orderkey BETWEEN lo AND hi)""")  # fmt: skip
def range_contains(t):
    o = t("orders")
    boxes = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), (F.min("o_orderkey") + 50).alias("hi")).withColumnRenamed("o_custkey", "sheet")
    return T.contained_points(o.select("o_orderkey", "o_custkey"), boxes, "o_custkey", "o_orderkey", "lo", "hi", "sheet")


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, min(l_partkey) AS lo, least(max(l_partkey), min(l_partkey) + 300) AS hi FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey AS suppkey, a.lo AS a_lo, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey
AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N'""")  # fmt: skip
def range_overlap(t):
    s = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_partkey").alias("lo"), F.least(F.max("l_partkey"), F.min("l_partkey") + 300).alias("hi"))
    a = s.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("suppkey"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = s.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("b_supp"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return T.overlapping(a, b, ("suppkey", "b_supp"), ("a_lo", "a_hi"), ("b_lo", "b_hi"), 64).drop("b_supp")


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, min(l_partkey) AS r1, least(max(l_partkey), min(l_partkey) + 300) AS r2, min(l_quantity) AS c1, least(max(l_quantity), min(l_quantity) + 15) AS c2 FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey AS suppkey, a.l_returnflag AS a_flag, b.l_returnflag AS b_flag FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 WHERE a.l_returnflag < b.l_returnflag""")  # fmt: skip
def range_overlap_2d(t):
    """Rectangles of one sheet that overlap in rows and columns."""
    g = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_partkey").alias("r1"), F.least(F.max("l_partkey"), F.min("l_partkey") + 300).alias("r2"), F.min("l_quantity").alias("c1"), F.least(F.max("l_quantity"), F.min("l_quantity") + 15).alias("c2"))
    box = F.struct("r1", "c1", "r2", "c2")
    a = g.select(F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("a_flag"), box.alias("a"))
    b = g.select(F.col("l_suppkey").alias("b_supp"), F.col("l_returnflag").alias("b_flag"), box.alias("b"))
    return T.overlapping_boxes(a, b, [("suppkey", "b_supp")], ("a", "b"), 64).where("a_flag < b_flag").select("suppkey", "a_flag", "b_flag")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def dedup_first_wins(t):
    return T.first_wins(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_event FROM events GROUP BY 1")
def summary_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first_event"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets(t):
    return T.counts_by(t("documents"), ["lang"], ["source"], [])


@query("SELECT c_custkey, substr(c_mktsegment, 1, 3) || '_' || substr(sha256(c_mktsegment || '|' || c_name || '|' || c_nationkey), 1, 12) AS conn_id FROM customer")
def conn_id(t):
    return t("customer").select("c_custkey", text.connection_id(F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string")).alias("conn_id"))


@query(r"""SELECT doc_id, length(text) AS n, lower(regexp_extract(text, '(?i)\b(source|per|from|bloomberg|reuters|factset|capital iq|according to|based on)\b', 1)) AS note
FROM documents WHERE regexp_matches(text, '(?i)\b(source|per|from|bloomberg|reuters|factset|capital iq|according to|based on)\b') AND length(text) >= 8""")  # fmt: skip
def source_note(t):
    d = t("documents").where(F.col("text").rlike(text.SOURCE_NOTE) & (F.length("text") >= 8))
    return d.select("doc_id", F.length("text").cast("long").alias("n"), F.lower(F.regexp_extract("text", text.SOURCE_NOTE, 1)).alias("note"))


_LINK = """CASE WHEN regexp_matches(lower({c}), '^https?://') THEN 'http' WHEN starts_with(lower({c}), 'file:') THEN 'file_url' WHEN starts_with({c}, '\\\\') THEN 'unc_path'
WHEN starts_with(lower({c}), 'mailto:') THEN 'mailto' WHEN regexp_matches(lower({c}), '^[a-z]:[\\\\/]') THEN 'local_file' ELSE 'hyperlink' END"""


@query(f"""SELECT page_id, href, {_LINK.format(c='href')} AS kind FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""")
def hyperlinks(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.withColumn("kind", text.link_kind(F.col("href")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_IDX = """(CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
ELSE chr(CAST(64 + ((n - 1) // 26 - 1) // 26 AS INTEGER)) || chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) END)"""


@query(f"SELECT p_partkey, {_IDX} AS letters FROM (SELECT p_partkey, p_partkey % 16384 + 1 AS n FROM part)")
def idx_to_col(t):
    return t("part").select("p_partkey", refs.idx_to_col((F.col("p_partkey") % 16384 + 1).cast("int")).alias("letters"))


@query("SELECT p_partkey, CAST(p_partkey % 16384 + 1 AS INTEGER) AS idx FROM part")
def col_to_idx(t):
    letters = refs.idx_to_col((F.col("p_partkey") % 16384 + 1).cast("int"))
    return t("part").select("p_partkey", letters.alias("letters")).select("p_partkey", refs.col_to_idx(F.col("letters")).alias("idx"))


@query("""SELECT l_orderkey, CASE WHEN lo = hi THEN chr(64 + lo) || l_orderkey ELSE chr(64 + lo) || l_orderkey || ':' || chr(64 + hi) || l_orderkey END AS rng
FROM (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)""")  # fmt: skip
def a1_range(t):
    b = t("lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return b.select("l_orderkey", refs.a1_range(F.col("l_orderkey"), F.col("lo"), F.col("l_orderkey"), F.col("hi")).alias("rng"))


@query("""SELECT l_orderkey, CAST(greatest(l_orderkey, 1) AS INTEGER) AS r1, CAST(min(l_linenumber) AS INTEGER) AS c1, CAST(greatest(l_orderkey, 1) + 2 AS INTEGER) AS r2, CAST(max(l_linenumber) AS INTEGER) AS c2 FROM lineitem GROUP BY l_orderkey""")
def range_to_rect(t):
    b = t("lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    row = F.greatest("l_orderkey", F.lit(1))
    rng = F.concat(F.lit("$"), refs.idx_to_col(F.col("hi")), F.lit("$"), row + 2, F.lit(":"), refs.idx_to_col(F.col("lo")), row)
    return b.select("l_orderkey", refs.rect(rng).alias("x")).select("l_orderkey", "x.r1", "x.c1", "x.r2", "x.c2")


@query("""SELECT o_orderkey, chr(CAST(65 + c AS INTEGER)) || r AS cell FROM (SELECT o_orderkey, o_orderkey % 100 + 1 + unnest([0, 0, 1, 1]) AS r, unnest([0, 1, 0, 1]) AS c FROM orders)""")
def expand_range(t):
    row = (F.col("o_orderkey") % 100 + 1).cast("string")
    rng = F.concat(F.lit("A"), row, F.lit(":B"), (F.col("o_orderkey") % 100 + 2).cast("string"))
    return t("orders").select("o_orderkey", F.explode(refs.expand(rng)).alias("cell"))


# A conversation's turns are cells; each refers to the turn before it.
@query("""WITH RECURSIVE w AS (SELECT conv_id, turn AS start, turn AS node, 0 AS depth FROM (SELECT DISTINCT conv_id, turn FROM conversations)
UNION SELECT w.conv_id, w.start, c.turn, w.depth + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.node - 1 WHERE w.depth < 20)
SELECT conv_id, start AS turn, max(depth) AS hops, min(node) AS root FROM w GROUP BY 1, 2""")  # fmt: skip
def precedent_bfs(t):
    cells = t("conversations").select("conv_id", "turn").distinct()
    key = F.struct("conv_id", "turn")
    edges = cells.where("turn > 0").select(key.alias("src"), F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("dst"))
    edges = edges.join(cells.select(key.alias("there")), F.col("dst") == F.col("there"), "left_semi")
    found = G.reach(cells.select(key.alias("start"), key.alias("node")), edges, 20)
    return found.groupBy("start").agg(F.max("depth").alias("hops"), F.min("node.turn").alias("root")).select("start.conv_id", "start.turn", "hops", "root")


_FILES = """e AS (SELECT DISTINCT 'order:' || o_orderpriority AS src, 'customer:' || c_mktsegment AS dst FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT DISTINCT 'customer:' || c_mktsegment, 'nation:' || c_nationkey FROM customer
UNION SELECT DISTINCT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


def file_edges(t):
    c, n = t("customer"), t("nation")
    tag = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    e = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(tag("order", "o_orderpriority").alias("src"), tag("customer", "c_mktsegment").alias("dst"))
    e = e.union(c.select(tag("customer", "c_mktsegment"), tag("nation", "c_nationkey"))).union(n.select(tag("nation", "n_nationkey"), tag("region", "n_regionkey")))
    return e.distinct()


@query(f"""WITH RECURSIVE {_FILES}, w AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM e WHERE src LIKE 'order:%'
UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 10)
SELECT start, node, CAST(min(depth) AS INTEGER) AS level FROM w GROUP BY 1, 2""")  # fmt: skip
def file_levels(t):
    e = G.cut(file_edges(t))
    starts = e.where("src LIKE 'order:%'").select(F.col("src").alias("start"), F.col("src").alias("node"))
    return G.reach(starts, e, 10).withColumnRenamed("depth", "level")


@query(f"""WITH RECURSIVE {_FILES}, l AS (SELECT src AS node, 0 AS level FROM e UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM (SELECT * FROM l UNION ALL SELECT dst, 0 FROM e) GROUP BY 1""")  # fmt: skip
def topological_levels(t):
    return G.depth_levels(G.cut(file_edges(t)))


@query(f"""WITH RECURSIVE {_FILES}, d AS (SELECT DISTINCT dst AS start, dst AS node FROM e WHERE dst LIKE 'nation:%' UNION SELECT d.start, e.dst FROM d JOIN e ON e.src = d.node)
, a AS (SELECT DISTINCT dst AS start, dst AS node FROM e WHERE dst LIKE 'nation:%' UNION SELECT a.start, e.src FROM a JOIN e ON e.dst = a.node)
SELECT start, count(*) AS n_connected FROM (SELECT * FROM a UNION SELECT * FROM d) WHERE start <> node GROUP BY 1""")  # fmt: skip
def ancestors_descendants(t):
    e = G.cut(file_edges(t))
    starts = e.where("dst LIKE 'nation:%'").select(F.col("dst").alias("start"), F.col("dst").alias("node"))
    down = G.reach(starts, e)
    up = G.reach(starts, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return down.select("start", "node").union(up.select("start", "node")).distinct().where("start <> node").groupBy("start").agg(F.count("*").alias("n_connected"))


@query("""SELECT c_custkey AS node, CAST(CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE c_custkey % 4 END AS INTEGER) AS level FROM customer""")
def cyclic_levels(t):
    """Four customers in a row: two steps on, back from the third to the first of them, and the
    fourth beside the second. The step back closes a cycle and is left out."""
    k = F.col("c_custkey")
    last = (k % 4 == 3)
    e = t("customer").select(F.when(last, k - 3).otherwise(k).alias("src"), F.when(last, k).when(k % 4 == 2, k - 2).otherwise(k + 1).alias("dst"))
    known = t("customer").select(k.alias("there"))
    return G.depth_levels(e.join(known, F.col("dst") == F.col("there"), "left_semi"))


@query("""SELECT c_nationkey, count(*) AS n_missing, min(c_custkey) AS first_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1""")
def missing_files(t):
    gone = t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return gone.groupBy("c_nationkey").agg(F.count("*").alias("n_missing"), F.min("c_custkey").alias("first_key"))


@query("""SELECT p_partkey, lower(p_name) AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def phantom_links(t):
    used = t("lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey")
    return t("part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", F.lower("p_name").alias("name"))


@query("""SELECT event_type, user_id, CASE WHEN n <= 3 THEN array_to_string(cells, ', ') ELSE cells[1] || ', ... (' || n || ' cells)' END AS label
FROM (SELECT event_type, user_id, list_sort(list_distinct(list('C' || event_id))) AS cells, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2)""")  # fmt: skip
def edge_agg_label(t):
    cells = t("events").groupBy("event_type", "user_id").agg(F.collect_set(F.concat(F.lit("C"), F.col("event_id"))).alias("cells"))
    return cells.select("event_type", "user_id", text.cells_label(F.col("cells")).alias("label"))


@query("""SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def sheet_edges_distinct(t):
    li = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    oc = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    e = li.select("l_orderkey", "s_nationkey").distinct().join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
    return e.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query("""WITH h AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS label FROM lineitem GROUP BY 1), c AS (SELECT l_linenumber, arg_min(l_suppkey, (l_orderkey, l_suppkey)) AS header FROM lineitem GROUP BY 1)
SELECT DISTINCT l.l_orderkey, l.l_linenumber, label, header FROM lineitem l JOIN h ON l.l_orderkey = h.l_orderkey JOIN c ON l.l_linenumber = c.l_linenumber""")  # fmt: skip
def context_join(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    label = li.groupBy(F.col("l_orderkey").alias("ok")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("label"))
    header = li.groupBy(F.col("l_linenumber").alias("ln")).agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_suppkey")).alias("header"))
    cells = li.select("l_orderkey", "l_linenumber").distinct()
    return cells.join(label, F.col("l_orderkey") == F.col("ok")).join(header, F.col("l_linenumber") == F.col("ln")).select("l_orderkey", "l_linenumber", "label", "header")


@query("""WITH g AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS r, l_linenumber AS c FROM lineitem)
SELECT a.s, a.r, a.c, count(*) AS n_near FROM g a JOIN g b ON a.s = b.s AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY ALL""")  # fmt: skip
def neighborhood(t):
    g = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c")).distinct()
    return T.neighbourhood(g, "s", "r", "c", 3).groupBy("s", "r", "c").agg(F.count("*").alias("n_near"))


# Two lines of a grid of orders by line numbers touch if they are neighbours along either.
_COMP = """WITH RECURSIVE g AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS r, l_linenumber AS c FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20)
, e AS (SELECT a.id AS x, b.id AS y FROM g a JOIN g b ON (a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1))
, w AS (SELECT id AS x, id AS y FROM g UNION SELECT w.x, e.y FROM w JOIN e ON w.y = e.x)
, l AS (SELECT x AS node, min(y) AS component FROM w GROUP BY 1)"""


def grid_edges(t):
    g = t("lineitem").where("l_returnflag = 'R' AND l_quantity > 20").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c")).distinct()
    node = lambda r, c: F.col(r) * 8 + F.col(c)
    near = g.select(node("r", "c").alias("src"), F.explode(F.array(F.struct(F.col("r"), (F.col("c") + 1).alias("c")), F.struct((F.col("r") + 1).alias("r"), F.col("c")))).alias("to"))
    near = near.join(g.withColumnRenamed("r", "gr").withColumnRenamed("c", "gc"), (F.col("to.r") == F.col("gr")) & (F.col("to.c") == F.col("gc")), "left_semi")
    return g.withColumn("node", node("r", "c")), near.select("src", (F.col("to.r") * 8 + F.col("to.c")).alias("dst"))


@query(_COMP + " SELECT component, count(*) AS n_cells FROM l GROUP BY 1 HAVING count(*) > 1")
def connected_components(t):
    _, e = grid_edges(t)
    return G.components(e).groupBy("component").agg(F.count("*").alias("n_cells"))


@query(_COMP + """ SELECT component, min(r) AS r1, min(c) AS c1, max(r) AS r2, max(c) AS c2, count(*) AS n_cells FROM l JOIN g ON node = id GROUP BY 1
HAVING count(*) >= 4 AND max(r) > min(r) AND max(c) > min(c)""")  # fmt: skip
def pasted_tables(t):
    g, e = grid_edges(t)
    placed = G.components(e).join(g.withColumnRenamed("node", "cell"), F.col("node") == F.col("cell"))
    box = placed.groupBy("component").agg(F.min("r").alias("r1"), F.min("c").alias("c1"), F.max("r").alias("r2"), F.max("c").alias("c2"), F.count("*").alias("n_cells"))
    return box.where("n_cells >= 4 AND r2 > r1 AND c2 > c1")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT p_size AS k FROM part EXCEPT SELECT CAST(l_quantity AS INTEGER) FROM lineitem WHERE l_quantity > 25")
def set_except(t):
    return t("part").select(F.col("p_size").alias("k")).subtract(t("lineitem").where("l_quantity > 25").select(F.col("l_quantity").cast("int")))


@query("SELECT 'customer' AS kind, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def union_all_extractors(t):
    c = t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(t("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")))


_PATHS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'file:///C:/data/' || page_id || '.xlsx' WHEN 2 THEN 'file://server' || page_id || '/share/b.xlsx'
WHEN 3 THEN 'https://team.sharepoint.com/sites/' || page_id || '/Book.xlsx?web=1' ELSE 'book' || page_id || '.xlsx' END AS path FROM pages"""


def paths(t):
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 5
    path = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("file:///C:/data/"), i, F.lit(".xlsx"))).when(k == 2, F.concat(F.lit("file://server"), i, F.lit("/share/b.xlsx")))
        .when(k == 3, F.concat(F.lit("https://team.sharepoint.com/sites/"), i, F.lit("/Book.xlsx?web=1"))).otherwise(F.concat(F.lit("book"), i, F.lit(".xlsx")))
    )
    return t("pages").select("page_id", path.alias("path"))


@query(f"""WITH p AS ({_PATHS}) SELECT page_id, CASE WHEN regexp_matches(lower(path), '^https?://.*sharepoint') THEN 'sharepoint_workbook' WHEN regexp_matches(lower(path), '^https?://') THEN 'http_workbook'
WHEN regexp_matches(lower(path), '^([a-z]:|file:)') THEN 'local_file' ELSE 'external_workbook' END AS kind FROM p""")  # fmt: skip
def path_classify(t):
    return paths(t).select("page_id", text.path_kind(F.col("path")).alias("kind"))


@query(rf"""WITH p AS ({_PATHS}) SELECT page_id, CASE WHEN regexp_matches(path, '^file:///[A-Za-z]:') THEN replace(substr(path, 9), '/', chr(92)) WHEN regexp_matches(path, '^file://[^/]') THEN replace(substr(path, 6), '/', chr(92)) ELSE path END AS normal FROM p""")
def path_normalise(t):
    return paths(t).select("page_id", text.normalise_path(F.col("path")).alias("normal"))


@query(rf"""WITH p AS ({_PATHS}) SELECT page_id, CASE page_id % 5 WHEN 0 THEN list_last(string_split(split_part(split_part(path, '?', 1), '#', 1), '/')) WHEN 1 THEN page_id || '.xlsx' WHEN 2 THEN 'b.xlsx' WHEN 3 THEN 'Book.xlsx' ELSE 'book' || page_id || '.xlsx' END AS name,
'Plan ' || page_id || ' & 50% ü+.xlsx' AS unquoted FROM p""")  # fmt: skip
def file_name(t):
    quoted = F.concat(F.lit("https://x.org/a%20b/Plan%20"), F.col("page_id"), F.lit("%20%26%2050%25%20%C3%BC+.xlsx?web=1#top"))
    return paths(t).select("page_id", text.file_name(F.col("path")).alias("name"), text.file_name(quoted).alias("unquoted"))


_CONN = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Provider=SQLOLEDB;Data Source=' || c_name || ';Initial Catalog=' || c_mktsegment WHEN 1 THEN 'DSN=' || c_mktsegment || ';UID=x'
WHEN 2 THEN 'Driver={Oracle in home};Server="' || c_name || ';1";Trusted=yes' ELSE 'Database=' || c_mktsegment END AS conn, c_name, c_mktsegment FROM customer"""


@query(f"""WITH c AS ({_CONN}) SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'sql_server' WHEN 1 THEN 'odbc_dsn' WHEN 2 THEN 'oracle' ELSE 'odbc' END AS kind,
CASE c_custkey % 4 WHEN 0 THEN c_name || '/' || c_mktsegment WHEN 1 THEN 'DSN:' || c_mktsegment WHEN 2 THEN c_name || ';1' ELSE c_mktsegment END AS label FROM c""")  # fmt: skip
def connection_string(t):
    n, m, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 4
    conn = (
        F.when(k == 0, F.concat(F.lit("Provider=SQLOLEDB;Data Source="), n, F.lit(";Initial Catalog="), m)).when(k == 1, F.concat(F.lit("DSN="), m, F.lit(";UID=x")))
        .when(k == 2, F.concat(F.lit('Driver={Oracle in home};Server="'), n, F.lit(';1";Trusted=yes'))).otherwise(F.concat(F.lit("Database="), m))
    )
    c = t("customer").select("c_custkey", conn.alias("conn")).withColumn("settings", text.connection_settings(F.col("conn")))
    parts = text.connection_parts(F.col("settings"))
    return c.select("c_custkey", parts["kind"].alias("kind"), text.source_label(parts).alias("label"))


@query("SELECT p_partkey, 'EXT__' || substr(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9]', '_', 'g'), 1, 75) AS node_id, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') AS python_name FROM part")
def identifiers(t):
    name = F.concat_ws("/", "p_name", "p_brand")
    return t("part").select("p_partkey", text.node_id(name).alias("node_id"), text.python_name(F.concat_ws(" ", "p_name", "p_brand")).alias("python_name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, x, CASE WHEN x = floor(x) AND abs(x) < 1e12 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE format('{:.4g}', x) END AS shown FROM (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN l_extendedprice
WHEN 1 THEN -l_extendedprice * 1e9 WHEN 2 THEN l_extendedprice / 1e9 WHEN 3 THEN l_quantity ELSE l_discount - 1234.5 END AS x FROM lineitem)""")  # fmt: skip
def number_format(t):
    p, k = F.col("l_extendedprice"), F.col("l_orderkey") % 5
    x = F.when(k == 0, p).when(k == 1, -p * 1e9).when(k == 2, p / 1e9).when(k == 3, F.col("l_quantity")).otherwise(F.col("l_discount") - 1234.5)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x")).withColumn("shown", text.number_text(F.col("x")))


@query("""SELECT conv_id, array_to_string(list(conv_id || '!A' || turn || ' (=' || substr(text, 1, 80) || ')' ORDER BY turn, text), ' → ') AS chain FROM conversations GROUP BY 1""")
def chain_format(t):
    step = F.struct("turn", F.col("text").alias("formula"), F.col("conv_id").cast("string").alias("sheet"), F.concat(F.lit("A"), F.col("turn")).alias("cell"))
    chains = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("chain"))
    return chains.select("conv_id", text.chain_text(F.col("chain")).alias("chain"))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, 'book' || l_suppkey || '.xlsx' AS file, 'Sheet' || l_linenumber AS sheet, 'B' || l_partkey AS cell FROM lineitem""")
def formula_external_ref(t):
    from ..functions import formulas

    f = F.concat(F.lit("='[book"), F.col("l_suppkey"), F.lit(".xlsx]Sheet"), F.col("l_linenumber"), F.lit("'!$B$"), F.col("l_partkey"), F.lit("*2"))
    got = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", f.alias("formula")).withColumn("x", formulas.external_reference(F.col("formula")))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "x.file", "x.sheet", F.regexp_replace("x.cell", r"\$", "").alias("cell"))


# A formula for each detector; {0} is an event's number.
DETECTED = (
    ('=BDP("ticker {0}","PX_LAST")', "bloomberg", "ticker {0}"), ('=1+RHistory("RIC{0}",".Close")', "reuters", "RIC{0}"), ('=FDS("F{0}","P_PRICE")', "factset", "F{0}"), ('=CIQ("NYSE:{0}","IQ_TOTAL_REV")', "capitaliq", "NYSE:{0}"),
    ('=SNL("S{0}",1)', "snl", "S{0}"), ('=WSD("W{0}","close")', "wind", "W{0}"), ('=WEBSERVICE("http://x.org/{0}")', "webservice", "http://x.org/{0}"), ('=RTD("srv.{0}",,"T")', "rtd", "srv.{0}"),
    ("='https://acme.sharepoint.com/s/{0}/[B.xlsx]Q'!A1", "sharepoint_workbook", "https://acme.sharepoint.com/s/{0}/B.xlsx"), ("='https://acme.onedrive.com/{0}/[B.xlsx]Q'!A1", "onedrive_workbook", "https://acme.onedrive.com/{0}/B.xlsx"),
    ("='https://files.org/{0}/[B.xlsx]Q'!A1", "http_workbook", "https://files.org/{0}/B.xlsx"), ("=[{0}]Sheet1!A1*2", "external_workbook_ref", "[ExternalLink{0}]"), ('=INDIRECT("Data!A{0}")', "indirect_ref", "Data!A{0}"), ("='[book{0}.xlsx]S'!A1", "external_workbook", "book{0}.xlsx"),
    ("='\\\\srv{0}\\share\\[b.xlsx]S'!A1", "unc_path", "\\\\srv{0}\\share\\b.xlsx"), ("='C:\\d{0}\\[b.xlsm]S'!A1", "local_file", "C:\\d{0}\\b.xlsm"), ("=SUM(A1:A{0})", "", ""),
)


def _filled(pattern: str, number: Column) -> Column:
    return F.concat(*[x for k, part in enumerate(pattern.split("{0}")) for x in ([number] if k else []) + [F.lit(part)]])


_DETECTED_SQL = ", ".join(f"({k}, '{kind}', '{source}')" for k, (_, kind, source) in enumerate(DETECTED) if kind)


@query(f"""SELECT event_id, kind AS sub_type, replace(source, '{{0}}', CAST(event_id AS VARCHAR)) AS source FROM events JOIN (VALUES {_DETECTED_SQL}) d(k, kind, source) ON event_id % {len(DETECTED)} = k""")
def formula_detectors(t):
    """One formula for each detector, and one without any source."""
    from ..functions import formulas

    e, k = F.col("event_id").cast("string"), F.col("event_id") % len(DETECTED)
    f = F.coalesce(*[F.when(k == i, _filled(pattern, e)) for i, (pattern, _, _) in enumerate(DETECTED)])
    return t("events").select("event_id", F.explode(formulas.detect(f)).alias("d")).select("event_id", F.col("d.sub_type").alias("sub_type"), F.col("d.source").alias("source"))


@query("""SELECT c_custkey, ['orders', 'customer', 'nation', 'hot'] AS tables, ['o_orderkey', 'c_name', 'k', 'c_custkey', 'n', 'flag', 'x'] AS columns, ['INNER customer ON o.k = c.k AND f(c.n, 2) > 1', 'LEFT nation ON n.k = c.k'] AS joins,
'c.c_custkey = ' || c_custkey || ' AND o.k IN (SELECT k FROM hot WHERE x = ''a, where b'')' AS filter FROM customer""")  # fmt: skip
def sql_parse(t):
    """Functions with commas, aliases, a subquery, keywords inside strings and comments."""
    from ..functions.sql_text import sql_parts

    sql = F.concat(
        F.lit("SELECT o.o_orderkey AS id, coalesce(c.c_name, 'a, from b') name, count(*) /* select z */ FROM [db].dbo.[orders] o JOIN customer AS c ON o.k = c.k AND f(c.n, 2) > 1\nLEFT OUTER JOIN nation n ON n.k = c.k WHERE c.c_custkey = "),
        F.col("c_custkey"), F.lit(" AND o.k IN (SELECT k FROM hot WHERE x = 'a, where b') GROUP BY flag ORDER BY 1 -- from nowhere"),
    )
    p = t("customer").select("c_custkey", sql_parts(sql).alias("p"))
    joins = F.transform("p.joins", lambda j: F.concat(j["type"], F.lit(" "), j["table"], F.lit(" ON "), j["on"]))
    order = F.array(*[F.lit(c) for c in ("o_orderkey", "c_name", "k", "c_custkey", "n", "flag", "x")])
    known = F.filter(order, lambda c: F.array_contains("p.columns", c))
    return p.select("c_custkey", "p.tables", F.concat(known, F.array_except("p.columns", order)).alias("columns"), joins.alias("joins"), F.col("p.filter").alias("filter"))


@query("""SELECT c_custkey, u.* FROM customer, (VALUES ('Budget.xlsx', '', 'SalesTable', 'table'), ('Plan A.xlsx', 'In', 'B2:B9', 'cell'), ('rates.xlsx', '', 'FX', 'named_range'), ('data.xlsx', '', 'Financials', 'table')) u(file, sheet, target, ref_type)""")
def formula_book_refs(t):
    """References into other workbooks: a table's column, a link number, a name, a bare table."""
    from collections.abc import Iterator

    from ..operators import formula_refs as R

    f = F.concat(F.lit("=SUM([Budget.xlsx]SalesTable[Amount])+[1]In!$B$2:B9+'[rates.xlsx]'!FX*"), F.col("c_custkey"), F.lit('&"[no.xlsx]S!A1"&[data.xlsx]Financials'))

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            rows = [(k, *x[:3], x[4]) for k, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in R.external_refs(text, {1: "https://x/Plan%20A.xlsx?web=1"})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(5)], names=["c_custkey", "file", "sheet", "target", "ref_type"])

    return t("customer").select("c_custkey", f.alias("f")).mapInArrow(run, "c_custkey long, file string, sheet string, target string, ref_type string")


@query("""SELECT s_suppkey, coalesce(n_name, 'unknown') AS label, coalesce(r_name, '[' || s_nationkey || ']') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 0""")
def lookup_with_fallback(t):
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region").where("r_regionkey > 0"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("label"), F.coalesce("r_name", F.concat(F.lit("["), F.col("s_nationkey"), F.lit("]"))).alias("region"))


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) AS r FROM orders) WHERE r = 1""")
def priority_pick(t):
    p = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return T.priority_pick(t("orders"), ["o_custkey"], p, [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT coalesce(c.k, s.k) AS k, coalesce(c_name, s_name) AS name, c.k IS NOT NULL AND s.k IS NOT NULL AS merged
FROM (SELECT c_custkey AS k, c_name FROM customer) c FULL JOIN (SELECT s_suppkey * 3 AS k, s_name FROM supplier) s ON c.k = s.k""")  # fmt: skip
def name_merge(t):
    c = t("customer").select(F.col("c_custkey").alias("ck"), "c_name")
    s = t("supplier").select((F.col("s_suppkey") * 3).alias("sk"), "s_name")
    j = c.join(s, F.col("ck") == F.col("sk"), "full")
    return j.select(F.coalesce("ck", "sk").alias("k"), F.coalesce("c_name", "s_name").alias("name"), (F.col("ck").isNotNull() & F.col("sk").isNotNull()).alias("merged"))


@query("""SELECT l_suppkey, max(l_orderkey) AS max_row, max(l_linenumber) AS max_col, count(DISTINCT (l_orderkey, l_linenumber)) AS n_cells FROM lineitem GROUP BY 1""")
def sheet_dimension(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.max("l_orderkey").alias("max_row"), F.max("l_linenumber").alias("max_col"), F.countDistinct("l_orderkey", "l_linenumber").alias("n_cells"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, max(q) FILTER (l_linenumber = 1) AS a, max(q) FILTER (l_linenumber = 2) AS b, max(q) FILTER (l_linenumber = 3) AS c FROM g GROUP BY 1""")
def sheet_head(t):
    g = t("lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.sum("l_quantity"))
    return g.select("l_orderkey", F.col("1").alias("a"), F.col("2").alias("b"), F.col("3").alias("c"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(DISTINCT o_orderpriority) AS n_kinds, max(o_orderstatus = 'O') AS any_open FROM orders GROUP BY 1""")
def summary_counters(t):
    o = F.col("o_orderstatus") == "O"
    return t("orders").groupBy("o_custkey").agg(F.count_if(o).alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.countDistinct("o_orderpriority").alias("n_kinds"), F.max(o).alias("any_open"))


@query("""SELECT l_partkey, CASE WHEN max(l_returnflag = 'R') THEN 'exact' ELSE 'approximate' END AS best, count(DISTINCT l_suppkey) AS n_sheets, list_sort(list_distinct(list(l_suppkey)))[1:5] AS ranges FROM lineitem GROUP BY 1""")
def best_match_per_file(t):
    return t("lineitem").groupBy("l_partkey").agg(
        F.when(F.max(F.col("l_returnflag") == "R"), "exact").otherwise("approximate").alias("best"), F.countDistinct("l_suppkey").alias("n_sheets"), F.slice(F.array_sort(F.collect_set("l_suppkey")), 1, 5).alias("ranges")
    )


@query("""SELECT lower(name) AS item, min(kind) AS kind FROM (SELECT p_name AS name, 'file' AS kind FROM part UNION ALL SELECT c_mktsegment, 'connection' FROM customer WHERE c_mktsegment NOT IN ('BUILDING')) GROUP BY 1""")
def required_inputs(t):
    items = t("part").select(F.col("p_name").alias("name"), F.lit("file").alias("kind")).union(t("customer").where(~F.col("c_mktsegment").isin("BUILDING")).select("c_mktsegment", F.lit("connection")))
    return items.groupBy(F.lower("name").alias("item")).agg(F.min("kind").alias("kind"))


@query("""SELECT e.event_id, CASE WHEN o.k IS NOT NULL THEN 'output' WHEN i.k IS NOT NULL THEN 'input' ELSE 'intermediate' END AS variable_type FROM events e
LEFT JOIN (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase' AND value > 90) o ON e.user_id = o.k LEFT JOIN (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'signup' AND value > 80) i ON e.user_id = i.k""")  # fmt: skip
def variable_typing(t):
    e = t("events")
    keys = lambda kind, v, name: e.where((F.col("event_type") == kind) & (F.col("value") > v)).select(F.col("user_id").alias(name)).distinct()
    j = e.join(keys("purchase", 90, "o"), F.col("user_id") == F.col("o"), "left").join(keys("signup", 80, "i"), F.col("user_id") == F.col("i"), "left")
    return j.select("event_id", F.when(F.col("o").isNotNull(), "output").when(F.col("i").isNotNull(), "input").otherwise("intermediate").alias("variable_type"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.95::DOUBLE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 0.9 WHEN l_linestatus = 'F' THEN 0.7 WHEN l_discount > 0.05 THEN 0.85 WHEN l_tax > 0.04 THEN 0.75 END AS confidence
FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F' OR l_discount > 0.05 OR l_tax > 0.04""")  # fmt: skip
def confidence_ladder(t):
    from ..functions import formulas

    c = formulas.confidence(named=F.col("l_returnflag") == "R", is_input=F.col("l_linestatus") == "F", label=F.col("l_quantity") > 25, header=F.col("l_discount") > 0.05, labelled=F.col("l_tax") > 0.04)
    return t("lineitem").select("l_orderkey", "l_linenumber", c.alias("confidence")).where("confidence IS NOT NULL")


@query("""SELECT p_partkey, substr(p_name, 1, 31) || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS sheet FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(substr(p_name, 1, 31)) ORDER BY p_partkey) AS n FROM part)""")
def unique_sheet_names(t):
    n = F.row_number().over(Window.partitionBy(F.lower(F.substring("p_name", 1, 31))).orderBy("p_partkey"))
    p = t("part").withColumn("n", n)
    return p.select("p_partkey", F.concat(F.substring("p_name", 1, 31), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n"))).otherwise("")).alias("sheet"))


@query("""SELECT event_type, user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 99 END AS pos, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 99 END, event_type) AS place
FROM (SELECT DISTINCT event_type, user_id FROM events)""")  # fmt: skip
def fixed_category_order(t):
    """Categories of each user: those of the fixed list first, then by name."""
    p = F.array_position(F.array(F.lit("purchase"), F.lit("click")), F.col("event_type"))
    e = t("events").select("event_type", "user_id", F.when(p > 0, p).otherwise(99).cast("int").alias("pos")).distinct()
    return e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("pos", "event_type")).cast("long"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(t):
    w = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")  # fmt: skip
def session_window(t):
    s = t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")
