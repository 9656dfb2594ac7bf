"""Queries of lines and rows of printed tables, by role: orders are lines of fragments (order lines), parts are tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import tables as O
from tidemark.sources.tables import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq FROM lineitem)"


def ranked(spark, sf_dir):
    """Order lines with a number of their own in the order, since line numbers repeat."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))


@query(f"""WITH RECURSIVE {RANKED}, f AS (SELECT l_orderkey, seq::DOUBLE AS seq, l_returnflag || l_linestatus || l_partkey AS s, l_quantity AS x, l_quantity + 1.5 * length(l_returnflag || l_linestatus || l_partkey) AS fin FROM r),
h AS (SELECT f.l_orderkey, f.seq, arg_min(h.seq, (h.fin - h.x, h.seq)) AS host FROM f JOIN f h ON f.l_orderkey = h.l_orderkey AND h.x < f.x AND f.x < h.fin GROUP BY 1, 2),
g AS (SELECT f.*, host FROM f LEFT JOIN h ON f.l_orderkey = h.l_orderkey AND f.seq = h.seq),
t(l_orderkey, seq, s, x, path) AS (SELECT l_orderkey, seq, s, x, [0.0, 0.0, x, seq] FROM g WHERE host IS NULL UNION ALL
 SELECT g.l_orderkey, g.seq, g.s, g.x, list_concat(t.path, [least(ceil((g.x - t.x) / 1.5), length(t.s)), 0.0, g.x, g.seq]) FROM g JOIN t ON g.l_orderkey = t.l_orderkey AND g.host = t.seq),
c AS (SELECT l_orderkey, list_concat(path, [i - 1.0, 1.0, 0.0, 0.0]) AS path, s[i] AS ch FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t))
SELECT l_orderkey, string_agg(ch, '' ORDER BY path) AS text FROM c GROUP BY 1""")
def line_text(spark, sf_dir):
    rows = ranked(spark, sf_dir).select("l_orderkey", "seq", F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("s"), F.col("l_quantity").alias("x"), F.lit(3.0).alias("size"))
    return O.line_text(rows, ["l_orderkey"], "seq", "s", "x", "size")


@query(f"""WITH f AS (SELECT conv_id, turn, replace(text, 'e ', '  ') AS s, 5.0 * coalesce(sum(length(replace(text, 'e ', '  '))) OVER w, 0) + coalesce(sum(turn % 3 * 4.0) OVER w, 0) AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT conv_id, turn, i, s[i] AS ch, x + 5.0 * (i - 1) AS cx, i = 1 AND turn > 0 AND (turn - 1) % 3 = 2 AS far FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM f)),
b AS (SELECT *, regexp_matches(ch, '{T.SPACES}') AS bl FROM c), d AS (SELECT *, bl AND (coalesce(lag(bl) OVER o, false) OR coalesce(lead(bl) OVER o, false)) AS wide FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i)),
e AS (SELECT *, CASE WHEN far OR wide <> coalesce(lag(wide) OVER o, wide) THEN 1 ELSE 0 END AS st FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i)),
g AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS UNBOUNDED PRECEDING) AS grp FROM e),
p AS (SELECT conv_id, grp, regexp_replace(string_agg(ch, '' ORDER BY turn, i), '^{T.SPACES}+|{T.SPACES}+\\z', '', 'g') AS text, arg_min(cx, (turn, i)) AS x FROM g GROUP BY 1, 2)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY grp) - 1 AS k, round(x, 3) AS x, text FROM p WHERE text <> ''""")
def fine_segments(spark, sf_dir):
    """Turns are fragments of a conversation; after every third one is a gap of 8, else of 4 or none."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit("e "), F.lit("  ")).alias("s"))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    x = F.coalesce(F.sum(F.length("s") * 5.0 + F.col("turn") % 3 * 4.0).over(before), F.lit(0.0))
    return O.fine_segments(c.withColumns({"x": x, "size": F.lit(10.0)}), ["conv_id"], "turn", "s", "x", "size").withColumn("x", F.round("x", 3))


@query(f"""WITH {RANKED}, f AS (SELECT l_orderkey, seq, CASE WHEN seq = 1 AND l_orderkey % 4 = 0 THEN ' ①' WHEN seq = 1 AND l_orderkey % 4 = 1 THEN '② の' WHEN l_quantity > 30 THEN '的' || l_partkey WHEN l_quantity < 3 THEN ' ' ELSE 'か' || l_partkey || l_returnflag END AS s, l_orderkey % 2 = 0 AS zh FROM r),
n AS (SELECT l_orderkey, seq, CASE WHEN zh AND l_orderkey % 6 = 0 THEN replace(replace(s, 'か', '我'), 'の', '我') ELSE s END AS s FROM f), q AS (SELECT n.*, seq * 100.0 + l_quantity AS x FROM n JOIN r USING (l_orderkey, seq)),
k AS (SELECT *, x + list_sum(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 256 THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END)) AS fin, min(CASE WHEN trim(s) <> '' THEN seq END) OVER (PARTITION BY l_orderkey) AS first FROM q),
m AS (SELECT *, bool_or(seq = first AND regexp_matches(trim(s), '^[①-⑳]')) OVER (PARTITION BY l_orderkey) AS marked, lead(x) OVER (PARTITION BY l_orderkey ORDER BY seq) - fin AS gap FROM k),
t AS (SELECT *, CASE WHEN marked AND seq < first THEN '' WHEN marked AND seq = first THEN ltrim(regexp_replace(ltrim(s), '^[①-⑳]', '')) ELSE s END AS u FROM m),
a AS (SELECT l_orderkey, string_agg(u, '' ORDER BY seq) AS whole, arg_max(seq, (gap, -seq)) FILTER (WHERE gap IS NOT NULL) AS cut FROM t GROUP BY 1),
b AS (SELECT t.l_orderkey, any_value(whole) AS whole, coalesce(string_agg(u, '' ORDER BY seq) FILTER (WHERE seq <= cut), '') AS l, coalesce(string_agg(u, '' ORDER BY seq) FILTER (WHERE seq > cut), '') AS r FROM t JOIN a ON t.l_orderkey = a.l_orderkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN NOT regexp_matches(whole, '[぀-ヿ]') THEN '' WHEN trim(r) <> '' AND NOT regexp_matches(r, '[぀-ヿ]') THEN l ELSE whole END AS jp, CASE WHEN NOT regexp_matches(whole, '[぀-ヿ]') THEN whole WHEN trim(r) <> '' AND NOT regexp_matches(r, '[぀-ヿ]') THEN r ELSE '' END AS zh FROM b""")
def split_example_line(spark, sf_dir):
    k, first = F.col("l_orderkey"), F.col("seq") == 1
    s = F.when(first & (k % 4 == 0), " ①").when(first & (k % 4 == 1), "② の").when(F.col("l_quantity") > 30, F.concat(F.lit("的"), "l_partkey")).when(F.col("l_quantity") < 3, " ").otherwise(F.concat(F.lit("か"), "l_partkey", "l_returnflag"))
    s = F.when(k % 6 == 0, F.translate(s, "かの", "我我")).otherwise(s)
    rows = ranked(spark, sf_dir).select("l_orderkey", "seq", s.alias("s"), (F.col("seq") * 100.0 + F.col("l_quantity")).alias("x"), F.lit(10.0).alias("size"))
    return O.split_example_line(rows, ["l_orderkey"], "seq", "s", "x", "size", True)


@query("""WITH c AS (SELECT l_partkey, l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_linenumber % 4 = 1 THEN [] WHEN l_tax > 0.04 THEN [{'x': l_discount * 100, 'text': 'a' || l_returnflag}, {'x': l_tax * 2000, 'text': 'b' || l_linestatus}] ELSE [{'x': l_discount * 1200, 'text': 'a' || l_returnflag}] END AS s0,
 CASE WHEN l_quantity % 2 = 0 THEN [{'x': 100 + l_discount * 500, 'text': 'c'}] ELSE [] END AS s1, CASE WHEN l_suppkey % 3 = 0 THEN [{'x': 160 + l_tax * 500, 'text': 'd'}, {'x': 200 + l_tax * 500, 'text': 'e'}] ELSE [] END AS s2 FROM (SELECT DISTINCT ON (l_partkey, l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice)),
k AS (SELECT *, coalesce(list_sum(list_transform(s0, lambda s: s.x)), 0) AS a0, coalesce(list_sum(list_transform(s1, lambda s: s.x)), 0) AS a1, coalesce(list_sum(list_transform(s2, lambda s: s.x)), 0) AS a2 FROM c),
m AS (SELECT *, (10.0 + sum(a0) OVER w - a0) / (1 + sum(len(s0)) OVER w - len(s0)) AS m0, (100.0 + sum(a1) OVER w - a1) / (1 + sum(len(s1)) OVER w - len(s1)) AS m1, (180.0 + sum(a2) OVER w - a2) / (1 + sum(len(s2)) OVER w - len(s2)) AS m2 FROM k WINDOW w AS (PARTITION BY l_partkey)),
o AS (SELECT *, len(s1) = 0 AND len(s0) > 0 AND abs(s0[-1].x - m1) < abs(s0[-1].x - m0) AS mv FROM m), p AS (SELECT * REPLACE (CASE WHEN mv THEN [s0[-1]] ELSE s1 END AS s1, CASE WHEN mv THEN s0[:len(s0) - 1] ELSE s0 END AS s0) FROM o),
q AS (SELECT *, CASE WHEN len(s2) > 0 THEN 0 WHEN len(s1) > 0 AND NOT mv THEN CASE WHEN abs(s1[-1].x - m2) < abs(s1[-1].x - m1) THEN 2 ELSE 0 END WHEN len(s0) > 0 THEN CASE WHEN abs(s0[-1].x - m2) < abs(s0[-1].x - m0) THEN 1 ELSE 0 END ELSE 0 END AS f FROM p),
z AS (SELECT l_partkey, id, CASE WHEN f = 1 THEN s0[:len(s0) - 1] ELSE s0 END AS s0, CASE WHEN f = 2 THEN s1[:len(s1) - 1] ELSE s1 END AS s1, CASE f WHEN 1 THEN [s0[-1]] WHEN 2 THEN [s1[-1]] ELSE s2 END AS s2 FROM q)
SELECT l_partkey, id, array_to_string(list_transform(s0, lambda s: s.text), '+') || '|' || array_to_string(list_transform(s1, lambda s: s.text), '+') || '|' || array_to_string(list_transform(s2, lambda s: s.text), '+') AS cells FROM z""")
def slot_redistribute(spark, sf_dir):
    """Tables are parts, rows their order lines; three columns, the second and third are slots."""
    lines = table(spark, sf_dir, "lineitem")
    first = W.partitionBy("l_partkey", "l_orderkey", "l_linenumber").orderBy("l_quantity", "l_suppkey", "l_extendedprice")
    lines = lines.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    at = lambda x, text: F.struct(x.cast("double").alias("x"), text.alias("text"))
    none, d, t = F.array().cast("array<struct<x:double,text:string>>"), F.col("l_discount"), F.col("l_tax")
    one = F.concat(F.lit("a"), "l_returnflag")
    s0 = F.when(F.col("l_linenumber") % 4 == 1, none).when(t > 0.04, F.array(at(d * 100, one), at(t * 2000, F.concat(F.lit("b"), "l_linestatus")))).otherwise(F.array(at(d * 1200, one)))
    s1 = F.when(F.col("l_quantity") % 2 == 0, F.array(at(100 + d * 500, F.lit("c")))).otherwise(none)
    s2 = F.when(F.col("l_suppkey") % 3 == 0, F.array(at(160 + t * 500, F.lit("d")), at(200 + t * 500, F.lit("e")))).otherwise(none)
    rows = lines.select("l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.array(s0, s1, s2).alias("cells"))
    out = O.redistribute_slots(rows, ["l_partkey"], "id", "cells", F.array(F.lit(10.0), F.lit(100.0), F.lit(180.0)), F.array(F.lit(1), F.lit(2)))
    return out.withColumn("cells", F.array_join(F.transform("cells", lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "+")), "|"))


@query("""WITH p AS (SELECT p_partkey, ['本屋は', p_brand, p_type, 'に', 'あります', CASE WHEN p_size % 2 = 0 THEN '。' ELSE '' END] AS b, CASE WHEN p_size % 5 < 4 THEN CAST(p_size % 5 + 1 AS INTEGER) END AS st,
 CASE p_size % 3 WHEN 0 THEN MAP {1: 'どこ'} WHEN 1 THEN MAP {2: 'だれ'} ELSE MAP {0: 'なに', 3: 'へ'} END AS v FROM part)
SELECT p_partkey, CASE WHEN st IS NOT NULL THEN array_to_string(list_transform(range(0, st), lambda i: coalesce(v[i::INTEGER], CASE WHEN i IN (1, 2) AND coalesce(list_min(list_filter(map_keys(v), lambda k: k < st)) < i, false) THEN '' ELSE b[i + 1] END)), '')
 || regexp_replace(coalesce(v[st], b[st + 1]) || array_to_string(b[st + 2:], ''), '。\\z', '') || 'か。' END AS question FROM p""".replace("\\\\", "\\"))
def reconstruct_question(spark, sf_dir):
    size = F.col("p_size")
    base = F.array(F.lit("本屋は"), F.col("p_brand"), F.col("p_type"), F.lit("に"), F.lit("あります"), F.when(size % 2 == 0, "。").otherwise(""))
    values = F.when(size % 3 == 0, F.create_map(F.lit(1), F.lit("どこ"))).when(size % 3 == 1, F.create_map(F.lit(2), F.lit("だれ"))).otherwise(F.create_map(F.lit(0), F.lit("なに"), F.lit(3), F.lit("へ")))
    start = F.when(size % 5 < 4, (size % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", O.reconstruct_question(base, values, start, F.array(F.lit(1), F.lit(2))).alias("question"))


@query(f"""WITH {RANKED}, t AS (SELECT l_orderkey // 50 AS tab, l_orderkey, list(l_returnflag || l_linestatus ORDER BY seq) AS x FROM r GROUP BY ALL),
m AS (SELECT *, list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i - list_max(list_filter(range(1, i), lambda j: x[j] = x[i])) >= 2 THEN x[i] END), lambda e: e IS NOT NULL)[1] AS mk FROM t),
s AS (SELECT *, CASE WHEN mk IS NOT NULL THEN list_concat([0], list_filter(range(1, len(x)), lambda i: x[i + 1] = mk)) END AS st FROM m),
v AS (SELECT tab, len(x) AS n, st, count(*) AS c, min(l_orderkey) AS f FROM s WHERE st IS NOT NULL GROUP BY ALL), b AS (SELECT tab, n, st FROM (SELECT *, row_number() OVER (PARTITION BY tab, n ORDER BY c DESC, f) AS k FROM v) WHERE k = 1)
SELECT s.tab, s.l_orderkey, array_to_string(list_transform(range(1, len(b.st) + 1), lambda k: array_to_string(x[b.st[k] + 1 : coalesce(b.st[k + 1], n)], '')), '|') AS forms FROM s JOIN b ON s.tab = b.tab AND len(x) = b.n""")
def parse_conjugation(spark, sf_dir):
    """Tables are fifty orders each, rows an order's lines."""
    rows = ranked(spark, sf_dir).groupBy(F.floor(F.col("l_orderkey") / 50).cast("bigint").alias("tab"), "l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat("l_returnflag", "l_linestatus").alias("s")))), lambda r: r["s"]).alias("x"))
    return O.conjugation_forms(rows, ["tab"], "l_orderkey", "x").withColumn("forms", F.array_join("forms", "|"))
