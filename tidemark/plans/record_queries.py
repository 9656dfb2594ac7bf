"""Queries of record parsers, by role: a part's order lines are the lines of a section, what they hold says what stands on them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import patterns as P
from tidemark.operators import records as R
from tidemark.sources.tables import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]
#: A part's order lines with a number of their own, a label and two small numbers that tell what a line holds; text for both engines.
SEQ = f"CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(ORDER)}) AS BIGINT) AS seq"
FIELDS = "l_returnflag || l_linestatus || CAST(l_suppkey AS STRING) AS t, CAST(l_quantity AS BIGINT) % 8 AS q, l_suppkey % 5 AS v, l_linenumber, l_returnflag, l_discount, l_tax"
RANKED = f"r AS (SELECT l_partkey, {SEQ}, {FIELDS} FROM lineitem)"


def ranked(spark, sf_dir):
    seq = F.row_number().over(W.partitionBy("l_partkey").orderBy(*ORDER)).cast("bigint")
    return table(spark, sf_dir, "lineitem").withColumn("seq", seq).selectExpr("l_partkey", "seq", *FIELDS.split(", "))


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{T.SPACES}+|{T.SPACES}+\\z', '', 'g')"


#: (condition, cells as (x, text) with conditions of their own): what the lines of a vocabulary page hold.
WORD_LINES = [
    ("l_discount = 0.07 AND l_tax = 0.05", [("30", "'以下單字'", "true")]),
    ("l_discount = 0.03 AND l_tax = 0.02", [("30", "'■会話' || t", "true")]),
    ("q < 3", [("10", "CAST(l_linenumber AS STRING) || CASE WHEN v = 0 THEN '.す' ELSE '.' END", "true"), ("30", "'か' || t || CASE v WHEN 1 THEN '日' || t WHEN 2 THEN 'Ⅱ' ELSE '' END", "true"), ("102", "'本' || l_returnflag", "v = 3"), ("98", "'〔'", "v = 4"), ("205", "' 的' || l_returnflag", "l_linenumber <> 2")]),
    ("q = 3", [("32", "'［' || t", "true"), ("70", "'を'", "v < 2"), ("130", "'本］'", "v < 2")]),
    ("q = 4", [("200", "'g' || t", "true"), ("240", "' h '", "true")]),
    ("q = 5", [("20", "'（あ' || t || '）'", "true"), ("210", "'x'", "v > 1")]),
    ("q = 6", [("150", "'zz' || t", "v < 2"), ("10", "' '", "v >= 2")]),
]
CELLS_SQL = "CASE " + " ".join(f"WHEN {c} THEN list_filter([" + ", ".join(f"CASE WHEN {on} THEN {{'x': {x}.0::DOUBLE, 'text': {text}}} END" for x, text, on in cells) + "], lambda c: c IS NOT NULL)" for c, cells in WORD_LINES) + " ELSE [] END"
CELLS = "CASE " + " ".join(f"WHEN {c} THEN filter(array(" + ", ".join(f"CASE WHEN {on} THEN named_struct('x', {x}.0D, 'text', {text}) END" for x, text, on in cells) + "), c -> c IS NOT NULL)" for c, cells in WORD_LINES) + " ELSE CAST(array() AS array<struct<x:double,text:string>>) END"
TEXTS = "array_to_string(list_transform({}, lambda c: c.text), '')"
UNBRACKETED = "regexp_replace(regexp_replace({}, '^[［〔\\[(（]', ''), '[］〕\\])）]\\z', '')"


@query(rf"""WITH RECURSIVE {RANKED}, c AS (SELECT *, {CELLS_SQL} AS cells FROM r), s AS (SELECT *, {TEXTS.format('cells')} AS s FROM c),
f AS (SELECT l_partkey, seq, cells, s, CASE WHEN contains(s, '以下單字') THEN 2 WHEN contains(s, '■会話') THEN 1 END AS marker, TRY_CAST(nullif(regexp_extract(s, '^\s*(\d+)\.?', 1), '') AS BIGINT) AS no, len(cells) AS n,
 coalesce(abs(cells[1].x - 30) <= 16, false) AS near, regexp_matches(s, '[［〔]') AS bracket, len(list_filter(cells, lambda c: c.x < 175)) = 0 AS among, {trim('s')} = '' AS blank FROM s),
w AS (SELECT l_partkey, CAST(0 AS BIGINT) AS seq, 0 AS mode, CAST(1 AS BIGINT) AS expected, CAST(NULL AS BIGINT) AS rec, -1 AS recmode, false AS used, '' AS action FROM (SELECT DISTINCT l_partkey FROM f) UNION ALL
 SELECT l_partkey, seq, CASE WHEN action = 'mark' THEN greatest(mode, marker) ELSE mode END, CASE WHEN action = 'entry' AND mode = 0 THEN expected + 1 ELSE expected END, CASE action WHEN 'entry' THEN seq WHEN 'other' THEN NULL ELSE rec END,
  CASE WHEN action = 'entry' THEN mode ELSE recmode END, CASE action WHEN 'entry' THEN false WHEN 'usage' THEN true ELSE used END, action FROM (SELECT w.l_partkey, f.seq, mode, expected, rec, recmode, used, marker,
   CASE WHEN marker IS NOT NULL THEN 'mark' WHEN n = 0 THEN 'none' WHEN mode > 0 THEN CASE WHEN rec IS NOT NULL AND recmode = mode AND among THEN 'gloss' ELSE 'entry' END WHEN no = expected THEN 'entry'
    WHEN rec IS NOT NULL AND NOT used AND near AND bracket THEN 'usage' WHEN rec IS NOT NULL AND among THEN 'gloss' WHEN rec IS NOT NULL AND near AND NOT bracket THEN 'note' WHEN NOT blank THEN 'other' ELSE 'none' END AS action
   FROM w JOIN f ON f.l_partkey = w.l_partkey AND f.seq = w.seq + 1)),
a AS (SELECT w.l_partkey, w.seq, mode, rec, action, s, no, cells, CASE WHEN mode > 0 THEN cells ELSE list_concat(CASE WHEN {trim(r"regexp_extract(cells[1].text, '(?s)^\s*\d+\.?(.*)\z', 1)")} <> '' THEN [{{'x': cells[1].x, 'text': regexp_extract(cells[1].text, '(?s)^\s*\d+\.?(.*)\z', 1)}}] ELSE [] END, cells[2:]) END AS d
 FROM w JOIN f ON f.l_partkey = w.l_partkey AND f.seq = w.seq WHERE rec IS NOT NULL AND action IN ('entry', 'usage', 'gloss', 'note')),
p AS (SELECT *, coalesce(list_position(list_transform(d, lambda c: c.x >= 175), true) - 1, len(d)) AS z, coalesce(list_position(list_transform(d, lambda c: abs(c.x - 100) <= 5), true) - 1, len(d)) AS k0 FROM a),
e AS (SELECT *, {TEXTS.format('d[1 : least(z, k0)]')} AS kana0, {TEXTS.format('d[least(z, k0) + 1 : z]')} AS kanji0, {TEXTS.format('d[z + 1 :]')} AS zh0 FROM p),
g AS (SELECT *, CASE WHEN mode = 0 AND NOT regexp_matches(kanji0, '[^\p{{P}}\p{{Z}}]') THEN '' ELSE kanji0 END AS kanji1, CASE WHEN mode = 0 AND NOT regexp_matches(kanji0, '[^\p{{P}}\p{{Z}}]') THEN kanji0 || zh0 ELSE zh0 END AS zh1 FROM e),
h AS (SELECT *, CASE WHEN mode = 0 AND kanji1 = '' THEN length(kana0) - length(regexp_replace(kana0, '{T.IDEOGRAPH_EXTENDED}(?s:.*)', '')) ELSE 0 END AS tail FROM g),
i AS (SELECT *, CASE WHEN mode > 0 THEN kana0 || kanji1 ELSE substr(kana0, 1, length(kana0) - tail) END AS term0, CASE WHEN tail > 0 THEN substr(kana0, length(kana0) - tail + 1) ELSE kanji1 END AS kanji2 FROM h),
j AS (SELECT *, CASE WHEN contains(term0, 'Ⅱ') THEN 'II' END AS grp, {trim("replace(term0, 'Ⅱ', '')")} AS term FROM i),
u AS (SELECT l_partkey, rec, CASE WHEN len(cells) > 1 AND list_max(gaps) >= 50 THEN len(gaps) - list_position(list_reverse(gaps), list_max(gaps)) + 1 ELSE len(cells) END AS cut, cells FROM (SELECT *, list_transform(range(1, len(cells)), lambda i: cells[i + 1].x - cells[i].x) AS gaps FROM j WHERE action = 'usage')),
m AS (SELECT l_partkey, rec, {trim(f"string_agg(CASE action WHEN 'entry' THEN {trim('zh1')} WHEN 'gloss' THEN {trim('s')} WHEN 'note' THEN CASE WHEN {trim('s')} <> '' THEN ' ' || {trim('s')} ELSE '' END ELSE '' END, '' ORDER BY seq)")} AS zh FROM j GROUP BY ALL)
SELECT j.l_partkey, j.rec AS at_, ['numbered', 'conversation', 'supplementary'][mode + 1] AS category, coalesce(CASE WHEN mode = 0 THEN no END, -1) AS no, coalesce(CASE WHEN mode = 0 OR (term <> '' AND NOT regexp_matches(term, '{T.IDEOGRAPH_EXTENDED}')) THEN term END, '-') AS kana,
 coalesce(CASE WHEN mode = 0 THEN nullif({trim('kanji2')}, '') WHEN regexp_matches(term, '{T.IDEOGRAPH_EXTENDED}') THEN term END, '-') AS kanji, zh, coalesce({UNBRACKETED.format(TEXTS.format('u.cells[1 : cut]'))}, '-') AS usage_kana, coalesce(CASE WHEN cut < len(u.cells) THEN {UNBRACKETED.format(TEXTS.format('u.cells[cut + 1 :]'))} END, '-') AS usage_kanji, coalesce(grp, '-') AS grp
FROM j JOIN m ON j.l_partkey = m.l_partkey AND j.rec = m.rec LEFT JOIN u ON j.l_partkey = u.l_partkey AND j.rec = u.rec WHERE action = 'entry'""")
def parse_vocab(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("cells", F.expr(CELLS))
    out = R.vocabulary(rows, ["l_partkey"], "seq", "cells", F.lit(30.0), F.lit(100.0), F.lit(175.0))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c.split(".")[-1])
    return out.select("l_partkey", F.col("at").alias("at_"), "category", F.coalesce("no", F.lit(-1)).alias("no"), dash("kana"), dash("kanji"), "zh", F.coalesce("usage.kana", F.lit("-")).alias("usage_kana"), F.coalesce("usage.kanji", F.lit("-")).alias("usage_kanji"), F.coalesce("group", F.lit("-")).alias("grp"))


@query(rf"""WITH {RANKED}, c AS (SELECT l_partkey, seq, {CELLS_SQL} AS cells FROM r), s AS (SELECT *, {TEXTS.format('cells')} AS s FROM c)
SELECT l_partkey, seq, coalesce(abs(cells[1].x - 30) <= 16, false) AND regexp_matches(s, '[［〔]') AS usage, len(cells) > 0 AND len(list_filter(cells, lambda c: c.x < 175)) = 0 AS gloss, coalesce(abs(cells[1].x - 30) <= 16, false) AND NOT regexp_matches(s, '[［〔]') AS reading FROM s""")
def line_predicates(spark, sf_dir):
    """What a line of a vocabulary page may be by where its cells stand."""
    cells = F.col("cells")
    rows = ranked(spark, sf_dir).withColumn("cells", F.expr(CELLS))
    return rows.select("l_partkey", "seq", R.usage_line(cells, F.lit(30.0)).alias("usage"), R.gloss_line(cells, F.lit(175.0)).alias("gloss"), R.reading_line(cells, F.lit(30.0)).alias("reading"))


#: Fragments (x, text) of the lines of a grammar page: the second one only if there is text.
POINT_LINES = """CASE q WHEN 0 THEN 20.0 WHEN 1 THEN 30.0 + 3 * v WHEN 2 THEN 30.0 + 3 * v WHEN 3 THEN 40.0 WHEN 7 THEN 35.0 WHEN 5 THEN 50.0 ELSE 10.0 END AS x,
 CASE q WHEN 0 THEN CASE WHEN v = 0 THEN '１' ELSE '' END || CAST(l_linenumber AS STRING) || '． 題' || t WHEN 1 THEN '①か' || t WHEN 2 THEN ' ⑫ 我' || t WHEN 3 THEN 'の' || t WHEN 5 THEN '（' || t || '）' WHEN 6 THEN '  ' ELSE ' だ' || t END AS a,
 CASE WHEN q IN (1, 2, 3, 7) AND v < 3 THEN '的' || t || CASE WHEN v = 0 THEN 'も' ELSE ' ' END ELSE '' END AS b"""


@query(rf"""WITH RECURSIVE {RANKED}, l AS (SELECT l_partkey, seq, {POINT_LINES} FROM r), f AS (SELECT *, {trim('a || b')} AS said, regexp_replace(a, '^\s*[①-⑳]\s*', '') AS a1 FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY seq) AS n, CASE WHEN NOT regexp_matches(a1 || b, '[぀-ヿ]') THEN '' WHEN {trim('b')} <> '' AND NOT regexp_matches(b, '[぀-ヿ]') THEN a1 ELSE a1 || b END AS jp, CASE WHEN NOT regexp_matches(a1 || b, '[぀-ヿ]') THEN a1 || b WHEN {trim('b')} <> '' AND NOT regexp_matches(b, '[぀-ヿ]') THEN b ELSE '' END AS zh FROM f WHERE said <> ''),
w AS (SELECT l_partkey, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS point, CAST(NULL AS BIGINT) AS ex, CAST(NULL AS DOUBLE) AS ex_x, '' AS action FROM (SELECT DISTINCT l_partkey FROM k) UNION ALL
 SELECT l_partkey, n, CASE WHEN action = 'title' THEN seq ELSE point END, CASE action WHEN 'start' THEN seq WHEN 'more' THEN ex END, CASE action WHEN 'start' THEN x WHEN 'more' THEN ex_x END, action FROM (SELECT w.l_partkey, k.n, k.seq, k.x, point, ex, ex_x,
  CASE WHEN regexp_matches(said, '^[0-9０-９]+[.．]') THEN 'title' WHEN point IS NULL THEN 'none' WHEN regexp_matches(said, '^[①-⑳]') THEN 'start' WHEN regexp_matches(said, '^[（(]\S+[）)]\z') THEN 'body' WHEN ex IS NOT NULL AND k.x > ex_x THEN 'more' ELSE 'body' END AS action FROM w JOIN k ON k.l_partkey = w.l_partkey AND k.n = w.n + 1)),
a AS (SELECT k.*, point, ex, action FROM w JOIN k ON k.l_partkey = w.l_partkey AND k.n = w.n WHERE point IS NOT NULL),
e AS (SELECT l_partkey, point, ex, {trim("string_agg(jp, '' ORDER BY seq)")} AS jp, {trim("string_agg(zh, '' ORDER BY seq)")} AS zh FROM a WHERE action IN ('start', 'more') GROUP BY ALL),
x AS (SELECT l_partkey, point, string_agg(jp || '=' || zh, '|' ORDER BY ex) AS examples FROM e WHERE jp <> '' OR zh <> '' GROUP BY ALL),
b AS (SELECT l_partkey, point, {trim("coalesce(string_agg(a || b, '' ORDER BY seq) FILTER (WHERE action = 'body'), '')")} AS body FROM a GROUP BY ALL)
SELECT a.l_partkey, a.point AS at_, CAST(translate(regexp_extract(said, '^([0-9０-９]+)', 1), '０１２３４５６７８９', '0123456789') AS BIGINT) AS no, {trim(r"regexp_replace(said, '^[0-9０-９]+[.．]\s*', '')")} AS title, body, coalesce(examples, '') AS examples
FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.point = b.point LEFT JOIN x ON a.l_partkey = x.l_partkey AND a.point = x.point WHERE action = 'title'""")
def parse_grammar(spark, sf_dir):
    lines = ranked(spark, sf_dir).selectExpr("l_partkey", "seq", *POINT_LINES.split(",\n"))
    frags = lines.select("l_partkey", "seq", F.explode(F.expr("filter(array(struct(0L AS nth, x AS x, a AS s), struct(1L AS nth, x + 300 AS x, b AS s)), c -> c.s <> '')")).alias("c"))
    out = R.grammar(frags.select("l_partkey", "seq", "c.nth", "c.s", "c.x", F.lit(10.0).alias("size")), ["l_partkey"], "seq", "nth", "s", "x", "size")
    examples = F.array_join(F.transform("examples", lambda e: F.concat(e["jp"], F.lit("="), e["zh"])), "|")
    return out.select("l_partkey", F.col("at").alias("at_"), "no", "title", "body", examples.alias("examples"))


def cells_sql(lines: list, otherwise: str = "[]") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN list_filter([" + ", ".join(f"CASE WHEN {on} THEN {{'x': ({x})::DOUBLE, 'text': {text}}} END" for x, text, on in cells) + "], lambda c: c IS NOT NULL)" for c, cells in lines) + f" ELSE {otherwise} END"


def cells_expr(lines: list) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN filter(array(" + ", ".join(f"CASE WHEN {on} THEN named_struct('x', CAST({x} AS DOUBLE), 'text', {text}) END" for x, text, on in cells) + "), c -> c IS NOT NULL)" for c, cells in lines) + " ELSE CAST(array() AS array<struct<x:double,text:string>>) END"


#: What the lines of a substitution table print, the first line, the base, aside.
BASE = [("0", "CAST(v + 1 AS STRING) || '.'", "true"), ("16", "'あ' || t", "true"), ("80", "'を'", "true"), ("140", "'い' || l_returnflag", "true"), ("200", "'。'", "l_linenumber < 6")]
PATTERN_LINES = [
    ("q < 2", [("16 + v", "'か' || t", "true"), ("30 + v", "'け'", "v = 1")]),
    ("q = 2", [("20", "'き' || t", "true"), ("150", "'く' || CAST(v AS STRING)", "true")]),
    ("q = 3", [("141", "'け' || t || ' →'", "true")]),
    ("q = 4", [("18", "'こ'", "v > 0"), ("60 + v * 6", "'さ ' || CAST(v AS STRING)", "true"), ("205", "'。'", "true")]),
    ("q = 5 AND v = 0", [("16", "'だれ…'", "true"), ("150", "'…か。'", "true")]),
    ("q = 5 AND v = 1", [("90", "'なに ' || t", "true"), ("140", "'どこ……か'", "true")]),
    ("q = 5", [("16", "'→ し' || t", "true"), ("150", "'→'", "v = 2")]),
    ("q = 6 AND l_discount = 0.1", [("16", "' …い' || t", "true")]),
    ("q = 6", [("80", "'に' || CAST(v AS STRING)", "true"), ("170 + v * 5", "'た' || CAST(v AS STRING)", "true")]),
]
HEADER = [("0", "CAST(v + 1 AS STRING) || '.'", "true"), ("20", "'ます形'", "true"), ("100", "'て'", "true"), ("108", "'形'", "true"), ("200", "'ます 形'", "true"), ("280", "'て形'", "l_linenumber < 6")]
REFERENCE_LINES = [
    ("q < 3", [("12", "'Ⅰ'", "v < 2"), ("22", "'か' || t", "true"), ("40", "'ます'", "true"), ("82 + v * 2", "'＊かっ'", "true"), ("110", "'て'", "v > 0"), ("201", "'ね ' || CAST(v AS STRING)", "v < 4"), ("258 + v", "'ねて'", "true")]),
    ("q = 3", [("201", "'ね' || t", "true"), ("281", "'ねて'", "true")]),
    ("q = 4", [("22", "'か' || t", "true")]),
    ("q = 5", [("22", "'い'", "true"), ("101", "'いて'", "true"), ("200", "'ます形'", "true"), ("280", "'て 形'", "true")]),
]
FORMS = [("0", "CAST(v + 1 AS STRING) || '.'", "true"), ("16", "'たべ'", "true"), ("30", "'ます'", "true"), ("60", "'たべ'", "true"), ("90", "'ましょう'", "l_linenumber < 9")]
FORM_LINES = [
    ("q < 3", [("16", "'のみ' || CAST(v AS STRING)", "true"), ("30", "'ます →'", "true"), ("60", "'のみ' || CAST(v AS STRING)", "true"), ("90", "'ましょう'", "true")]),
    ("q = 3", [("16", "'い'", "true"), ("20", "'い'", "true"), ("40", "'です'", "true"), ("60", "'よく'", "v < 3"), ("90", "'ない'", "true"), ("99", "'です'", "true")]),
    ("q = 4", [("16", "'…か'", "true"), ("30", "'あ'", "true")]),
    ("q = 5", [("16", "'と'", "true"), ("30", "'あ'", "true"), ("60", "'と'", "true"), ("90", "'い'", "true")]),
]


def collapsed(x: str) -> str:
    return trim(f"regexp_replace({x}, '{T.SPACES}+', ' ', 'g')")


def column_sql(x: str, xs: str, share: float = 0.2) -> str:
    return f"coalesce(list_max(list_filter(range(0, len({xs})), lambda i: {x} >= {xs}[i + 1] - {share} * CASE WHEN i = 0 THEN 0 ELSE {xs}[i + 1] - {xs}[i] END)), 0)"


def cleaned_sql(segs: str) -> str:
    return "list_filter(list_transform(" + segs + ", lambda s: {'x': s.x, 'text': " + trim("replace(s.text, '→', '')") + "}), lambda s: s.text <> '')"


def fill_sql(n: int, columns: int) -> str:
    """CTEs f1, f2 ... that fill the slot in each column from the left."""
    out = ""
    for m in range(1, columns):
        out += f""", g{m} AS (SELECT *, list_max(list_filter(range(0, {m}), lambda j: st[j + 1].printed AND len(st[j + 1].segs) > 0)) AS src FROM f{m - 1}),
h{m} AS (SELECT *, coalesce(list_contains(slots, {m}) AND len(st[{m + 1}].segs) = 0 AND abs(st[src + 1].segs[-1].x - st[{m + 1}].mean) < abs(st[src + 1].segs[-1].x - st[src + 1].mean), false) AS moves FROM g{m}),
f{m} AS (SELECT tab, seq, texts, slots, CASE WHEN moves THEN list_transform(st, lambda c, i: CASE WHEN i = {m + 1} THEN {{'mean': c.mean, 'printed': c.printed, 'segs': [st[src + 1].segs[-1]]}} WHEN i = src + 1 THEN {{'mean': c.mean, 'printed': c.printed, 'segs': c.segs[1 : len(c.segs) - 1]}} ELSE c END) ELSE st END AS st FROM h{m})"""
    return out


def cell_text(x: str) -> str:
    return collapsed(f"array_to_string(list_transform({x}, lambda s: s.text), ' ')")


def substitution_sql(source: str) -> str:
    """CTEs over source (tab, seq, raw, segs), the last of which is sub (tab, template, slots, rows, question), all as texts."""
    return rf"""n AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY seq) - 1 AS nth FROM {source}),
b0 AS (SELECT tab, list_transform(segs[2:], lambda s: s.x) AS xs, list_transform(segs[2:], lambda s: s.text) AS texts FROM n WHERE nth = 0),
l0 AS (SELECT n.tab, seq, raw, segs, xs, texts, regexp_matches(raw, '…+か。?\s*\z') AS q FROM n JOIN b0 ON n.tab = b0.tab WHERE nth > 0 AND len(segs) > 0),
l1 AS (SELECT * FROM (SELECT *, bool_or(NOT q AND regexp_matches(raw, '^\s*…+')) OVER (PARTITION BY tab ORDER BY seq) AS past FROM l0) WHERE NOT past),
q0 AS (SELECT tab, xs, generate_subscripts(segs, 1) AS i, unnest(segs) AS s FROM (SELECT * FROM l1 WHERE q QUALIFY row_number() OVER (PARTITION BY tab ORDER BY seq DESC) = 1)),
q1 AS (SELECT tab, i, {column_sql('s.x', 'xs')} AS c, regexp_matches(s.text, '…+か。?\s*\z') AS asked, {trim(r"regexp_replace(s.text, CASE WHEN regexp_matches(s.text, '…+か。?\s*\z') THEN '…+か。?\s*\z' ELSE '…+\z' END, '')")} AS said FROM q0),
q2 AS (SELECT tab, c, {collapsed("string_agg(said, ' ' ORDER BY i) FILTER (WHERE said <> '')")} AS v FROM q1 GROUP BY ALL),
q3 AS (SELECT tab, map_from_entries(list({{'k': c, 'v': v}}) FILTER (WHERE v <> '')) AS v FROM q2 GROUP BY tab), q4 AS (SELECT tab, arg_max(c, i) FILTER (WHERE asked) AS st FROM q1 GROUP BY tab),
t0 AS (SELECT tab, seq, xs, texts, list_transform({cleaned_sql('segs')}, lambda s: {{'c': {column_sql('s.x', 'xs')}, 's': s}}) AS p FROM l1 WHERE NOT q),
t1 AS (SELECT tab, seq, xs, texts, unnest(range(0, greatest(len(xs), 1))) AS c, p FROM t0), t2 AS (SELECT tab, seq, xs, texts, c, list_transform(list_filter(p, lambda e: e.c = t1.c), lambda e: e.s) AS segs FROM t1),
s0 AS (SELECT tab, list_sort(list(DISTINCT c)) AS slots FROM t2 WHERE len(segs) > 0 AND {cell_text('segs')} IS DISTINCT FROM texts[c + 1] GROUP BY tab),
b AS (SELECT b0.tab, xs, texts, coalesce(slots, CASE WHEN len(texts) > 0 THEN [0] ELSE [] END) AS slots FROM b0 LEFT JOIN s0 ON b0.tab = s0.tab),
m0 AS (SELECT *, coalesce(list_sum(list_transform(segs, lambda s: s.x)), 0) AS sm, len(segs) AS k FROM t2),
m1 AS (SELECT tab, seq, c, segs, k > 0 AS printed, (xs[c + 1] + sum(sm) OVER w - sm) / (1 + sum(k) OVER w - k) AS mean FROM m0 WINDOW w AS (PARTITION BY tab, c)),
f0 AS (SELECT m1.tab, seq, any_value(texts) AS texts, any_value(slots) AS slots, list({{'mean': mean, 'printed': printed, 'segs': segs}} ORDER BY c) AS st FROM m1 JOIN b ON m1.tab = b.tab GROUP BY m1.tab, seq){fill_sql(0, 4)},
e0 AS (SELECT tab, seq, texts, st, unnest(slots) AS m FROM f3 WHERE len(list_filter(slots, lambda m: len(st[m + 1].segs) > 0)) > 0),
e1 AS (SELECT tab, seq, m, texts[m + 1] AS own, CASE WHEN len(st[m + 1].segs) > 0 THEN {cell_text('st[m + 1].segs')} END AS text FROM e0),
e2 AS (SELECT *, text IS NOT NULL OR (own <> '' AND count(*) FILTER (WHERE text IS NULL) OVER w = 1) AS fresh FROM e1 WINDOW w AS (PARTITION BY tab, m ORDER BY seq)),
e3 AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY tab, m ORDER BY seq) AS k FROM e2),
e4 AS (SELECT *, CASE WHEN text IS NOT NULL THEN k WHEN own = '' THEN 0 ELSE min(k) FILTER (WHERE text IS NULL) OVER (PARTITION BY tab, m ORDER BY seq) END AS place FROM e3),
r0 AS (SELECT tab, string_agg(ps, ';' ORDER BY seq) AS rows FROM (SELECT tab, seq, string_agg(place, ',' ORDER BY m) AS ps FROM e4 GROUP BY ALL) GROUP BY tab),
k0 AS (SELECT tab, map_from_entries(list({{'k': m, 'v': found}})) AS found FROM (SELECT tab, m, list(coalesce(text, '') ORDER BY seq) FILTER (WHERE fresh) AS found FROM e4 GROUP BY ALL) GROUP BY tab),
sub AS (SELECT b.tab, array_to_string(list_transform(texts, lambda t, i: CASE WHEN list_contains(slots, i - 1) THEN '{{' || 'STUVWXYZ'[list_position(slots, i - 1)] || '}}' ELSE t END), '') AS template,
 array_to_string(list_transform(slots, lambda m, i: 'STUVWXYZ'[i] || '=' || array_to_string(list_concat([texts[m + 1]], coalesce(found[m], [])), '/')), '|') AS slots, array_to_string(list_transform(slots, lambda m: '0'), ',') || coalesce(';' || rows, '') AS rows,
 coalesce(CASE WHEN st IS NOT NULL THEN array_to_string(list_transform(range(0, st), lambda i: coalesce(v[i], CASE WHEN list_contains(slots, i) AND coalesce(list_min(list_filter(map_keys(v), lambda k: k < st)) < i, false) THEN '' ELSE texts[i + 1] END)), '')
 || regexp_replace(coalesce(v[st], texts[st + 1]) || array_to_string(texts[st + 2:], ''), '。\z', '') || 'か。' END, '-') AS question
 FROM b LEFT JOIN r0 ON b.tab = r0.tab LEFT JOIN k0 ON b.tab = k0.tab LEFT JOIN q3 ON b.tab = q3.tab LEFT JOIN q4 ON b.tab = q4.tab)"""


def reference_sql(source: str) -> str:
    """CTEs over source (tab, seq, segs), the last of which is ref (tab, forms)."""
    half = lambda c: f"array_to_string(list_transform(list_filter(p, lambda e: e.c = {c}), lambda e: e.t), '')"
    return rf"""hd AS (SELECT tab, min(seq) AS first, arg_min(segs[2:], seq) AS h FROM {source} GROUP BY tab),
hs AS (SELECT tab, first, len(h) AS n, generate_subscripts(h, 1) AS i, unnest(h).x AS x, replace(unnest(h).text, ' ', '') AS one, replace(unnest(h).text, ' ', '') || replace(unnest(list_concat(h[2:], [{{'x': 0.0::DOUBLE, 'text': NULL}}])).text, ' ', '') AS two FROM hd),
hw(tab, i, xs) AS (SELECT tab, 1, CAST([] AS DOUBLE[]) FROM hd UNION ALL SELECT hw.tab, hw.i + CASE WHEN len(xs) < 4 AND one NOT IN ('ます形', 'て形') AND coalesce(two IN ('ます形', 'て形'), false) THEN 2 ELSE 1 END,
 CASE WHEN len(xs) < 4 AND (one IN ('ます形', 'て形') OR coalesce(two IN ('ます形', 'て形'), false)) THEN list_append(xs, x) ELSE xs END FROM hw JOIN hs ON hw.tab = hs.tab AND hw.i = hs.i),
hx AS (SELECT hd.tab, first, arg_max(xs, i) AS xs FROM hd JOIN hw ON hd.tab = hw.tab GROUP BY ALL),
fp AS (SELECT s.tab, seq, list_transform(list_filter(segs, lambda s: s.text NOT IN ('Ⅰ', 'Ⅱ', 'Ⅲ')), lambda s: {{'c': {column_sql('s.x', 'xs', 0.25)}, 't': replace(s.text, ' ', '')}}) AS p FROM {source} s JOIN hx ON s.tab = hx.tab WHERE seq > first AND len(xs) = 4),
fq AS (SELECT tab, seq, 0 AS side, {half(0)} AS a, {half(1)} AS b FROM fp UNION ALL SELECT tab, seq, 1, {half(2)}, {half(3)} FROM fp),
fr AS (SELECT tab, string_agg(a || '/' || b, '|' ORDER BY seq, side) AS forms FROM fq WHERE a <> '' AND b <> '' AND NOT (a = 'ます形' AND b = 'て形') GROUP BY tab),
ref AS (SELECT hd.tab, coalesce(forms, '') AS forms FROM hd LEFT JOIN fr ON hd.tab = fr.tab)"""


def marker_sql(texts: str) -> str:
    return f"list_filter(list_transform(range(1, len({texts}) + 1), lambda i: CASE WHEN i - list_max(list_filter(range(1, i), lambda j: {texts}[j] = {texts}[i])) >= 2 AND {texts}[i] NOT IN {P.PARTICLES} THEN {texts}[i] END), lambda e: e IS NOT NULL)[1]"


def forms_sql(source: str) -> str:
    """CTEs over source (tab, seq, raw, segs), the last of which is con (tab, forms)."""
    return rf"""cn AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY seq) - 1 AS nth FROM {source}),
cx AS (SELECT tab, seq, x, {marker_sql('x')} AS mk FROM (SELECT tab, seq, list_transform(CASE WHEN nth = 0 THEN segs[2:] ELSE {cleaned_sql('segs')} END, lambda s: s.text) AS x FROM cn WHERE nth = 0 OR NOT regexp_matches(raw, '…+か。?\s*\z|^\s*…+')) WHERE len(x) > 0),
cs AS (SELECT *, CASE WHEN mk IS NOT NULL THEN list_concat([0], list_filter(range(1, len(x)), lambda i: x[i + 1] = mk)) END AS st FROM cx),
cv AS (SELECT tab, len(x) AS n, st, count(*) AS c, min(seq) AS f FROM cs WHERE st IS NOT NULL GROUP BY ALL), cb AS (SELECT tab, n, st FROM cv QUALIFY row_number() OVER (PARTITION BY tab, n ORDER BY c DESC, f) = 1),
cf AS (SELECT cs.tab, seq, array_to_string(list_transform(range(1, len(cb.st) + 1), lambda k: array_to_string(x[cb.st[k] + 1 : coalesce(cb.st[k + 1], n)], '')), '/') AS f FROM cs JOIN cb ON cs.tab = cb.tab AND len(x) = n),
con AS (SELECT s.tab, coalesce(string_agg(f, '|' ORDER BY cf.seq), '') AS forms FROM (SELECT DISTINCT tab FROM {source}) s LEFT JOIN cf ON s.tab = cf.tab GROUP BY s.tab)"""


def shown(out):
    """A table's parts as texts."""
    candidates = F.array_join(F.transform(F.array_sort(F.map_entries("slots")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/"))), "|")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda i: i.cast("string")), ",")), ";")
    return out.withColumns({"slots": candidates, "rows": rows, "question": F.coalesce("question", F.lit("-"))})


def joined_forms():
    return F.array_join(F.transform("forms", lambda f: F.array_join(f, "/")), "|")


def pattern_lines(spark, sf_dir, lines):
    return ranked(spark, sf_dir).withColumn("segs", F.expr(cells_expr(lines))).withColumn("raw", F.array_join("segs.text", ""))


ONE_TABLE = [("seq = 1", BASE), *PATTERN_LINES]


@query(f"""WITH {RANKED}, ln AS (SELECT l_partkey AS tab, seq, segs, {TEXTS.format('segs')} AS raw FROM (SELECT *, {cells_sql(ONE_TABLE)} AS segs FROM r)), {substitution_sql('ln')} SELECT tab AS l_partkey, template, slots, rows, question FROM sub""")
def parse_substitution(spark, sf_dir):
    return shown(P.substitution(pattern_lines(spark, sf_dir, ONE_TABLE), ["l_partkey"], "seq", "raw", "segs"))


ONE_REFERENCE = [("seq = 1", HEADER), *REFERENCE_LINES]


@query(f"""WITH RECURSIVE {RANKED}, ln AS (SELECT l_partkey AS tab, seq, {cells_sql(ONE_REFERENCE)} AS segs FROM r), {reference_sql('ln')} SELECT tab AS l_partkey, forms FROM ref""")
def parse_reference_table(spark, sf_dir):
    return P.reference_table(pattern_lines(spark, sf_dir, ONE_REFERENCE), ["l_partkey"], "seq", "segs").withColumn("forms", joined_forms())


#: A section's tables begin where the line number is 1; what the first line holds is a header, forms or a base.
ODD = "l_partkey % 3 = 0"
MANY_TABLES = [("l_linenumber = 1 AND v = 4 AND l_partkey % 2 = 0", HEADER), ("l_linenumber = 1 AND q % 2 = 0", FORMS), ("l_linenumber = 1", BASE), *[(f"{ODD} AND {c}", x) for c, x in FORM_LINES], *[(f"l_partkey % 3 = 1 AND {c}", x) for c, x in REFERENCE_LINES], *PATTERN_LINES]


@query(rf"""WITH RECURSIVE {RANKED}, l AS (SELECT l_partkey, seq, segs, {TEXTS.format('segs')} AS raw FROM (SELECT *, {cells_sql(MANY_TABLES)} AS segs FROM r)),
o AS (SELECT *, max(CASE WHEN regexp_matches(raw, '^\s*\d+\.') THEN seq END) OVER (PARTITION BY l_partkey ORDER BY seq) AS at_ FROM l),
v AS (SELECT *, l_partkey * 100000 + at_ AS tab, first_value(segs) OVER w AS base, CAST(regexp_extract(first_value(raw) OVER w, '^\s*(\d+)\.', 1) AS BIGINT) AS no FROM o WHERE at_ IS NOT NULL WINDOW w AS (PARTITION BY l_partkey, at_ ORDER BY seq)),
x AS (SELECT *, list_transform(base[2:], lambda s: s.text) AS bt FROM v),
y AS (SELECT *, CASE WHEN l_partkey % 2 = 0 AND no = 5 THEN 'reference' WHEN {marker_sql('bt')} IS NOT NULL THEN 'conjugation' ELSE 'substitution' END AS kind FROM x),
za AS (SELECT * FROM y WHERE kind = 'substitution'), zb AS (SELECT * FROM y WHERE kind = 'reference'), zc AS (SELECT * FROM y WHERE kind = 'conjugation'), {substitution_sql('za')}, {reference_sql('zb')}, {forms_sql('zc')}
SELECT DISTINCT y.l_partkey, y.at_, y.no AS table_no, y.kind, coalesce(template, '-') AS template, coalesce(sub.slots, '-') AS slots, coalesce(sub.rows, '-') AS rows, coalesce(question, '-') AS question, coalesce(ref.forms, con.forms, '-') AS forms
FROM y LEFT JOIN sub ON y.tab = sub.tab LEFT JOIN ref ON y.tab = ref.tab LEFT JOIN con ON y.tab = con.tab""")
def parse_pattern_tables(spark, sf_dir):
    lines = pattern_lines(spark, sf_dir, MANY_TABLES)
    out = shown(P.pattern_tables(lines, ["l_partkey"], "seq", "raw", "segs", F.expr("l_partkey % 2 = 0 AND table_no = 5"))).withColumn("forms", joined_forms())
    dash = [F.coalesce(c, F.lit("-")).alias(c) for c in ("template", "slots", "rows", "question", "forms")]
    return out.select("l_partkey", F.col("at").alias("at_"), "table_no", "kind", *dash)
