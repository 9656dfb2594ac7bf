"""Queries of order-dependent steps, joins by position and integrity rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks
from tidemark.operators import layout as L
from tidemark.sources.tables import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


BEFORE = "PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) % 5 END AS rk FROM conversations),
a AS (SELECT *, rk IS NOT NULL AND rk >= coalesce(max(rk) OVER ({BEFORE}), -1) AS accepted FROM c)
SELECT conv_id, turn, accepted, coalesce(last_value(CASE WHEN accepted THEN rk END IGNORE NULLS) OVER ({UPTO}), -1) AS section FROM a""")
def section_assign(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("rk", F.when(F.col("role") == "user", F.length("text") % 5))
    return L.section_assign(rows, ["conv_id"], ["turn"], "rk").select("conv_id", "turn", "accepted", F.coalesce("section", F.lit(-1)).alias("section"))


@query(f"SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER ({UPTO}) AS \"group\" FROM conversations")
def numbered_groups(spark, sf_dir):
    return L.running_groups(turns(spark, sf_dir), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "group")


@query(r"""WITH p AS (SELECT conv_id, turn, generate_subscripts(ps, 1) AS pos, unnest(ps) AS piece FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+') AS ps FROM conversations))
SELECT conv_id, turn, pos, md5(trim(piece, ' ' || chr(10))) AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS "group" FROM p WHERE trim(piece, ' ' || chr(10)) <> ''""")
def punct_groups(spark, sf_dir):
    pieces = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("([^.!?]*[.!?]+|[^.!?]+)"), 1)).alias("pos", "piece"))
    rows = pieces.withColumns({"pos": F.col("pos") + 1, "piece": F.btrim("piece", F.lit(" \n"))}).filter("piece <> ''")
    return L.running_groups(rows, ["conv_id"], ["turn", "pos"], F.lit(True)).select("conv_id", "turn", "pos", F.md5("piece").alias("piece"), "group")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS gap, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(sum(CASE WHEN gap IS NULL THEN NULL WHEN gap > 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber ROWS UNBOUNDED PRECEDING), 0) AS cell FROM g""")
def cells_by_gap(spark, sf_dir):
    out = L.gaps(lines(spark, sf_dir), ["l_orderkey"], ["l_extendedprice", "l_linenumber"], "l_extendedprice", 10000)
    return out.select("l_orderkey", "l_linenumber", F.coalesce("cell", F.lit(0)).alias("cell"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 - lag(l_extendedprice / 1000) OVER w AS gap, lag(l_quantity) OVER w AS size, l_extendedprice FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice))
SELECT l_orderkey, l_linenumber, coalesce(sum(CASE WHEN gap < 0.5 OR gap > 2 * size THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS UNBOUNDED PRECEDING), 0) AS block FROM g""")
def split_geometry(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("size"))
    return L.split_geometry(rows, ["l_orderkey"], ["l_linenumber", "l_extendedprice"], "x", "size").select("l_orderkey", "l_linenumber", "block")


@query("""WITH i AS (SELECT l_suppkey, l_orderkey, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem))
SELECT l_suppkey, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM i GROUP BY l_suppkey, k""")
def merge_blocks(spark, sf_dir):
    return L.merge_blocks(lines(spark, sf_dir), ["l_suppkey"], "l_orderkey")


@query(f"SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER ({BEFORE}), 0) AS BIGINT) AS \"offset\" FROM conversations")
def running_offset(spark, sf_dir):
    return L.running_offset(turns(spark, sf_dir), ["conv_id"], ["turn"], F.length("text"), 1).select("conv_id", "turn", "offset")


@query(f"SELECT conv_id, turn, CASE WHEN max(CASE WHEN contains(text, 'x') THEN 1 ELSE 0 END) OVER ({UPTO}) = 1 THEN 'more' WHEN max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER ({UPTO}) = 1 THEN 'talk' ELSE 'numbered' END AS mode FROM conversations")
def sticky_marker(spark, sf_dir):
    return L.sticky(turns(spark, sf_dir), ["conv_id"], ["turn"], [("more", F.col("text").contains("x")), ("talk", F.col("role") == "assistant")], "numbered").select("conv_id", "turn", "mode")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25)
SELECT a.l_orderkey, a.l_linenumber, coalesce(min(b.l_linenumber), -1) AS other FROM v a LEFT JOIN v b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2""")
def adjacent_match(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity").filter("l_quantity > 25").dropDuplicates(["l_orderkey", "l_linenumber"])
    return L.adjacent_match(rows, ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 25).select("l_orderkey", "l_linenumber", F.coalesce("other", F.lit(-1)).alias("other"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, l_linenumber AS seq, l_extendedprice / 10000 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY -(l_extendedprice / 10000), l_linenumber) AS k FROM lineitem),
t AS (SELECT l_orderkey, k, seq, y AS anchor, 1 AS line FROM o WHERE k = 1 UNION ALL
 SELECT o.l_orderkey, o.k, o.seq, CASE WHEN abs(o.y - anchor) > 2 THEN o.y ELSE anchor END, line + CASE WHEN abs(o.y - anchor) > 2 THEN 1 ELSE 0 END FROM o JOIN t ON o.l_orderkey = t.l_orderkey AND o.k = t.k + 1)
SELECT l_orderkey, seq, line FROM t""")
def line_cluster(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", (F.col("l_extendedprice") / 10000).alias("y"), F.col("l_linenumber").alias("seq"))
    return L.line_cluster(rows, ["l_orderkey"], "y", "seq")


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, l_partkey AS place, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS k FROM lineitem),
t AS (SELECT l_orderkey, k, place, number, number = 1 AS hit, CASE WHEN number = 1 THEN 2 ELSE 1 END AS expected FROM o WHERE k = 1 UNION ALL
 SELECT o.l_orderkey, o.k, o.place, o.number, o.number = expected, expected + CASE WHEN o.number = expected THEN 1 ELSE 0 END FROM o JOIN t ON o.l_orderkey = t.l_orderkey AND o.k = t.k + 1)
SELECT l_orderkey, place, number FROM t WHERE hit""")
def contiguous_numbering(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("l_partkey").alias("place"), F.col("l_linenumber").alias("number"))
    return L.contiguous_numbering(rows, ["l_orderkey"], "place", "number")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'entry' WHEN length(text) % 4 > 0 THEN 'more' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
t AS (SELECT conv_id, k, turn, text, CASE WHEN kind = 'entry' THEN turn END AS entry FROM o WHERE k = 1 UNION ALL
 SELECT o.conv_id, o.k, o.turn, o.text, CASE o.kind WHEN 'entry' THEN o.turn WHEN 'more' THEN entry END FROM o JOIN t ON o.conv_id = t.conv_id AND o.k = t.k + 1)
SELECT conv_id, entry AS turn, string_agg(text, '' ORDER BY k) AS text FROM t WHERE entry IS NOT NULL GROUP BY 1, 2""")
def continuation_append(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "entry").when(F.length("text") % 4 > 0, "more").otherwise("other")
    return L.continuation_append(turns(spark, sf_dir).withColumn("kind", kind), ["conv_id"], "turn", "kind", "text")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 60000 - 0.2 * 20000 THEN 4 WHEN l_extendedprice >= 40000 - 0.2 * 25000 THEN 3 WHEN l_extendedprice >= 15000 - 0.2 * 5000 THEN 2 WHEN l_extendedprice >= 10000 - 0.2 * 10000 THEN 1 ELSE 0 END AS col FROM lineitem")
def join_column_interval(spark, sf_dir):
    columns = F.array(*[F.lit(float(x)) for x in (0, 10000, 15000, 40000, 60000)])
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", L.column_of(F.col("l_extendedprice"), columns).alias("col"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber AS seq, l_tax * 100 AS x, l_tax * 100 + l_quantity / 10 AS r FROM lineitem)
SELECT f.l_orderkey, f.seq, arg_min(h.seq, (h.r - h.x, h.seq)) AS host FROM f JOIN f h ON f.l_orderkey = h.l_orderkey AND h.x < f.x AND f.x < h.r GROUP BY 1, 2""")
def join_host_fragment(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("seq"), (F.col("l_tax") * 100).alias("x"), (F.col("l_tax") * 100 + F.col("l_quantity") / 10).alias("right"))
    return L.host_fragments(rows, ["l_orderkey"], "seq")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), f AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM benchmark)
SELECT word, form AS head, substr(word, length(form) + 1) AS tail FROM (SELECT word, form, row_number() OVER (PARTITION BY word ORDER BY length(form) DESC) AS k FROM w JOIN f ON starts_with(word, form)) WHERE k = 1""")
def join_longest_prefix(spark, sf_dir):
    words = turns(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    forms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("form"))
    return L.longest_prefix(words, "word", forms, "form")


@query("""WITH v AS (SELECT lang, source, count(*) AS votes, min(doc_id) AS f FROM documents GROUP BY 1, 2)
SELECT lang, source, votes FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY votes DESC, f) AS k FROM v) WHERE k = 1""")
def boundary_vote(spark, sf_dir):
    return L.boundary_vote(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang"], "source", "doc_id")


@query("""WITH v AS (SELECT l_suppkey, round(l_quantity * 10, 1) AS x, l_linenumber = 1 AS own, count(*) AS votes, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT l_suppkey, x AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, f) AS k FROM v WHERE own) WHERE k = 1),
c AS (SELECT v.l_suppkey, x FROM v JOIN a ON v.l_suppkey = a.l_suppkey WHERE NOT own AND votes >= 3 AND x - first >= 100), b AS (SELECT l_suppkey, min(x) AS second FROM c GROUP BY 1),
d AS (SELECT c.l_suppkey, min(x) AS third FROM c JOIN b ON c.l_suppkey = b.l_suppkey WHERE x - second >= 100 GROUP BY 1)
SELECT a.l_suppkey, first, CASE WHEN third IS NOT NULL THEN second END AS second, coalesce(third, second) AS third FROM a LEFT JOIN b ON a.l_suppkey = b.l_suppkey LEFT JOIN d ON a.l_suppkey = d.l_suppkey""")
def column_learn(spark, sf_dir):
    """Where the columns of a supplier's lines stand: the first one from first lines, the others from the rest."""
    rows = lines(spark, sf_dir).select("l_suppkey", F.round(F.col("l_quantity") * 10, 1).alias("x"), (F.col("l_linenumber") == 1).alias("own"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("f"))
    return L.learn_columns(rows, ["l_suppkey"], "x", "own", "f")


CELLS = """c AS (SELECT l_orderkey, rn - 1 AS r, unnest([1, 2, 3]) AS col, unnest([l_returnflag, l_linestatus, 'same']) AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem))"""


@query(f"WITH {CELLS} SELECT a.l_orderkey, a.col FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.col = b.col AND b.r = 0 GROUP BY 1, 2 HAVING bool_or(a.v IS DISTINCT FROM b.v)")
def slot_detect(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = lines(spark, sf_dir).withColumn("r", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1)
    cells = rows.select("l_orderkey", "r", F.posexplode(F.array("l_returnflag", "l_linestatus", F.lit("same"))).alias("col", "v")).withColumn("col", F.col("col") + 1)
    return L.slot_detect(cells, ["l_orderkey"], "r", "col", "v")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - l_extendedprice AS gap FROM lineitem)
SELECT l_orderkey, arg_max(l_linenumber, (gap, l_linenumber)) AS cut, max(gap) AS gap FROM g WHERE gap >= 50 GROUP BY 1""")
def split_usage_cells(spark, sf_dir):
    from pyspark.sql import Window as W

    gap = F.lead("l_extendedprice").over(W.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")) - F.col("l_extendedprice")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", gap.alias("gap")).filter("gap >= 50")
    return rows.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("gap", "l_linenumber")).alias("cut"), F.max("gap").alias("gap"))


@query("SELECT c.conv_id, c.turn, b.item_id FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT max(item_id) + 1 FROM benchmark) WHERE substr(c.text, CAST(c.turn AS INTEGER) + 1, 2) = left(b.text, 2)")
def join_marks_sentences(spark, sf_dir):
    """A mark joins its sentence and stays only if the text stands at its offset."""
    items = table(spark, sf_dir, "benchmark")
    marks = items.select("item_id", F.substring("text", 1, 2).alias("p"))
    rows = turns(spark, sf_dir).withColumn("item_id", F.col("conv_id") % items.agg(F.max("item_id") + 1).scalar()).join(marks, "item_id")
    return rows.filter(F.substring("text", (F.col("turn") + 1).cast("int"), F.length("p")) == F.col("p")).select("conv_id", "turn", "item_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def anti_orphans(spark, sf_dir):
    return checks.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "doc_id").select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_known(spark, sf_dir):
    return checks.known(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def chk_unique_ids(spark, sf_dir):
    return checks.repeated_ids(lines(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query("SELECT source, doc_id % 50 AS id, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def items_by_id(spark, sf_dir):
    return checks.repeated_ids(table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 50).alias("id")), ["source", "id"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def chk_vocab_seq(spark, sf_dir):
    return checks.broken_numbering(lines(spark, sf_dir), ["l_orderkey"], "l_linenumber").select("l_orderkey", "n")


def _rule(name: str, rows: str, key: str, bad, detail, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: checks.violations(table(spark, sf_dir, rows), name, F.col(key), bad(), detail())
    ORACLE_SQL[name] = sql


TRIM = rf"regexp_replace(%s, '^{T.SPACES}+|{T.SPACES}+\z', '', 'g')"
_rule("chk_sentence_end", "documents", "doc_id", lambda: checks.sentence_end(F.col("text"), ".?!"), lambda: F.length("text"), rf"SELECT 'chk_sentence_end' AS rule, CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS VARCHAR) AS detail FROM documents WHERE {TRIM % 'text'} <> '' AND NOT regexp_matches({TRIM % 'text'}, '[.?!]\z')")
_rule("chk_circled", "conversations", "conv_id", lambda: checks.circled(F.translate("text", "xz", "①⑳")), lambda: F.col("turn"), "SELECT 'chk_circled' AS rule, CAST(conv_id AS VARCHAR) AS id, CAST(turn AS VARCHAR) AS detail FROM conversations WHERE regexp_matches(translate(text, 'xz', '①⑳'), '[①-⑳]')")
_rule("chk_ruby_at", "conversations", "conv_id", lambda: F.substring("text", (F.col("turn") + 1).cast("int"), 1) != F.substring("text", 1, 1), lambda: F.col("turn"), "SELECT 'chk_ruby_at' AS rule, CAST(conv_id AS VARCHAR) AS id, CAST(turn AS VARCHAR) AS detail FROM conversations WHERE substr(text, CAST(turn AS INTEGER) + 1, 1) <> substr(text, 1, 1)")
_rule("body_size_filter", "part", "p_partkey", lambda: F.col("p_size") >= 8, lambda: F.col("p_size"), "SELECT 'body_size_filter' AS rule, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS detail FROM part WHERE p_size >= 8")


@query("""WITH l AS (SELECT conv_id, turn, turn % 2 = 0 AND conv_id % 4 <> 1 AS ex, CASE WHEN turn % 2 = 1 THEN text ELSE ' ' END || CASE WHEN turn % 2 = 1 AND conv_id % 7 = 0 THEN '「」' ELSE '' END || CASE WHEN turn % 2 = 1 AND conv_id % 3 = 0 THEN '②' ELSE '' END AS b,
 CASE WHEN conv_id % 8 = 2 THEN ' ' WHEN conv_id % 5 = 0 AND turn = 2 THEN text || '①' ELSE text END AS jp FROM conversations),
p AS (SELECT conv_id, string_agg(b, '' ORDER BY turn) AS body, bool_or(ex AND trim(jp) <> '') AS any_jp FROM l GROUP BY 1)
SELECT conv_id, 'circled' AS rule, md5(jp) AS detail FROM l WHERE ex AND regexp_matches(jp, '[①-⑳]') UNION ALL SELECT conv_id, 'quote', md5(body) FROM p WHERE contains(body, '「」') UNION ALL SELECT conv_id, 'lost', md5(body) FROM p WHERE NOT any_jp AND regexp_matches(body, '[①-⑳]')""")
def chk_grammar(spark, sf_dir):
    """Conversations are points, even turns examples, odd ones the body; some hold marks."""
    conv, odd = F.col("conv_id"), F.col("turn") % 2 == 1
    b = F.concat(F.when(odd, F.col("text")).otherwise(" "), F.when(odd & (conv % 7 == 0), "「」").otherwise(""), F.when(odd & (conv % 3 == 0), "②").otherwise(""))
    jp = F.when(conv % 8 == 2, " ").when((conv % 5 == 0) & (F.col("turn") == 2), F.concat("text", F.lit("①"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", b.alias("b"), F.when(~odd & (conv % 4 != 1), jp).alias("jp"))
    points = rows.groupBy("conv_id").agg(F.collect_list("jp").alias("jp"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "b"))), lambda r: r["b"]), "").alias("body"))
    return checks.grammar(points, ["conv_id"], "jp", "body").withColumn("detail", F.md5("detail"))


@query("SELECT doc_id FROM documents WHERE source IN ('src0', 'src3')")
def section_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src3")).select("doc_id")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(abs(l_quantity - 25) < 20)")
def page_header_filter(spark, sf_dir):
    """Groups all of whose members are near one size."""
    return lines(spark, sf_dir).groupBy("l_orderkey").agg(F.bool_and(F.abs(F.col("l_quantity") - 25) < 20).alias("all")).filter("all").select("l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE coalesce(o_orderpriority, '') <> '1-URGENT'")
def drill_model_dup(spark, sf_dir):
    """Rows equal to the model drop out; a null is not equal to it."""
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderpriority").eqNullSafe("1-URGENT")).select("o_orderkey")


@query(rf"""SELECT 'blank' AS rule, CAST(doc_id AS VARCHAR) AS id, 'text' AS detail FROM documents WHERE {TRIM % "coalesce(text, '')"} = ''
UNION ALL SELECT 'source', CAST(doc_id AS VARCHAR), source FROM documents WHERE source = 'src1' UNION ALL SELECT 'short', CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars < 100""")
def chk_vocab_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = [("blank", checks.blank(F.col("text")), F.lit("text")), ("source", F.col("source") == "src1", F.col("source")), ("short", F.col("n_chars") < 100, F.col("n_chars"))]
    return checks.union([checks.violations(docs, name, F.col("doc_id"), bad, detail) for name, bad, detail in rules])


@query("""WITH l AS (SELECT doc_id, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS leaf FROM documents) SELECT DISTINCT doc_id, leaf FROM l WHERE regexp_matches(leaf, 'src1|7')""")
def chk_misdecode(spark, sf_dir):
    leaves = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array("lang", "source", F.col("n_chars").cast("string"))).alias("leaf"))
    return leaves.filter(F.col("leaf").rlike("src1|7")).distinct()


@query("SELECT conv_id, turn, turn % 3 <> 0 OR text = '' AS same, CASE WHEN turn % 3 = 0 AND text <> '' THEN 0 ELSE least(1, length(text)) + CASE WHEN length(text) > 3 THEN 1 ELSE 0 END END AS marked FROM conversations")
def chk_roundtrip(spark, sf_dir):
    """Tokens of a text with its marks give the text back, if the marks are that text's: every third turn has those of a longer text."""
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("＿＿＿＿"), "text")).otherwise(F.col("text"))
    mark = lambda at, size, kana: F.struct(F.lit(at).alias("at"), F.substring(text, at + 1, size).alias("base"), F.lit(kana).alias("kana"))
    marks = F.filter(F.array(mark(0, 2, "x"), mark(3, 1, "y")), lambda m: m["base"] != "")
    tokens = T.annotate_marks(F.col("text"), marks)
    marked = F.size(F.filter("tokens", lambda t: t["reading"].isNotNull()))
    kept = T.marks_apply_cleanly(F.col("text"), F.col("marks")) & (F.array_join(F.transform("tokens", lambda t: t["text"]), "") == F.col("text"))
    return turns(spark, sf_dir).withColumns({"marks": marks, "tokens": tokens}).select("conv_id", "turn", kept.alias("same"), marked.alias("marked"))


@query("SELECT p_partkey, CAST(p_size % 5 AS INTEGER) AS idx FROM part WHERE p_size % 5 >= 3")
def chk_pattern_rows(spark, sf_dir):
    """Row indexes outside their slot (of three values)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array((F.col("p_size") % 5).cast("int"))).alias("idx"))
    return rows.filter((F.col("idx") < 0) | (F.col("idx") >= 3))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def category_pivot_totals(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT doc_id, lang, source FROM documents), v AS (SELECT lang, arg_max(source, doc_id) AS s FROM k WHERE source <> 'src0' GROUP BY 1), u AS (SELECT lang, min(source) AS s FROM k GROUP BY 1 HAVING count(DISTINCT source) = 1)
SELECT k.doc_id, CASE WHEN k.source <> 'src0' THEN k.source ELSE coalesce(v.s, u.s) END AS reading FROM k LEFT JOIN v ON k.lang = v.lang LEFT JOIN u ON k.lang = u.lang""")
def fill_missing_kana(spark, sf_dir):
    """A missing value from the last row of its group that has one, else from a reading unique in the group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("known", F.when(F.col("source") != "src0", F.col("source")))
    last = docs.filter("known IS NOT NULL").groupBy("lang").agg(F.max_by("known", "doc_id").alias("v"))
    only = docs.groupBy("lang").agg(F.count_distinct("source").alias("n"), F.min("source").alias("u")).filter("n = 1").drop("n")
    return docs.join(last, "lang", "left").join(only, "lang", "left").select("doc_id", F.coalesce("known", "v", "u").alias("reading"))


@query("SELECT event_id, CAST(j.k AS BIGINT) AS k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) j WHERE j.k IS NOT NULL")
def scan_keyed_json(spark, sf_dir):
    """JSON objects keyed by id, as rows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.filter("key = 'k'").select("event_id", F.col("value").cast("bigint").alias("k"))


@query("SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, md5(line) AS line FROM (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def flatten_lessons(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("line").alias("line"))


@query("SELECT conv_id, string_agg(role || ':' || CAST(turn AS VARCHAR), '|' ORDER BY turn) AS body FROM conversations GROUP BY 1")
def order_reading(spark, sf_dir):
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), "|").alias("body"))
