"""Queries of JSON sources and sinks, lexicon annotation and record parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks
from tidemark.operators import lexicon as X
from tidemark.operators import parse as P
from tidemark.sources import json_files as J
from tidemark.sources.shared import shared_folder
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


DOC = "SELECT doc_id, lang, source, n_chars, md5(text) AS text FROM documents"


@query(DOC)
def scan_lessons(spark, sf_dir):
    """Documents as JSON files, read again with their declared schema."""
    path = shared_folder(spark, "json")
    J.write_json(table(spark, sf_dir, "documents"), path)
    return J.read_json(spark, path, "doc_id bigint, lang string, source string, n_chars bigint, text string").withColumn("text", F.md5("text"))


@query(DOC)
def scan_optional(spark, sf_dir):
    """A table together with one that is not there."""
    docs = table(spark, sf_dir, "documents")
    more = J.read_optional(spark, f"{sf_dir}/no-such-file.json", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.unionByName(more).withColumn("text", F.md5("text"))


@query("""SELECT nation.n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"suppliers":' || count(s_suppkey) || '}' AS json FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name""")
def sink_lesson_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rows = n.groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))
    return rows.select("n_nationkey", J.canonical(rows.columns).alias("json"))


@query("""SELECT part.p_partkey, array_to_string(list_transform(range(1, length(h), 4), lambda k: chr(CAST('0x' || h[k:k + 3] AS INTEGER))), '') AS out
FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: printf('%04x', unicode(c) + 12288)), '') AS h FROM part) part""")
def decode_hex(spark, sf_dir):
    """Hexadecimal digits of UTF-16: four for each character of a name, moved into the kana."""
    codes = F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.lower(F.lpad(F.hex(F.ascii(c) + 12288), 4, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", J.decode_hex(F.array_join(codes, ""), "UTF-16BE").alias("out"))


#: By role: lower-case letters stand for ideographs, words of two to six letters that users write for entries, read backwards.
LETTERS = "a-zß-öø-ÿ"
LEXICON_SQL = f"""RECURSIVE lexicon AS (SELECT DISTINCT w AS base, reverse(w) AS reading FROM (SELECT unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS w FROM conversations WHERE role = 'user') WHERE length(w) BETWEEN 2 AND 6),
 p AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT conv_id, turn, regexp_extract_all(text, '[{LETTERS}]+|[^{LETTERS}]+') AS p FROM conversations)),
 u AS (SELECT DISTINCT s FROM p WHERE regexp_matches(s, '^[{LETTERS}]')),
 h AS (SELECT s, k, arg_max(base, n) AS base FROM (SELECT s, k, n, substr(s, k, n) AS base FROM (SELECT s, n, unnest(range(1, length(s) - n + 2)) AS k FROM u, (SELECT unnest([2, 3, 4, 5, 6]) AS n))) JOIN lexicon USING (base) GROUP BY s, k),
 w(s, k, found, between) AS (SELECT s, 1, CAST([] AS VARCHAR[]), '' FROM u UNION ALL
  SELECT w.s, w.k + coalesce(length(base), 1), CASE WHEN base IS NULL THEN found ELSE list_append(found, base) END, between || CASE WHEN base IS NULL THEN substr(w.s, w.k, 1) ELSE '#' END FROM w LEFT JOIN h ON w.s = h.s AND w.k = h.k WHERE w.k <= length(w.s)),
 t AS (SELECT conv_id, turn, i, p.s, found, coalesce(between, p.s) AS between FROM p LEFT JOIN (SELECT * FROM w WHERE k > length(s)) w ON p.s = w.s)"""


def lexicon(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]+)"), 1)).alias("base")).distinct()
    return words.filter(F.length("base").between(2, 6)).withColumn("reading", F.reverse("base"))


@query(f"""WITH {LEXICON_SQL} SELECT conv_id, turn, CAST(sum(coalesce(len(found), 0)) AS BIGINT) AS matches, md5(coalesce(string_agg(array_to_string(found, '|'), '|' ORDER BY i) FILTER (WHERE len(found) > 0), '')) AS found FROM t GROUP BY conv_id, turn""")
def annotate_lexicon(spark, sf_dir):
    """How many entries each turn has, and which, in their order."""
    tokens = X.annotate(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", lexicon(spark, sf_dir), LETTERS)
    found = F.transform(F.filter("tokens", lambda t: t["reading"].isNotNull()), lambda t: t["text"])
    return tokens.select("conv_id", "turn", F.size(found).cast("bigint").alias("matches"), F.md5(F.array_join(found, "|")).alias("found"))


@query(f"""WITH {LEXICON_SQL}, e AS (SELECT conv_id, turn, base, count(*) AS n FROM (SELECT conv_id, turn, unnest(found) AS base FROM t) GROUP BY ALL),
 j AS (SELECT conv_id, turn, string_agg(base || '=' || reverse(base) || 'x' || n, '|' ORDER BY base) AS entries FROM e GROUP BY ALL)
 SELECT t.conv_id, t.turn, coalesce(any_value(entries), '') AS entries, md5(string_agg(between, '' ORDER BY i)) AS between FROM t LEFT JOIN j ON t.conv_id = j.conv_id AND t.turn = j.turn GROUP BY t.conv_id, t.turn""")
def join_lexicon_longest(spark, sf_dir):
    """The entries matched in a turn, each with its reading and how often it occurs, and the text with # in place of each match."""
    tokens = X.annotate(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", lexicon(spark, sf_dir), LETTERS)
    each = tokens.select("conv_id", "turn", F.explode("tokens").alias("t")).filter("t.reading IS NOT NULL").groupBy("conv_id", "turn", "t.text", "t.reading").agg(F.count("*").alias("n"))
    entry = F.concat("text", F.lit("="), "reading", F.lit("x"), F.col("n").cast("string"))
    listed = each.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text", entry.alias("entry")))), lambda e: e["entry"]), "|").alias("entries"))
    between = F.array_join(F.transform("tokens", lambda t: F.when(t["reading"].isNull(), t["text"]).otherwise("#")), "")
    return tokens.join(listed, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("entries", F.lit("")).alias("entries"), F.md5(between).alias("between"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS rid, l_quantity AS x, l_discount * 100 + 12 AS y FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS bid, l_quantity AS x, l_discount * 100 AS y FROM lineitem WHERE l_linenumber % 2 = 1),
c AS (SELECT r.l_orderkey, rid, list({'bid': bid, 'd': abs(r.x - b.x)} ORDER BY bid) AS c FROM r JOIN b ON r.l_orderkey = b.l_orderkey AND abs(r.y - b.y - 12) <= 2.5 AND abs(r.x - b.x) <= 12 GROUP BY 1, 2)
SELECT l_orderkey, rid, list_reduce(c, lambda a, x: CASE WHEN x.d < a.d - 1.0 THEN x ELSE a END).bid::BIGINT AS bid FROM c""")
def join_ruby_anchor(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("bid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    readings = lines.filter("l_linenumber % 2 = 0").select("l_orderkey", F.col("bid").alias("rid"), "x", (F.col("y") + 12).alias("y"))
    return P.anchored(readings, lines.filter("l_linenumber % 2 = 1"), ["l_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, ['kana', 'kanji', 'gloss'][1 + max(CASE WHEN l_quantity >= 40 THEN 2 WHEN abs(l_quantity - 20) <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)] AS part FROM lineitem""")
def split_data_cells(spark, sf_dir):
    return P.data_cells(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 20, 40).select("l_orderkey", "l_linenumber", "part")


@query("""WITH e AS (SELECT user_id, event_type, min(event_id) AS f, max(event_id) AS l FROM events WHERE event_type <> 'view' GROUP BY 1, 2 HAVING max(event_id) - min(event_id) >= 2) SELECT user_id, arg_min(event_type, f) AS marker FROM e GROUP BY 1""")
def find_marker(spark, sf_dir):
    return P.find_marker(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", ("view",))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(kept, ',') AS starts FROM (SELECT conv_id, list_concat([0], list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] = 'user' AND i > 1 THEN i - 1 END), lambda i: i IS NOT NULL)) AS kept FROM c)""")
def group_starts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return c.select("conv_id", F.array_join(F.transform(P.group_starts(F.col("r"), F.lit("user")), lambda i: i.cast("string")), ",").alias("starts"))


@query("""WITH c AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ''), 1) - 1 AS place, unnest(string_split(p_name, '')) AS ch FROM part) SELECT p_partkey, CAST(place AS BIGINT) AS place, ch, p_partkey + place * 5.0 AS char_x FROM c""")
def fragment_chars(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_partkey").cast("double").alias("x"), F.lit(10.0).alias("size"))
    return P.fragment_chars(rows, ["p_partkey"], "p_name", "x", "size").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT p_partkey, p_partkey + length(p_name) * 5.0 AS fin FROM part")
def fragment_end(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.fragment_end(F.col("p_partkey").cast("double"), F.col("p_name"), F.lit(10.0)).alias("fin"))


LINE = "CASE WHEN turn % 2 = 0 AND conv_id % 3 > 0 THEN (turn + 1) || '. ' || role ELSE role END"


@query(f"""WITH l AS (SELECT conv_id, turn, {LINE} AS s, CASE WHEN turn % 2 = 0 AND conv_id % 3 > 0 THEN CAST(turn + 1 AS INTEGER) END AS n FROM conversations),
o AS (SELECT *, count(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k, count(n) OVER (PARTITION BY conv_id) > 0 AS num FROM l),
u AS (SELECT conv_id, CASE WHEN num THEN k ELSE turn END AS u, max(n) AS n, string_agg(s, ' ' ORDER BY turn) AS sentence FROM o WHERE NOT num OR k > 0 GROUP BY 1, 2)
SELECT conv_id, coalesce(n, row_number() OVER (PARTITION BY conv_id ORDER BY u)) AS no, sentence FROM u""")
def parse_sentences(spark, sf_dir):
    line = F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % 3 > 0), F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "role")).otherwise(F.col("role"))
    return P.sentences(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn", "line")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS alt, md5(text || CASE WHEN turn % 2 = 0 THEN '' ELSE '|' || role END) AS rest FROM conversations WHERE NOT regexp_matches(text, '^[［〔\\[(（]')".replace("\\\\", "\\"))
def extract_alt(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(~F.col("text").rlike(r"^[［〔\[(（]"))
    rest, words = P.bracketed(F.array("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("（"), "role", F.lit("）"))).otherwise(F.col("role"))))
    return c.select("conv_id", "turn", F.array_join(words, "|").alias("alt"), F.md5(F.array_join(rest, "|")).alias("rest"))


@query("SELECT conv_id, NOT regexp_matches(arg_min(role, turn), '^user') AS title FROM conversations WHERE text <> '' GROUP BY 1")
def has_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").filter("text <> ''").groupBy("conv_id").agg(F.min_by("role", "turn").alias("r"))
    return first.select("conv_id", (~F.col("r").rlike("^user")).alias("title"))


@query("SELECT conv_id, turn, md5(s) AS s, array_to_string(list_filter([0 - 2, 3 - 2, 100000 - 2], lambda o: o >= 0 AND o < length(s)), ',') AS at_ FROM (SELECT conv_id, turn, regexp_replace(text, '^[ \\n]+|[ \\n]+\\z', '', 'g') AS s FROM conversations)")
def trim_offsets(spark, sf_dir):
    text = F.concat(F.lit("  "), T.trimmed(F.col("text")), F.lit(" "))
    short, places = P.trim_offsets(text, F.array(F.lit(0), F.lit(3), F.lit(100000)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(short).alias("s"), F.array_join(F.transform(places, lambda o: o.cast("string")), ",").alias("at_"))


@query("SELECT o_orderkey, '1=' || o_orderpriority || '|2=' || o_orderstatus AS items FROM orders")
def parse_drills(spark, sf_dir):
    found = P.numbered_items(F.concat(F.lit("2) "), "o_orderstatus", F.lit(" 1) "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda x: F.concat(x["no"].cast("string"), F.lit("="), x["item"])), "|").alias("items"))


@query("SELECT p_partkey, p_name AS kana, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN '日本' ELSE 'none' END AS kanji, CASE WHEN p_partkey % 3 = 2 THEN '。' || p_type ELSE p_type END AS zh FROM part")
def parse_entry(spark, sf_dir):
    k = F.col("p_partkey") % 3
    out = P.entry(F.when(k == 1, F.concat("p_name", F.lit("日本"))).otherwise(F.col("p_name")), F.when(k == 0, F.col("p_brand")).when(k == 2, "。"), F.concat("p_type", F.lit(" ")))
    return table(spark, sf_dir, "part").withColumn("e", out).select("p_partkey", "e.kana", F.coalesce("e.kanji", F.lit("none")).alias("kanji"), "e.zh")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS kana, CASE WHEN p_size % 2 = 0 THEN p_name || '本' ELSE 'none' END AS kanji FROM part")
def parse_freeform(spark, sf_dir):
    out = P.freeform(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "本").otherwise("")), F.col("p_type"))
    return table(spark, sf_dir, "part").withColumn("e", out).select("p_partkey", "e.kana", F.coalesce("e.kanji", F.lit("none")).alias("kanji"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def chk_orphans(spark, sf_dir):
    return checks.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("WITH v AS (SELECT p_brand, p_type, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_brand, p_type FROM part)) SELECT p_partkey, CAST(idx AS INTEGER) AS idx FROM part JOIN v USING (p_brand, p_type)")
def empty_slot_reuse(spark, sf_dir):
    """Values of a slot as candidates, equal ones once, and rows as indexes into them."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    candidates = p.select("p_brand", "p_type").distinct().withColumn("idx", F.row_number().over(W.partitionBy("p_brand").orderBy("p_type")) - 1)
    return p.join(candidates, ["p_brand", "p_type"]).select("p_partkey", "idx")


@query(r"""WITH f AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '  ' WHEN turn = 1 AND conv_id % 3 = 0 THEN '…' WHEN turn <= 2 AND conv_id % 3 < 2 THEN '……' || text ELSE text END AS s FROM conversations),
w AS (SELECT conv_id, string_agg(s, '' ORDER BY turn) AS whole FROM f GROUP BY 1), m AS (SELECT conv_id, length(whole) - length(regexp_replace(whole, '^\s*…+', '')) AS cut FROM w),
o AS (SELECT f.*, cut, coalesce(sum(length(s)) OVER (PARTITION BY f.conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM f JOIN m USING (conv_id))
SELECT conv_id, turn, md5(substr(s, CAST(least(length(s), greatest(0, cut - pos)) AS BIGINT) + 1)) AS out FROM o""".replace("\\\\", "\\"))
def line_tokens(spark, sf_dir):
    """Fragments (turns) of a line (conversation), some of which begin with white space and an ellipsis that spans the first ones."""
    odd = F.col("conv_id") % 3
    s = F.when(F.col("turn") == 0, "  ").when((F.col("turn") == 1) & (odd == 0), "…").when((F.col("turn") <= 2) & (odd < 2), F.concat(F.lit("……"), "text")).otherwise(F.col("text"))
    out = P.line_tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s")), ["conv_id"], "turn", "s")
    return out.select("conv_id", "turn", F.md5("s").alias("out"))
