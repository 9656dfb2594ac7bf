"""Queries of the generators: words, patterns and sentences are read off the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import items as I
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


def vocab(spark, sf_dir):
    """Parts as words: lesson from the size, spelling for every third, gloss from type and brand."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_size") % 15 + 1).alias("lesson"),
        F.col("p_partkey").alias("no"),
        F.col("p_partkey").alias("pos"),
        F.col("p_name").alias("kana"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("、"), "p_brand")).alias("kanji"),
        F.concat("p_type", F.lit("（"), "p_brand", F.lit("）")).alias("zh"),
    )


VOCAB = "v AS (SELECT p_size % 15 + 1 AS lesson, p_partkey AS no, p_name AS kana, CASE WHEN p_partkey % 3 = 0 THEN p_type || '、' || p_brand END AS kanji, p_type || '（' || p_brand || '）' AS zh, p_type AS gloss, p_brand FROM part)"


@query(f"""WITH {VOCAB}, k AS (SELECT *, kana || CASE WHEN count(*) OVER (PARTITION BY kana) > 1 THEN ':L' || lesson || '-' || no ELSE '' END AS key FROM v), n AS (SELECT lesson, count(DISTINCT gloss) AS c FROM v GROUP BY 1)
SELECT 'recall:' || key || ':zh2jp' AS id, lesson, zh AS prompt, kana AS answer, CASE WHEN kanji IS NULL THEN kana ELSE kanji || '|' || gloss || '|' || p_brand || '|' || kana END AS alternatives, 'w:' || coalesce(kanji, kana) AS covers, 'word' AS skills FROM k
UNION ALL SELECT 'recall:' || key || ':kanji2kana', lesson, kanji, kana, '', 'w:' || kanji || ':reading', 'reading' FROM k WHERE kanji IS NOT NULL
UNION ALL SELECT 'recall:' || key || ':jp2zh', k.lesson, coalesce(kanji, kana), gloss, '', 'w:' || coalesce(kanji, kana), 'word' FROM k JOIN n ON k.lesson = n.lesson WHERE c >= 4""")
def gen_recall(spark, sf_dir):
    out = I.recall(vocab(spark, sf_dir))
    return out.select("id", "lesson", "prompt", "answer", *[F.array_join(c, "|").alias(c) for c in ("alternatives", "covers", "skills")])


def shuffled(name: str, rows: str) -> str:
    """Two table expressions: `name` holds rows (k, seed, v) with v in the order that the generator gives, swaps from the end."""
    return f"""{name}_steps(k, i, s, v) AS (SELECT k, len(v) - 1, seed::BIGINT, v FROM {rows} UNION ALL
 SELECT k, i - 1, (s * {I.STEP} + {I.ADD}) % 4294967296, list_transform(v, lambda x, p: CASE WHEN p = i + 1 THEN v[(s * {I.STEP} + {I.ADD}) % 4294967296 % (i + 1) + 1] WHEN p = (s * {I.STEP} + {I.ADD}) % 4294967296 % (i + 1) + 1 THEN v[i + 1] ELSE x END) FROM {name}_steps WHERE i > 0),
{name} AS (SELECT k, v FROM {name}_steps WHERE i <= 0)"""


@query(f"""WITH RECURSIVE {VOCAB}, w AS (SELECT *, 'recall:' || kana || CASE WHEN count(*) OVER (PARTITION BY kana) > 1 THEN ':L' || lesson || '-' || no ELSE '' END || ':jp2zh' AS id FROM v),
o AS (SELECT id, gloss, list_sort(list_filter(pool, lambda g: g <> gloss)) AS others FROM w JOIN (SELECT lesson, list(DISTINCT gloss) AS pool FROM v GROUP BY 1) p ON w.lesson = p.lesson WHERE len(pool) > 3),
h AS (SELECT *, list_reduce(list_prepend({T.FNV_START}::BIGINT, list_transform(string_split(id, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * {T.FNV_PRIME}) % 4294967296) AS seed FROM o),
r1 AS (SELECT id AS k, seed, others AS v FROM h), {shuffled("a", "r1")}, r2 AS (SELECT id AS k, xor(seed, {I.SECOND}::BIGINT) AS seed, list_prepend(gloss, a.v[:3]) AS v FROM h JOIN a ON id = a.k), {shuffled("b", "r2")}
SELECT id, gloss AS answer, array_to_string(b.v, '|') AS choices FROM h JOIN b ON id = b.k""")
def choices4(spark, sf_dir):
    return I.recall(vocab(spark, sf_dir)).filter("choices IS NOT NULL").select("id", "answer", F.array_join("choices", "|").alias("choices"))


@query(f"""WITH RECURSIVE r AS (SELECT l_orderkey AS k, l_orderkey AS seed, list(l_partkey ORDER BY l_partkey) AS v FROM lineitem GROUP BY 1), {shuffled("a", "r")}
SELECT k AS l_orderkey, array_to_string(v, ',') AS parts FROM a""")
def seeded_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return rows.select("l_orderkey", F.array_join(I.seeded_shuffle(F.col("parts"), F.col("l_orderkey")), ",").alias("parts"))


STEMS = "['かき', 'たべ', 'し']"


@query(f"""WITH w AS (SELECT p_size % 15 + 1 AS lesson, p_partkey AS pos, p_brand || {STEMS}[p_size % 3 + 1] AS stem, ['I', 'II', 'III'][p_size % 3 + 1] AS g FROM part WHERE p_size < 40),
f AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lesson, pos) AS k FROM w),
x AS (SELECT *, unnest(['masen', 'mashita', 'masendeshita', 'te']) AS form, unnest(['ません', 'ました', 'ませんでした', 'て']) AS ending, unnest([4, 4, 4, 14]) AS fl FROM f WHERE k = 1)
SELECT 'conj:' || stem || 'ます:masu2' || form AS id, lesson, greatest(lesson, fl) AS requires_lesson, CASE WHEN form = 'te' AND g = 'I' THEN left(stem, -1) || 'いて' ELSE stem || ending END AS answer,
 'よ' || CASE WHEN form = 'te' AND g = 'I' THEN left(stem, -1) || 'いて' ELSE stem || ending END AS alternatives, 'r:' || form || ':group' || g || '|w:' || stem || 'ます:group' AS covers FROM x""")
def gen_transform(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size < 40")
    kana = F.concat("p_brand", F.get(F.array(F.lit("かき"), F.lit("たべ"), F.lit("し")), (F.col("p_size") % 3).cast("int")), F.lit("ます"))
    words = p.select((F.col("p_size") % 15 + 1).alias("lesson"), F.col("p_partkey").alias("pos"), kana.alias("kana"), F.lit("").alias("kanji"), F.get(F.array(F.lit("I"), F.lit("II"), F.lit("III")), (F.col("p_size") % 3).cast("int")).alias("g"))
    verbs = words.select(F.col("kana").alias("cite"), F.col("g").alias("group"), F.concat(F.lit("よ"), "kana").alias("reading")).distinct()
    out = I.transform(words.drop("g"), verbs)
    return out.select("id", "lesson", "requires_lesson", "answer", F.array_join("alternatives", "|").alias("alternatives"), F.array_join("covers", "|").alias("covers"))


@query(f"""WITH w AS (SELECT p_size % 15 + 1 AS lesson, p_partkey AS pos, p_brand || CASE WHEN p_size % 2 = 0 THEN 'さむい' ELSE 'しずか' END AS cite, CASE WHEN p_size % 2 = 0 THEN 'i' ELSE 'na' END AS kind FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY cite ORDER BY lesson, pos) AS k FROM w),
x AS (SELECT *, unnest(['neg', 'past', 'pastneg', 'te', 'adverb']) AS form, unnest([8, 12, 12, 16, 16]) AS fl, unnest(['くないです', 'かったです', 'くなかったです', 'くて', 'く']) AS ei, unnest(['じゃありません', 'でした', 'じゃありませんでした', 'で', 'に']) AS en FROM f WHERE k = 1)
SELECT 'adj:' || cite || ':' || form AS id, lesson, greatest(lesson, fl) AS requires_lesson, CASE kind WHEN 'i' THEN left(cite, -1) || ei ELSE cite || en END AS answer, 'r:' || form || ':' || kind || 'adj|w:' || cite || ':group' AS covers FROM x""")
def gen_adjective(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "i").otherwise("na")
    words = table(spark, sf_dir, "part").select((F.col("p_size") % 15 + 1).alias("lesson"), F.col("p_partkey").alias("pos"), F.concat("p_brand", F.when(kind == "i", "さむい").otherwise("しずか［な］")).alias("kana"), F.lit(None).cast("string").alias("kanji"), kind.alias("kind"))
    cites = words.select(F.replace("kana", F.lit("［な］"), F.lit("")).alias("cite"), "kind", F.replace("kana", F.lit("［な］"), F.lit("")).alias("reading")).distinct()
    out = I.adjectives(words.drop("kind"), cites)
    return out.select("id", "lesson", "requires_lesson", "answer", F.array_join("covers", "|").alias("covers"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 15 + 1 AS lesson, [o_orderpriority, o_orderstatus, ''] AS s, [CAST(o_custkey AS VARCHAR), 'x'] AS t, unnest([0, 1, 2, 3]) AS no FROM orders),
f AS (SELECT id, lesson, no, s[i + 1] || ' is ' || t[j + 1] AS answer, s[i + 1] || CASE WHEN s[i + 1] = '' THEN '' ELSE ' ／ ' END || t[j + 1] AS cues FROM (SELECT *, [0, 1, 2, 1][no + 1] AS i, [0, 1, 0, (id % 3)::INT][no + 1] AS j FROM r) WHERE j < 2)
SELECT 'subst:' || id || ':' || no AS id, lesson, (SELECT arg_min(b.answer, b.no) FROM f b WHERE b.id = f.id AND b.no <> f.no) AS example, cues, answer FROM f""")
def gen_substitute(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pair = lambda a, b: F.array(F.lit(a), F.lit(b) if isinstance(b, int) else b)
    patterns = o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.col("o_orderkey") % 15 + 1).alias("lesson"),
        F.lit("{S} is {T}").alias("template"),
        F.create_map(F.lit("S"), F.array("o_orderpriority", "o_orderstatus", F.lit("")), F.lit("T"), F.array(F.col("o_custkey").cast("string"), F.lit("x"))).alias("slots"),
        F.array(pair(0, 0), pair(1, 1), pair(2, 0), pair(1, (F.col("o_orderkey") % 3).cast("int"))).alias("rows"),
    )
    return I.substitute(patterns)


TURNS = """d AS (SELECT conv_id, list(text ORDER BY turn) AS ts, list(role ORDER BY turn) AS rs FROM conversations GROUP BY 1)"""


@query(f"""WITH {TURNS} SELECT 'drill:' || conv_id || ':' || (i - 1) AS id, rs[i] AS prompt, CASE WHEN conv_id % 2 = 0 THEN 'answer as in the example' ELSE 'make a sentence as in the example' END AS hint, md5(ts[i]) AS answer
FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM d) WHERE ts[i] <> ts[1]""")
def gen_drill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    drills = c.select(F.col("conv_id").cast("string").alias("id"), F.lit(1).alias("lesson"), F.get("t", F.lit(0))["text"].alias("model_answer"), (F.col("conv_id") % 2 == 0).alias("ask"), F.transform("t", lambda x: F.struct(x["role"].alias("cue"), x["text"].alias("answer"))).alias("rows"))
    return I.drills(drills).select("id", "prompt", "hint", F.md5("answer").alias("answer"))


@query("""WITH s AS (SELECT conv_id * 1000 + turn AS sentence, text AS jp, role AS alt FROM conversations), m AS (SELECT conv_id * 1000 + turn AS sentence, CAST(turn % 4 AS INTEGER) AS place, CASE WHEN turn % 2 = 0 THEN substr(text, CAST(turn % 4 AS INTEGER) + 1, 2) ELSE 'zz' END AS p, CASE WHEN turn % 3 = 0 THEN 'p:ni:source' ELSE 'p:x' END AS c FROM conversations)
SELECT 'cloze:' || m.sentence || ':' || place AS id, md5(left(jp, place) || '＿' || substr(jp, place + 3)) AS prompt, p AS answer, alt || CASE WHEN c = 'p:ni:source' THEN '|から' ELSE '' END AS alternatives, c AS covers FROM m JOIN s ON m.sentence = s.sentence WHERE substr(jp, place + 1, length(p)) = p AND length(p) = 2""")
def gen_cloze_particle(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"sentence": F.col("conv_id") * 1000 + F.col("turn"), "at": (F.col("turn") % 4).cast("int")})
    sentences = c.select("sentence", F.lit(1).alias("lesson"), F.col("text").alias("jp"), F.array("role").alias("alt"))
    marks = c.select("sentence", "at", F.when(F.col("turn") % 2 == 0, F.substring("text", F.col("at") + 1, F.lit(2))).otherwise("zz").alias("p"), F.when(F.col("turn") % 3 == 0, "p:ni:source").otherwise("p:x").alias("c"))
    out = I.cloze_particles(marks.filter(F.length("p") == 2), sentences.withColumn("sentence", F.col("sentence")))
    return out.select("id", F.md5("prompt").alias("prompt"), "answer", F.array_join("alternatives", "|").alias("alternatives"), F.get("covers", F.lit(0)).alias("covers"))


@query(r"""WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM benchmark), s AS (SELECT conv_id * 1000 + turn AS sentence, replace(lower(text), chr(10), ' ') AS jp FROM conversations),
c AS (SELECT sentence, jp, unnest(regexp_extract_all(jp, '[　 ]+|[^　 ]+')) AS chunk, generate_subscripts(regexp_extract_all(jp, '[　 ]+|[^　 ]+'), 1) AS k FROM s),
o AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY sentence ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, regexp_replace(chunk, '[。？！.?!]+\z', '') AS body FROM c),
b AS (SELECT body, form FROM (SELECT body, form, row_number() OVER (PARTITION BY body ORDER BY length(form) DESC) AS r FROM (SELECT DISTINCT body FROM o) JOIN f ON starts_with(body, form) AND substr(body, length(form) + 1) IN ('', 's', 'ed', ',')) WHERE r = 1)
SELECT 'cloze:' || sentence || ':' || CAST(pos AS BIGINT) || ':phrase' AS id, b.form AS answer, 'w:' || b.form AS covers FROM o JOIN b ON o.body = b.body WHERE trim(chunk, ' 　') <> ''""")
def gen_cloze_phrase(spark, sf_dir):
    forms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("form")).distinct()
    forms = forms.select("form", F.col("form").alias("cite"), F.lit(1).alias("form_lesson"), F.col("form").alias("zh"))
    sentences = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sentence"), F.lit(1).alias("lesson"), F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")).alias("jp"))
    out = I.cloze_phrases(sentences, forms, ["", "s", "ed", ","])
    return out.select("id", "answer", F.get("covers", F.lit(0)).alias("covers"))


@query("WITH q AS (SELECT DISTINCT ['hon', 'hiki', 'satsu', 'sai', 'kai_floor', 'kai_times', 'nin', 'mai', 'dai', 'en', 'jikan', 'nen'][l_partkey %% 12 + 1] AS c, CAST(l_quantity AS BIGINT) AS n FROM lineitem) SELECT 'qty:c:' || c || ':' || n AS id, MAP {%s}[c || ':' || n] AS answer FROM q WHERE n BETWEEN 1 AND 10" % ", ".join(f"'{k}': '{v}'" for k, v in R.counter_table().items()))
def gen_quantity(spark, sf_dir):
    keys = F.array(*map(F.lit, R.COUNTERS))
    wanted = table(spark, sf_dir, "lineitem").select(F.get(keys, (F.col("l_partkey") % 12).cast("int")).alias("counter"), F.col("l_quantity").cast("bigint").alias("n"))
    return I.quantities(wanted).select("id", "answer")


@query("SELECT conv_id, turn, CASE WHEN length(x) > 2 AND ends_with(x, 'から') THEN 'から' WHEN length(x) > 1 AND ends_with(x, 'は') THEN 'は' WHEN length(x) > 1 AND ends_with(x, 'を') THEN 'を' WHEN length(x) > 1 AND ends_with(x, 'に') THEN 'に' END AS p FROM (SELECT conv_id, turn, text || ['は', 'を', 'から', 'に', 'x'][turn % 5 + 1] AS x FROM conversations)")
def draft_particles(spark, sf_dir):
    end = F.get(F.array(*map(F.lit, ("は", "を", "から", "に", "x"))), (F.col("turn") % 5).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", I.draft_particles(F.concat("text", end)).alias("p"))


@query("""WITH d AS (SELECT o_orderkey, [o_orderstatus, o_orderpriority] AS c, CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END AS a FROM orders WHERE o_orderkey % 5 > 0)
SELECT CASE WHEN len(a) = 2 THEN o_orderkey || '#' || k ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN len(a) = 2 THEN c[k] ELSE array_to_string(c, '｜') END AS cue, CASE WHEN len(a) = 2 THEN a[k] ELSE 'a' END AS answer FROM (SELECT *, unnest(range(1, len(a) + 1)) AS k FROM d)""")
def draft_drills(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat_ws("｜", "o_orderstatus", "o_orderpriority").alias("cues"), F.when(F.col("o_orderkey") % 2 == 0, "a｜b").otherwise("a").alias("answers"), F.when(F.col("o_orderkey") % 5 > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("items"))
    return I.draft_drills(rows)


@query("SELECT i, c, first_pos FROM (SELECT p_name AS i, min(p_partkey) AS first_pos, CASE WHEN ends_with(p_name, 'g') THEN 'i' ELSE 'na' END AS c FROM part WHERE ends_with(p_name, 'g') OR ends_with(p_name, 't') GROUP BY p_name)")
def draft_adjectives(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(F.col("p_name").endswith("g") | F.col("p_name").endswith("t"))
    first = p.groupBy(F.col("p_name").alias("i")).agg(F.min("p_partkey").alias("first_pos"))
    return first.select("i", F.when(F.col("i").endswith("g"), "i").otherwise("na").alias("c"), "first_pos")


@query("SELECT d.doc_id, md5(text) AS body, coalesce(b.items, '') AS items FROM documents d LEFT JOIN (SELECT item_id % 10 AS k, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) AS r FROM benchmark) WHERE r <= 2 GROUP BY 1) b ON d.doc_id % 10 = k")
def draft_concepts(spark, sf_dir):
    two = table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 10).alias("k")).agg(F.slice(F.sort_array(F.collect_list("item_id")), 1, 2).alias("two"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10).alias("k"))
    return docs.join(two, "k", "left").select("doc_id", F.md5("text").alias("body"), F.coalesce(F.array_join(F.transform("two", lambda x: x.cast("string")), ","), F.lit("")).alias("items"))


@query("SELECT p_partkey, d.n AS adjectives FROM part JOIN (SELECT p_name AS w, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1) d ON replace(p_name || '［な］', '［な］', '') = d.w")
def join_vocab_adj(spark, sf_dir):
    """Words whose spelling without its mark is listed."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    listed = p.filter("p_size % 3 = 0").groupBy(F.col("p_name").alias("w")).agg(F.count("*").alias("adjectives"))
    words = p.withColumn("w", F.replace(F.concat("p_name", F.lit("［な］")), F.lit("［な］"), F.lit("")))
    return words.join(listed, "w").select("p_partkey", "adjectives")
