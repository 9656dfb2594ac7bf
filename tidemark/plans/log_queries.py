"""Queries of the log, of mastery and of scheduling over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import concepts as C
from tidemark.operators import log, mastery, schedule
from tidemark.sources.event_store import EventStore
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import EVENT_LOG_SQL, ITEM_BRIDGE_SQL, epoch, event_log, item_bridge, table

QUERIES = {}
ORACLE_SQL = {}
NOW = 1_800_000_000
COUNT = 20
EV = f"WITH {EVENT_LOG_SQL}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as attempts at parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


ATTEMPTS_SQL = "att AS (SELECT l_partkey, o_orderdate, l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
STATE_SQL = f"""{ATTEMPTS_SQL},
st AS (SELECT l_partkey, sum(CASE WHEN k <= 10 AND o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / least(count(*), 10) AS a, count(*) AS reps FROM
 (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM att) GROUP BY l_partkey)"""


@query(f"WITH {STATE_SQL} SELECT l_partkey, a, reps FROM st")
def replay_concept_mastery(spark, sf_dir):
    order = [F.col(c).desc() for c in ("o_orderdate", "l_orderkey", "l_linenumber")]
    return log.concept_state(attempts(spark, sf_dir), ["l_partkey"], order, F.col("o_orderstatus") == "F")


@query(f"""WITH {ATTEMPTS_SQL} SELECT l_partkey, l_orderkey, l_linenumber, k FROM
 (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC) AS k FROM att) WHERE k <= 10""")
def last_n_window(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_partkey").orderBy(*[F.col(c).desc() for c in ("o_orderdate", "l_orderkey", "l_linenumber")])
    return attempts(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 10").select("l_partkey", "l_orderkey", "l_linenumber", "k")


@query(f"{EV} SELECT i, max(t) AS last_sec, count(*) AS reps FROM ev WHERE m <> 'flag' GROUP BY i")
def replay_item_state(spark, sf_dir):
    return log.item_state(event_log(spark, sf_dir))


@query(f"{EV} SELECT n, i FROM ev WHERE m <> 'flag'")
def answer_event_filter(spark, sf_dir):
    return log.answers_only(event_log(spark, sf_dir)).select("n", "i")


EXPLODED = f"""{EV}, {ITEM_BRIDGE_SQL}, x AS (SELECT concept, t, n, d, g FROM ev JOIN bridge ON ev.i = bridge.i WHERE m <> 'flag'),
r AS (SELECT concept, g, row_number() OVER (PARTITION BY concept ORDER BY t DESC, n DESC, d DESC) AS k FROM x),
cs AS (SELECT concept, sum(CASE WHEN k <= 10 AND g >= 2 THEN 1 ELSE 0 END)::DOUBLE / least(count(*), 10) AS a, count(*) AS reps FROM r GROUP BY concept)"""


@query(f"{EXPLODED} SELECT * FROM cs")
def join_item_concepts(spark, sf_dir):
    return log.replay(event_log(spark, sf_dir), item_bridge(spark, sf_dir))[1]


@query(f"{EV}, {ITEM_BRIDGE_SQL} SELECT ev.i, count(*) AS events, bool_or(b.i IS NOT NULL) AS known FROM ev LEFT JOIN (SELECT DISTINCT i FROM bridge) b ON ev.i = b.i WHERE m <> 'flag' GROUP BY ev.i")
def join_events_items(spark, sf_dir):
    known = item_bridge(spark, sf_dir).select("i").distinct().withColumn("k", F.lit(True))
    rows = log.answers_only(event_log(spark, sf_dir)).join(known, "i", "left")
    return rows.groupBy("i").agg(F.count("*").alias("events"), F.bool_or(F.col("k").isNotNull()).alias("known"))


MERGE = f"""{EV}, l AS (SELECT *, 0 AS s FROM ev WHERE n % 3 <> 0), r AS (SELECT d, n, i, t + 60 AS t, g, r, m, a, 1 AS s FROM ev WHERE n % 2 = 0 OR n % 3 = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY d, n ORDER BY s DESC) AS k FROM (SELECT * FROM l UNION ALL SELECT * FROM r)) SELECT d, n, i, t, g FROM u WHERE k = 1"""


def _two_logs(spark, sf_dir):
    """Two logs that overlap and together hold every event."""
    ev = event_log(spark, sf_dir)
    return ev.filter("n % 3 <> 0"), ev.filter("n % 2 = 0 OR n % 3 = 0").withColumn("t", F.col("t") + 60)


@query(MERGE)
def merge_events(spark, sf_dir):
    return log.merge_events(*_two_logs(spark, sf_dir)).select("d", "n", "i", "t", "g")


@query(MERGE)
def sink_events(spark, sf_dir):
    """Appends to a stored table: each log in two batches, one batch sent again, one put in again under a new number."""
    left, right = _two_logs(spark, sf_dir)
    store = EventStore(spark, shared_folder(spark, "events"), left.schema, most_deltas=3)
    for writer, events in (("left", left), ("right", right)):
        for batch in (0, 1):
            store.append(events.filter(F.col("n") % 2 == batch), writer, batch)
    store.append(right.filter("n % 2 = 1"), "right", 1)
    store.append(right.filter("n % 2 = 0"), "right", 2)
    return store.read().select("d", "n", "i", "t", "g")


@query(f"{EV} SELECT d, n, t, row_number() OVER (ORDER BY t, n, d) AS place FROM ev")
def read_events(spark, sf_dir):
    """All events of a stored table in their order, which a number gives."""
    store = EventStore(spark, shared_folder(spark, "events"), event_log(spark, sf_dir).schema)
    store.append(event_log(spark, sf_dir), "log", 0)
    return log.numbered(store.read(), None, ["t", "n", "d"], "place").select("d", "n", "t", "place")


@query(f"{EV} SELECT i, n, coalesce(lag(n) OVER (PARTITION BY i ORDER BY t, n, d), -1) AS before FROM ev")
def order_events(spark, sf_dir):
    ev = event_log(spark, sf_dir).select("i", "n", "t", "d")
    return log.previous(ev, "i", ["t", "n", "d"], "n", "before").select("i", "n", F.coalesce("before", F.lit(-1)).alias("before"))


@query(f"{EV} SELECT d, n, i, t, g, r, m FROM ev")
def export_import(spark, sf_dir):
    ev = event_log(spark, sf_dir)
    back = log.imported(log.exported(ev, ["i"]), ev.drop("a"))
    return back.select("d", "n", "i", "t", "g", "r", "m")


@query(f"{EV} SELECT i, max(t) AS flagged_at FROM ev WHERE m = 'flag' GROUP BY i")
def flag_last(spark, sf_dir):
    return log.last_flags(event_log(spark, sf_dir))


@query(f"""{EV}, f AS (SELECT i, max(t) AS t FROM ev WHERE m = 'flag' GROUP BY i)
SELECT f.i, strftime(make_timestamp(f.t * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS flagged_at, c_name AS name FROM f LEFT JOIN customer ON f.i = 'item' || CAST(c_custkey AS VARCHAR) AND c_custkey % 2 = 0""")
def join_flag_items(spark, sf_dir):
    items = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("item"), F.col("c_custkey").cast("string")).alias("i"), F.col("c_name").alias("name"))
    return mastery.flagged_items(log.last_flags(event_log(spark, sf_dir)), items, "i")


@query(f"""{EV}, f AS (SELECT i, a, arg_min((t, n, d), (t, n, d)) AS at_ FROM ev WHERE coalesce(a, '') <> '' GROUP BY i, a), k AS (SELECT i, a, row_number() OVER (PARTITION BY i ORDER BY at_) AS k FROM f)
SELECT i, (k - 1) // 1000 AS chunk, string_agg(a, '|' ORDER BY k) AS alternatives FROM k GROUP BY 1, 2""")
def user_alternatives(spark, sf_dir):
    listed = mastery.listed(log.user_alternatives(event_log(spark, sf_dir)), "i", ["at"], F.col("a"), "alternatives")
    return listed.select("i", "chunk", F.array_join("alternatives", "|").alias("alternatives"))


@query(f"{EV} SELECT d, coalesce(max(n), -1) AS max_n FROM ev GROUP BY d")
def max_seq(spark, sf_dir):
    return log.max_seq(event_log(spark, sf_dir))


@query("SELECT event_type, coalesce(median(coalesce(value, 0.0)), 0) AS median_r FROM events GROUP BY event_type")
def median_rt(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", F.coalesce("value", F.lit(0.0)).alias("r"))
    return log.median_rt(ev, ["event_type"])


@query(f"{EV} SELECT d, coalesce(median(r), 0) AS median_r FROM ev WHERE m <> 'flag' GROUP BY d")
def median_rt_clean(spark, sf_dir):
    return log.median_rt(log.answers_only(event_log(spark, sf_dir)), ["d"])


@query("""WITH m AS (SELECT event_type, median(coalesce(value, 0.0)) AS med FROM events GROUP BY 1)
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 WHEN user_id % 7 = 0 THEN 2 WHEN coalesce(med, 0) = 0 THEN 3 WHEN coalesce(value, 0.0) < 0.6 * med THEN 4 WHEN coalesce(value, 0.0) > 2 * med THEN 2 ELSE 3 END AS grade FROM events JOIN m USING (event_type)""")
def grade_answer(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("r", F.coalesce("value", F.lit(0.0)))
    med = log.median_rt(ev, ["event_type"])
    grade = C.grade(F.col("event_type") != "error", F.col("user_id") % 7 == 0, F.col("r"), F.col("median_r"))
    return ev.join(med, "event_type").select("event_id", grade.alias("grade"))


@query("SELECT 'dev' AS d, row_number() OVER (ORDER BY c_custkey, pos) + 100 AS n, c_custkey AS i, 0::BIGINT AS t, 3 AS g, a FROM (SELECT c_custkey, generate_subscripts(l, 1) AS pos, unnest(l) AS a FROM (SELECT c_custkey, [c_mktsegment, c_name] AS l FROM customer))")
def migrate_alts(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.array("c_mktsegment", "c_name").alias("alts"))
    return log.migrate_alternatives(old, "dev", 100).select("d", "n", "i", "t", "g", "a")


SCOPED = f"WITH {STATE_SQL}, sc AS (SELECT p_partkey, p_type, p_brand, p_size, coalesce(a, 0.0) AS a, coalesce(reps, 0) AS reps FROM part LEFT JOIN st ON p_partkey = l_partkey AND l_partkey % 3 <> 0)"


def _scoped(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    state = replay_concept_mastery(spark, sf_dir).filter("l_partkey % 3 <> 0").withColumnRenamed("l_partkey", "p_partkey")
    return mastery.scope_state(part, state, "p_partkey")


@query(f"{SCOPED} SELECT p_partkey, a, reps FROM sc")
def join_scope_state(spark, sf_dir):
    return _scoped(spark, sf_dir).select("p_partkey", "a", "reps")


@query(f"{SCOPED} SELECT p_partkey, a FROM sc")
def concept_default(spark, sf_dir):
    return _scoped(spark, sf_dir).select("p_partkey", "a")


SKILL_SQL = """CASE WHEN ends_with(c, ':reading') THEN 'reading' WHEN ends_with(c, ':group') THEN 'change' WHEN starts_with(c, 'r:') THEN 'change' WHEN starts_with(c, 'w:') THEN 'word'
 WHEN starts_with(c, 'p:') THEN 'particle' WHEN starts_with(c, 'g:') THEN 'pattern' WHEN starts_with(c, 'c:') OR starts_with(c, 'n:') THEN 'quantity' END"""
CONCEPT_SQL = "CASE p_size % 8 WHEN 0 THEN 'w:' WHEN 1 THEN 'r:' WHEN 2 THEN 'p:' WHEN 3 THEN 'g:' WHEN 4 THEN 'c:' WHEN 5 THEN 'x:' ELSE 'w:' END || p_brand || CASE WHEN p_size % 8 = 6 THEN ':reading' WHEN p_size % 8 = 7 THEN ':group' ELSE '' END"


def _concept():
    kind = F.col("p_size") % 8
    prefix = F.when(kind == 1, "r:").when(kind == 2, "p:").when(kind == 3, "g:").when(kind == 4, "c:").when(kind == 5, "x:").otherwise("w:")
    return F.concat(prefix, F.col("p_brand"), F.when(kind == 6, ":reading").when(kind == 7, ":group").otherwise(""))


@query(f"SELECT p_partkey, c AS concept, {SKILL_SQL} AS skill FROM (SELECT p_partkey, {CONCEPT_SQL} AS c FROM part)")
def skill_of(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("concept", _concept()).select("p_partkey", "concept", C.skill_of(F.col("concept")).alias("skill"))


@query(f"""{SCOPED}, k AS (SELECT {SKILL_SQL} AS skill, a, reps FROM (SELECT *, {CONCEPT_SQL} AS c FROM sc)),
s AS (SELECT skill, sum(a * 360360) AS s, count(*) AS total, count(*) FILTER (WHERE reps > 0) AS practiced FROM k WHERE skill IS NOT NULL GROUP BY skill)
SELECT v.skill, round(s / 360360 / total, 9) AS score, coalesce(practiced, 0) AS practiced, coalesce(total, 0) AS total FROM (VALUES ('word'), ('reading'), ('change'), ('particle'), ('pattern'), ('quantity'), ('unused')) v(skill) LEFT JOIN s ON v.skill = s.skill""")
def aggregate_skills(spark, sf_dir):
    skills = spark.createDataFrame([(s,) for s in (*C.SKILLS, "unused")], "skill string")
    return mastery.aggregate_skills(_scoped(spark, sf_dir), C.skill_of(_concept()), skills).withColumn("score", F.round("score", 9))


@query(f"SELECT DISTINCT {CONCEPT_SQL} AS concept FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 25")
def scope_concepts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_partkey")
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(_concept().alias("concept")).distinct()


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND p_retailprice <= 1500 AND list_has_any([p_brand, p_type], ['Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#34'])")
def scope_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return mastery.scope_filter(part, F.col("p_size"), F.col("p_retailprice"), F.array("p_brand", "p_type"), ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#34"], 5, 1500).select("p_partkey")


@query("SELECT doc_id, 'w' AS engine FROM documents WHERE lang = 'en' UNION ALL SELECT conv_id * 1000 + turn, 'c' FROM conversations WHERE role = 'user'")
def engine_filter(spark, sf_dir):
    """Only enabled generators are in the union; one that is off is not planned at all."""
    made = {
        "w": lambda: table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.lit("w").alias("engine")),
        "c": lambda: table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit("c").alias("engine")),
        "p": lambda: table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("p").alias("engine")),
    }
    return C.union_enabled(made, ["w", "c"])


@query("SELECT p_partkey AS id, p_brand AS label, -1::BIGINT AS amount FROM part UNION ALL SELECT l_orderkey, NULL, CAST(l_linenumber AS BIGINT) FROM lineitem")
def union_items(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("amount"))
    return part.unionByName(lines, allowMissingColumns=True).fillna(-1, ["amount"])


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 0 THEN 'low' END, lang) AS label, coalesce(CAST(toxic AS INTEGER), 1) AS requires FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_lookup(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("quality") == 0, "low"), "lang").alias("label"), F.coalesce(F.col("toxic").cast("int"), F.lit(1)).alias("requires"))


FIXED = """WITH i AS (SELECT doc_id, lang AS answer, source AS prompt, [lang, source] AS alts FROM documents), f AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' END AS fa, CASE WHEN quality = 0 THEN 'bad' END AS fp, CASE WHEN quality = 1 THEN ['en', 'good'] END AS fl FROM labels)
SELECT i.doc_id, coalesce(fa, answer) AS answer, coalesce(fp, prompt) AS prompt, array_to_string(CASE WHEN fl IS NULL THEN alts WHEN answer = 'en' THEN [answer, prompt, 'good'] ELSE [answer, prompt, 'en', 'good'] END, '|') AS alternatives FROM i LEFT JOIN f ON i.doc_id = f.doc_id"""


@query(FIXED)
def join_corrections(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("answer"), F.col("source").alias("prompt"), F.array("lang", "source").alias("alternatives"))
    fixes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("fix_answer"), F.when(F.col("quality") == 0, "bad").alias("fix_prompt"), F.when(F.col("quality") == 1, F.array(F.lit("en"), F.lit("good"))).alias("fix_alternatives"))
    return mastery.apply_corrections(items, fixes, "doc_id").withColumn("alternatives", F.array_join("alternatives", "|"))


@query(f"""{EV}, f AS (SELECT i, a, arg_min((t, n, d), (t, n, d)) AS at_ FROM ev WHERE coalesce(a, '') NOT IN ('', 'view1') GROUP BY i, a), k AS (SELECT i, a, row_number() OVER (PARTITION BY i ORDER BY at_) AS k FROM f),
u AS (SELECT i, (k - 1) // 1000 AS chunk, string_agg(a, '|' ORDER BY k) AS s FROM k GROUP BY 1, 2)
SELECT c_custkey, coalesce(chunk, 0) AS chunk, CASE WHEN coalesce(chunk, 0) = 0 THEN 'view1' || coalesce('|' || s, '') ELSE s END AS alternatives FROM customer LEFT JOIN u ON u.i = 'item' || CAST(c_custkey AS VARCHAR)""")
def join_user_alts(spark, sf_dir):
    """An item's own answers, then those that users added, a bounded number to a row."""
    items = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("item"), F.col("c_custkey").cast("string")).alias("i"), F.array(F.lit("view1")).alias("own"))
    added = log.user_alternatives(event_log(spark, sf_dir)).join(items, "i").filter(~F.array_contains("own", F.col("a")))
    both = items.join(mastery.listed(added, "i", ["at"], F.col("a"), "alternatives"), "i", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    more = F.coalesce("alternatives", F.array().cast("array<string>"))
    return both.select("c_custkey", "chunk", F.array_join(F.when(F.col("chunk") == 0, F.concat("own", more)).otherwise(more), "|").alias("alternatives"))


@query("SELECT doc_id, CASE WHEN lang = source THEN lang WHEN lang = 'en' THEN lang || '|' || source ELSE lang || '|' || source || '|en' END AS alts FROM documents")
def union_alts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_union(F.array("lang", "source"), F.array(F.lit("en"), F.col("source"))), "|").alias("alts"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS k FROM documents) WHERE k = 1")
def first_per_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return mastery.first_per_key(docs, ["lang", "source"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name || CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN ':L' || CAST(p_size AS VARCHAR) ELSE '' END AS key FROM part")
def kana_collision(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return part.select("p_partkey", mastery.collision_suffix(part, "p_name", F.concat(F.lit("L"), F.col("p_size").cast("string"))).alias("key"))


@query("SELECT p_brand AS lesson, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS pool FROM part GROUP BY 1")
def gloss_pool(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("lesson")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("pool"))


@query("SELECT e AS element, (k - 1) // 1000 AS chunk, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY p_partkey) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY p_partkey) AS k FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS e FROM part)) GROUP BY 1, 2")
def invert_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("names"))
    return mastery.inverted(part, "names", F.col("p_partkey")).select("element", "chunk", F.array_join("keys", "|").alias("keys"))


@query("WITH p AS (SELECT e, (k - 1) // 1000 AS chunk, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY p_partkey) AS ks FROM (SELECT p_partkey, p_brand AS e, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size > 40) GROUP BY 1, 2) SELECT b AS pattern, coalesce(chunk, 0) AS chunk, coalesce(ks, 'g:' || b) AS concepts FROM (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN p ON b = e")
def join_pattern_concepts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    told = mastery.inverted(part.filter("p_size > 40").withColumn("names", F.array("p_brand")), "names", F.col("p_partkey")).withColumnRenamed("element", "pattern")
    return part.select(F.col("p_brand").alias("pattern")).distinct().join(told, "pattern", "left").select("pattern", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce(F.array_join("keys", "|"), F.concat(F.lit("g:"), F.col("pattern"))).alias("concepts"))


@query("SELECT base, CASE WHEN n = 1 THEN ks END AS auto, CASE WHEN n > 1 THEN ks END AS ambiguous FROM (SELECT source || '-' || n_chars % 100 AS base, count(DISTINCT lang) AS n, string_agg(DISTINCT lang, '|' ORDER BY lang) AS ks FROM documents GROUP BY 1)")
def lexicon_build(spark, sf_dir):
    """Readings (languages) of words (sources with two digits of the length): some have one, some several."""
    base = F.concat("source", F.lit("-"), (F.col("n_chars") % 100).cast("string")).alias("base")
    return mastery.lexicon(table(spark, sf_dir, "documents").select(base, F.col("lang").alias("kana")))


@query("WITH a AS (SELECT p_brand AS base, min(p_type) AS k FROM part WHERE p_size < 30 GROUP BY 1), m AS (SELECT p_brand AS base, max(p_type) AS k FROM part WHERE p_size > 45 GROUP BY 1) SELECT coalesce(a.base, m.base) AS base, coalesce(m.k, a.k) AS kana FROM a FULL JOIN m ON a.base = m.base")
def lexicon_overlay(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "base")
    auto = part.filter("p_size < 30").groupBy("base").agg(F.min("p_type").alias("kana"))
    return mastery.overlay(auto, part.filter("p_size > 45").groupBy("base").agg(F.max("p_type").alias("kana")))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def lesson_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, sum(CASE WHEN source IN ('src0', 'src1') THEN n_chars ELSE 0 END)::DOUBLE / sum(n_chars) AS rate FROM documents GROUP BY lang")
def coverage_rate(spark, sf_dir):
    covered = F.sum(F.when(F.col("source").isin("src0", "src1"), F.col("n_chars")).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("lang").agg((covered / F.sum("n_chars")).alias("rate"))


RANKED = f"""{EXPLODED}, its AS (SELECT i, max(t) AS last_sec FROM ev WHERE m <> 'flag' AND n % 4 <> 0 GROUP BY i),
la AS (SELECT b.i, min(coalesce(cs.a, 0.0)) AS la FROM bridge b LEFT JOIN cs ON b.concept = cs.concept GROUP BY 1),
dd AS (SELECT la.i, la, last_sec, greatest(0.0, ({NOW} - last_sec) / 86400.0) AS days FROM la LEFT JOIN its ON la.i = its.i),
rk AS (SELECT i, (1 - la) + CASE WHEN last_sec IS NULL OR days <= 0 THEN 0.0 ELSE days / (days + 7.0) END AS w, last_sec IS NULL AS is_new FROM dd),
bk AS (SELECT i, w, CASE WHEN w >= 1.0 THEN 'high' WHEN w >= 0.4 THEN 'mid' ELSE 'low' END AS bucket, is_new FROM rk)"""


def _ranked(spark, sf_dir):
    ev, bridge = event_log(spark, sf_dir), item_bridge(spark, sf_dir)
    return schedule.priorities(bridge, log.replay(ev, bridge)[1], log.item_state(ev.filter("n % 4 <> 0")), NOW)


@query(f"{RANKED} SELECT i, round(w, 9) AS w, is_new FROM bk")
def priority(spark, sf_dir):
    return _ranked(spark, sf_dir).select("i", F.round("w", 9).alias("w"), "is_new")


@query(f"{EV} SELECT n, round(CASE WHEN t >= {NOW} THEN 0.0 ELSE (({NOW} - t) / 86400.0) / (({NOW} - t) / 86400.0 + 7.0) END, 9) AS f FROM ev")
def time_factor(spark, sf_dir):
    return event_log(spark, sf_dir).select("n", F.round(schedule.time_factor(schedule.days_since(F.col("t"), NOW)), 9).alias("f"))


@query(f"{EV} SELECT n, round(greatest(0.0, ({NOW} - t) / 86400.0), 6) AS days FROM ev")
def days_since(spark, sf_dir):
    return event_log(spark, sf_dir).select("n", F.round(schedule.days_since(F.col("t"), NOW), 6).alias("days"))


@query(f"{RANKED} SELECT bucket, count(*) AS n FROM bk GROUP BY bucket")
def bucket(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"{RANKED} SELECT i, bucket FROM bk WHERE bucket <> 'low' OR (SELECT count(*) FROM bk WHERE bucket <> 'low') < {COUNT}")
def candidate_pool(spark, sf_dir):
    return schedule.candidate_pool(_ranked(spark, sf_dir), COUNT).select("i", "bucket")


U_SQL = "((CAST(substr(i, 5) AS BIGINT) * 1103515245 + 12345) % 2147483648 + 1) / 2147483649.0"


def _u():
    return ((F.substring("i", 5, 20).cast("bigint") * 1103515245 + 12345) % 2147483648 + 1) / F.lit(2147483649.0)


PICK = f"""{RANKED}, pl AS (SELECT * FROM bk WHERE bucket <> 'low' OR (SELECT count(*) FROM bk WHERE bucket <> 'low') < {COUNT}),
ky AS (SELECT i, is_new, -ln({U_SQL}) / (greatest(1e-6, w) * CASE WHEN ends_with(i, '7') THEN 0.05 ELSE 1.0 END) AS k FROM pl),
nr AS (SELECT *, row_number() OVER (PARTITION BY is_new ORDER BY k, i) AS r FROM ky)
SELECT i, is_new FROM nr ORDER BY is_new AND r > {int(0.3 * COUNT)}, k, i LIMIT {COUNT}"""


@query(PICK)
def pick_items(spark, sf_dir):
    pool = schedule.candidate_pool(_ranked(spark, sf_dir), COUNT)
    return schedule.pick_items(pool, COUNT, _u(), F.col("i").endswith("7")).select("i", "is_new")


@query(f"{RANKED} SELECT i FROM bk ORDER BY -ln({U_SQL}) / greatest(1e-6, w), i LIMIT {COUNT}")
def weighted_pick(spark, sf_dir):
    return _ranked(spark, sf_dir).orderBy(schedule.draw_key(F.col("w"), _u()), "i").limit(COUNT).select("i")


@query(f"{RANKED} SELECT i FROM bk ORDER BY -ln({U_SQL}) / greatest(1e-6, pow(greatest(0.0, w), 2.0)), i LIMIT 1")
def pick_playback(spark, sf_dir):
    return schedule.pick_playback(_ranked(spark, sf_dir), 2.0, _u()).select("i")


@query("SELECT l_partkey, (k - 1) // 1000 AS chunk, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY k) AS orders FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size = 1) GROUP BY 1, 2")
def join_vocab_verbs(spark, sf_dir):
    """Inner join with a dimension: lines of unlisted parts drop out."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    some = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    kept = mastery.listed(lines.join(some, "l_partkey"), "l_partkey", ["l_orderkey", "l_linenumber"], F.col("l_orderkey").cast("string"), "orders")
    return kept.withColumn("orders", F.array_join("orders", ","))


@query("SELECT n, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM (SELECT event_id AS n, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)")
def date_functions(spark, sf_dir):
    from tidemark.functions.text import iso_time

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), iso_time(epoch("ts")).alias("iso"))
