"""Operators against plain sequential versions and hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import concepts as C
from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import checks, items, layout, log, mastery, schedule
from tidemark.plans import stream_queries

EVENTS = "d string, n long, i string, t long, g int, r double, m string, a string"


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def ev(spark, rows):
    return spark.createDataFrame([(d, n, i, t, g, 0.0, m, a) for d, n, i, t, g, m, a in rows], EVENTS)


def test_replay_equals_fold(spark):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(3)}", k, f"i{rng.randrange(6)}", rng.randrange(40), rng.randrange(1, 5), rng.choice(["text", "text", "flag"]), None) for k in range(400)]
    covers = {f"i{k}": [f"c{k % 3}", "all", "all"] for k in range(5)}
    bridge = spark.createDataFrame(list(covers.items()), "i string, covers array<string>")
    state, concepts = log.replay(ev(spark, rows), bridge)
    queue, reps, last, seen = {}, {}, {}, {}
    for d, n, i, t, g, m, _ in sorted(rows, key=lambda r: (r[3], r[1], r[0])):
        if m == "flag":
            continue
        last[i], seen[i] = t, seen.get(i, 0) + 1
        for c in covers.get(i, []):
            queue[c] = (queue.get(c, []) + [g >= 2])[-10:]
            reps[c] = reps.get(c, 0) + 1
    assert {r["i"]: (r["last_sec"], r["reps"]) for r in state.collect()} == {i: (last[i], seen[i]) for i in last}
    assert {r["concept"]: (r["a"], r["reps"]) for r in concepts.collect()} == {c: (sum(q) / len(q), reps[c]) for c, q in queue.items()}


def test_log_basics(spark):
    a = ev(spark, [("x", 1, "p", 10, 3, "text", None), ("x", 2, "p", 20, 1, "text", "alt"), ("y", 1, "q", 5, 0, "flag", None)])
    b = ev(spark, [("x", 1, "p", 99, 4, "text", None)])
    merged = log.merge_events(a, b)
    assert sorted((r["d"], r["n"], r["t"]) for r in merged.collect()) == [("x", 1, 99), ("x", 2, 20), ("y", 1, 5)]
    assert log.merge_events(merged, b).count() == 3
    assert log.imported(log.exported(a, ["d"]), a.drop("a")).count() == 3
    assert [tuple(r) for r in log.last_flags(a).collect()] == [("q", 5)]
    assert [(r["i"], r["a"]) for r in log.user_alternatives(a).collect()] == [("p", "alt")]
    assert log.median_rt(a.filter("false"), ["d"]).count() == 0
    old = spark.createDataFrame([("z", ["b", "a"])], "i string, alts array<string>")
    assert [(r["n"], r["a"], r["t"], r["g"]) for r in log.migrate_alternatives(old, "dev", 7).orderBy("n").collect()] == [(8, "b", 0, 3), (9, "a", 0, 3)]


@pytest.mark.parametrize(("a", "days", "w", "bucket"), [(0.0, 30, 1.81, "high"), (None, None, 1.0, "high"), (0.0, 0, 1.0, "high"), (0.5, 7, 1.0, "high"), (1.0, 30, 0.81, "mid"), (1.0, 0, 0.0, "low")])
def test_priority_scenarios(spark, a, days, w, bucket):
    now = 1000 * 86400
    last = F.lit(None).cast("bigint") if days is None else F.lit(now - days * 86400)
    p = schedule.priority(F.lit(a).cast("double"), last, now)
    r = one(spark, F.round(p, 2).alias("w"), schedule.bucket(p).alias("b"))
    assert (r["w"], r["b"]) == (w, bucket)


def test_pick_items_quota_and_pool(spark):
    rows = [(f"i{k}", 1.0 if k < 12 else 0.1, k % 2 == 0) for k in range(20)]
    ranked = spark.createDataFrame(rows, "i string, w double, is_new boolean").withColumn("bucket", schedule.bucket(F.col("w")))
    assert schedule.candidate_pool(ranked, 10).count() == 12 and schedule.candidate_pool(ranked, 15).count() == 20
    u = (F.pmod(F.xxhash64("i"), F.lit(1000)) + 1) / 1002
    got = schedule.pick_items(schedule.candidate_pool(ranked, 10), 10, u).collect()
    assert len(got) == 10 and sum(r["is_new"] for r in got) == 4  # three new ones, six old ones, and one more new to fill
    weak = sum(schedule.pick_playback(spark.createDataFrame([("a", 0.2), ("b", 1.8)], "i string, w double"), 1.0, (F.pmod(F.xxhash64("i", F.lit(s)), F.lit(9973)) + 1) / 9975).head()["i"] == "b" for s in range(20))
    assert weak > 12


def test_aggregate_skills(spark):
    scope = spark.createDataFrame([(f"w:{k}", 1.0 if k < 2 else 0.0, int(k < 2)) for k in range(10)] + [("x:odd", 1.0, 1)], "c string, a double, reps long")
    skills = spark.createDataFrame([("word",), ("reading",)], "skill string")
    assert sorted(map(tuple, mastery.aggregate_skills(scope, C.skill_of(F.col("c")), skills).collect())) == [("reading", None, 0, 0), ("word", 0.2, 2, 10)]


def test_corrections_keep_empty_text(spark):
    it = spark.createDataFrame([(1, "a", "p", ["x"]), (2, "b", "q", ["y"])], "id int, answer string, prompt string, alternatives array<string>")
    fx = spark.createDataFrame([(1, "", None, ["x", "z"])], "id int, fix_answer string, fix_prompt string, fix_alternatives array<string>")
    assert sorted(map(tuple, mastery.apply_corrections(it, fx, "id").collect())) == [(1, "", "p", ["x", "z"]), (2, "b", "q", ["y"])]


def test_text(spark):
    r = one(
        spark,
        T.normalize_answer(F.lit("　カタ カナ１２！。．")).alias("n"),
        T.is_correct(F.lit(" "), F.lit(""), F.array(F.lit(" "))).alias("empty"),
        T.seeded_hash(F.lit("")).alias("h0"),
        T.seeded_hash(F.lit("a")).alias("ha"),
        T.short_gloss(F.lit("（only）")).alias("g1"),
        T.short_gloss(F.lit("他（彼）")).alias("g2"),
        T.is_pure_punctuation(F.lit(" ")).alias("blank"),
        T.iso_time(F.lit(0)).alias("iso"),
        T.marks_apply_cleanly(F.lit("日本"), F.array(F.struct(F.lit(1).alias("at"), F.lit("日").alias("base")))).alias("clean"),
    )
    assert tuple(r) == ("かたかな12!", False, 2166136261, 0xE40C292C, "（only）", "他", False, "1970-01-01T00:00:00.000Z", False)


def test_rules(spark):
    got = one(spark, *[R.read_number(F.lit(n)) for n in (1, 10, 300, 8600, 9999, 0)], R.read_hour(F.lit(4)), R.read_hour(F.lit(13)), *[R.read_minute(F.lit(n)) for n in (3, 10, 14, 20, 30)], R.read_day(F.lit(20)), R.read_day(F.lit(11)), R.read_counter(F.lit(3), F.lit("hon")), R.read_counter(F.lit(4), F.lit("nin")), R.read_counter(F.lit(3), F.lit("kai_floor")), R.read_counter(F.lit(11), F.lit("hon")))
    assert tuple(got) == ("いち", "じゅう", "さんびゃく", "はっせんろっぴゃく", "きゅうせんきゅうひゃくきゅうじゅうきゅう", None, "よじ", None, "さんぷん", "じゅっぷん", "じゅうよんぷん", "にじゅっぷん", "さんじゅっぷん", "はつか", "じゅういちにち", "さんぼん", "よにん", "さんがい", None)
    verbs = [("かきます", "I", "te"), ("行きます", "I", "te"), ("たべます", "II", "te"), ("します", "III", "masen"), ("たべる", "II", "te"), ("かえます", "I", "te")]
    assert list(one(spark, *[R.conjugate(*map(F.lit, v)) for v in verbs])) == ["かいて", "行って", "たべて", "しません", None, None]
    adjectives = [("いい", "i", "past"), ("いい", "i", "plain"), ("静か", "na", "neg"), ("静か", "i", "neg")]
    assert list(one(spark, *[R.conjugate_adjective(*map(F.lit, v)) for v in adjectives])) == ["よかったです", "いいです", "静かじゃありません", None]


def plain_shuffle(values, seed):
    values = list(values)
    for i in range(len(values) - 1, 0, -1):
        seed = (seed * 1103515245 + 12345) % 2**32
        j = seed % (i + 1)
        values[i], values[j] = values[j], values[i]
    return values


def test_seeded_shuffle(spark):
    for n in range(7):
        values = [f"v{k}" for k in range(n)]
        column = F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
        assert one(spark, items.seeded_shuffle(column, F.lit(4000000000 + n)))[0] == plain_shuffle(values, 4000000000 + n)


def test_recall_choices(spark):
    words = [(1, k, f"kana{k // 2}", "" if k % 2 else f"漢{k}", f"gloss{k}（note）") for k in range(8)] + [(2, 1, "x", None, "alone"), (2, 2, "", None, "none")]
    got = items.recall(spark.createDataFrame(words, "lesson int, no int, kana string, kanji string, zh string")).collect()
    assert len({r["id"] for r in got}) == len(got) == 8 + 4 + 8 + 1
    for r in got:
        if r["choices"]:
            assert len(set(r["choices"])) == 4 and r["answer"] in r["choices"]


def test_line_cluster_is_anchored(spark):
    rows = spark.createDataFrame([(1, 100.0, 1), (1, 98.5, 2), (1, 97.0, 3), (2, 5.0, 1)], "page int, y double, seq long")
    assert sorted(map(tuple, layout.line_cluster(rows, ["page"], "y", "seq").collect())) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1)]


def test_folds(spark):
    rows = spark.createDataFrame([(1, p, n) for p, n in enumerate([2, 1, 3, 2, 5, 3, None])], "page int, place long, number long")
    assert sorted(map(tuple, layout.contiguous_numbering(rows, ["page"], "place", "number").collect())) == [(1, 1, 1), (1, 3, 2), (1, 5, 3)]
    rows = spark.createDataFrame([(1, k, kind, text) for k, (kind, text) in enumerate([("more", "-"), ("entry", "a"), ("more", "b"), ("other", "x"), ("more", "c"), ("entry", "d")])], "page int, place long, kind string, text string")
    assert sorted(map(tuple, layout.continuation_append(rows, ["page"], "place", "kind", "text").collect())) == [(1, 1, "ab"), (1, 5, "d")]


def test_nested_fragments(spark):
    """Fragments inside others, two levels down, and two that begin at one place."""
    from tidemark.operators import tables

    rows = [(1, 1, "AAAA", 0.0), (1, 2, "bbb", 2.5), (1, 3, "c", 3.0), (2, 1, "xy", 0.0), (2, 2, "zw", 0.0), (3, 1, "", 1.0), (3, 2, "ok", 1.0)]
    got = tables.line_text(spark.createDataFrame(rows, "page int, seq int, text string, x double").withColumn("size", F.lit(2.0)), ["page"], "seq", "text", "x", "size")
    assert sorted(map(tuple, got.collect())) == [(1, "AAAbcbbA"), (2, "xyzw"), (3, "ok")]


def test_nested_fragments_are_moved_once(spark):
    """Random lines as a plain recursion sets them; fragments are dealt out once, whole, not as characters with their paths."""
    import random

    from tidemark.operators import tables

    rng = random.Random(4)
    lines = {k: [(n, "".join(rng.choice("abか") for _ in range(rng.randrange(9))), float(rng.randrange(25))) for n in range(rng.randrange(1, 12))] for k in range(150)}
    width = lambda c: 1.0 if ord(c) < 256 else 2.0

    def said(f):
        end = lambda r: r[2] + sum(map(width, r[1]))
        host = {r[0]: min(((end(h) - h[2], h[0]) for h in f if h[2] < r[2] < end(h)), default=(0, None))[1] for r in f}

        def whole(r):
            out, kids = "", sorted((k for k in f if host[k[0]] == r[0]), key=lambda k: (k[2], k[0]))
            for i, c in enumerate(r[1]):
                at = r[2] + sum(map(width, r[1][:i]))
                while kids and kids[0][2] <= at:
                    out += whole(kids.pop(0))
                out += c
            return out + "".join(map(whole, kids))

        return "".join(whole(r) for r in sorted(f, key=lambda r: (r[2], r[0])) if host[r[0]] is None)

    rows = [(k, *r) for k, f in lines.items() for r in f] + [(None, 0, "aaaa", 0.0), (None, 1, "b", 1.5), (1000, 0, None, 0.0)]
    got = tables.line_text(spark.createDataFrame(rows, "page int, seq int, text string, x double").withColumn("size", F.lit(2.0)), ["page"], "seq", "text", "x", "size")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    assert dict(got.collect()) == {k: t for k, f in lines.items() if (t := said(f))} | {None: "aaaab"}


def test_segments_and_example_lines(spark):
    from tidemark.operators import tables

    rows = spark.createDataFrame([(1, 1, "ab  c ", 0.0), (1, 2, "d", 30.0), (1, 3, " e", 60.0), (2, 1, "   ", 0.0)], "line int, seq int, text string, x double").withColumn("size", F.lit(10.0))
    assert sorted(map(tuple, tables.fine_segments(rows, ["line"], "seq", "text", "x", "size").collect())) == [(1, 0, 0.0, "ab"), (1, 1, 20.0, "c d"), (1, 2, 60.0, "e")]
    lines = [(1, 1, " ", 0.0), (1, 2, "① これ", 9.0), (1, 3, "这个", 99.0), (2, 1, "这个", 0.0), (2, 2, "①", 50.0), (3, 1, "これ", 0.0), (3, 2, "それ", 90.0), (4, 1, "か", 0.0)]
    made = tables.split_example_line(spark.createDataFrame(lines, "line int, seq int, text string, x double").withColumn("size", F.lit(10.0)), ["line"], "seq", "text", "x", "size", True)
    assert sorted(map(tuple, made.collect())) == [(1, "これ", "这个"), (2, "", "这个①"), (3, "これそれ", ""), (4, "か", "")]


def test_rows_of_tables(spark):
    from tidemark.operators import tables

    cells = "array<array<struct<x:double,text:string>>>"
    rows = [(1, 1, [[(10.0, "a")], [(100.0, "b")]]), (1, 2, [[(12.0, "a"), (95.0, "b")], []]), (1, 3, [[(11.0, "a"), (40.0, "a2")], []]), (2, 1, [[], []])]
    out = tables.redistribute_slots(spark.createDataFrame(rows, f"tab int, row int, cells {cells}"), ["tab"], "row", "cells", F.array(F.lit(10.0), F.lit(100.0)), F.array(F.lit(1)))
    assert sorted((r["tab"], r["row"], [[s["text"] for s in c] for c in r["cells"]]) for r in out.collect()) == [(1, 1, [["a"], ["b"]]), (1, 2, [["a"], ["b"]]), (1, 3, [["a", "a2"], []]), (2, 1, [[], []])]
    forms = [(1, 1, ["t", "i", "d", "t", "k", "d"]), (1, 2, ["o", "i", "d", "o", "k", "d"]), (1, 3, ["i", "i", "d", "y", "k", "d"]), (1, 4, ["alone"])]
    out = tables.conjugation_forms(spark.createDataFrame(forms, "tab int, row int, texts array<string>"), ["tab"], "row", "texts")
    assert sorted((r["row"], r["forms"]) for r in out.collect()) == [(1, ["tid", "tkd"]), (2, ["oid", "okd"]), (3, ["iid", "ykd"])]
    ask = lambda values, start: one(spark, tables.reconstruct_question(F.array(*map(F.lit, ["本屋は", "えきの", "ちかく", "に", "あります。"])), F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.lit(start), F.array(F.lit(1), F.lit(2))))[0]
    assert ask({1: "どこ"}, 3) == "本屋はどこにありますか。" and ask({2: "どこ"}, 3) == "本屋はえきのどこにありますか。" and ask({1: "どこ"}, None) is None


def test_numbering_in_ranges(spark):
    rows = spark.createDataFrame([(("a", "b", None)[k % 3], 1000 - k, k) for k in range(300)], "d string, t int, n int")
    got = log.numbered(rows, "d", ["t", "n"], "place", per_range=2).collect()
    assert all(r["place"] == 1 + sum(1 for q in got if q["d"] == r["d"] and q["t"] < r["t"]) for r in got) and len(got) == 300


def test_looking_back_in_ranges(spark):
    """One key holds a third of the rows and more; ranges are cut anywhere."""
    rows = spark.createDataFrame([("hot" if k % 3 else f"k{k % 7}", (k * 37) % 1000, k, None if k % 5 == 0 else k) for k in range(600)] + [(None, 5, 1000, 1), (None, 6, 1001, 2)], "i string, t int, n int, v int")
    held = rows.collect()
    for r in log.previous(rows, "i", ["t", "n"], "v", "before", per_range=2).collect():
        own = [q for q in held if q["i"] == r["i"] and (q["t"], q["n"]) < (r["t"], r["n"])]
        assert r["before"] == (max(own, key=lambda q: (q["t"], q["n"]))["v"] if own else None)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_medians_in_ranges(spark, monkeypatch, few):
    import statistics

    monkeypatch.setattr(log, "FEW", few)
    rng = random.Random(4)
    groups = {"hot": [float(rng.randint(0, 400)) for _ in range(2001)], "even": [rng.random() for _ in range(300)], "one": [7.5], "same": [3.0] * 40, None: [1.0, 2.0], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None)]
    got = {r["k"]: r["median_r"] for r in log.median_rt(spark.createDataFrame(rows, "k string, r double").repartition(5), ["k"]).collect()}
    assert got == {k: statistics.median(v) if v else 0.0 for k, v in groups.items()}


def test_lists_are_bounded(spark):
    rows = spark.createDataFrame([(k, ["all", f"e{k % 2}"]) for k in range(25)], "k int, names array<string>")
    got = {(r["element"], r["chunk"]): r["keys"] for r in mastery.inverted(rows, "names", F.col("k"), bound=10).collect()}
    assert got == {("all", 0): list(range(10)), ("all", 1): list(range(10, 20)), ("all", 2): list(range(20, 25)), ("e0", 0): list(range(0, 20, 2)), ("e0", 1): [20, 22, 24], ("e1", 0): list(range(1, 20, 2)), ("e1", 1): [21, 23]}


def test_checks(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None), (4, 1), (4, 1)], "k int, n int")
    assert sorted(r["k"] for r in checks.broken_numbering(rows, ["k"], "n").collect()) == [2, 4]
    bad = one(spark, checks.sentence_end(F.lit("x。")), checks.sentence_end(F.lit("x")), checks.sentence_end(F.lit(" ")), checks.circled(F.lit("①")), checks.blank(F.lit("　")))
    assert tuple(bad) == (False, True, False, True, True)


def test_stream_takes_late_events_in_any_order(spark, tmp_path):
    from tidemark.plans.stream_queries import drained
    from tidemark.streaming import live

    rng = random.Random(4)
    rows = [(f"c{rng.randrange(5)}", rng.randrange(50), k, "d", rng.random() < 0.5) for k in range(200)]
    schema = "concept string, t long, n long, d string, hit boolean"
    shuffled = rng.sample(rows, len(rows))
    for k in range(5):
        spark.createDataFrame(shuffled[k::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = live.on_disk(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drained(live.mastery(source), "update", spark).groupBy("concept").agg(F.max_by("a", "reps").alias("a"), F.max("reps").alias("reps"))
    want = log.concept_state(spark.createDataFrame(rows, schema), ["concept"], log.event_order(desc=True), F.col("hit"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def waves(spark, folder, start, *batches):
    """A stream run anew for each batch of rows, from the state that the run before left."""
    for rows in batches:
        spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema("k string, at timestamp").parquet(f"{folder}/in")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def clock(text):
    import datetime

    return datetime.datetime.fromisoformat(f"2024-01-01T{text}")


def test_a_late_row_joins_two_sessions(spark, tmp_path):
    from tidemark.streaming import live

    def start(rows):
        return live.sessions(rows, ["k"], "30 minutes", "1 hour").writeStream.outputMode("append").foreachBatch(lambda out, n: out.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))

    waves(spark, tmp_path, start, [("a", clock("10:00:00")), ("a", clock("10:50:00")), ("b", clock("10:00:00"))], [("a", clock("10:25:00"))], [("z", clock("15:00:00"))])
    got = sorted((r["k"], r["start"], r["end"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", clock("10:00:00"), clock("11:20:00"), 3), ("b", clock("10:00:00"), clock("10:30:00"), 1)]


def test_late_rows_are_kept_apart(spark, tmp_path):
    from tidemark.streaming import live

    late = live.LateRows(spark, str(tmp_path / "late"), spark.createDataFrame([], "k string, at timestamp").schema, "1 HOURS")
    waves(spark, tmp_path, late.sink, [("a", clock("10:00:00")), ("old in the first batch", clock("05:00:00"))], [("b", clock("09:00:00")), ("c", clock("08:59:59")), ("d", clock("12:00:00"))], [("e", clock("10:30:00")), ("f", None)])
    want = {"a": False, "old in the first batch": False, "b": False, "c": True, "d": False, "e": True, "f": False}
    assert {r["k"]: r["late"] for r in late.read().collect()} == want
    late.put(spark.createDataFrame([("b", clock("09:00:00")), ("c", clock("08:59:59")), ("d", clock("12:00:00"))], "k string, at timestamp"), 1)  # run again
    assert sorted((r["k"], r["late"]) for r in late.read().collect()) == sorted(want.items())


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=top, check=True)


@pytest.mark.parametrize("name", ["stream_dedup", "stream_item_state", "stream_flags", "stream_mastery"])
def test_stream_results_are_in_the_shared_folder(spark, name):
    """Written by executors: a memory sink's rows are in the driver and have no files."""
    files = stream_queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    top = spark.conf.get("spark.checkpoint.dir")
    assert files and all(top in f for f in files)


def test_drained_over_several_micro_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("x", 1), ("y", k)], "i string, n long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def stream():
        return spark.readStream.schema("i string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def rows(df):
        return sorted(map(tuple, df.collect()))

    counts = stream().groupBy("i").agg(F.count("*").alias("reps"))
    assert rows(stream_queries.drained(stream().dropDuplicates(["i", "n"]), "append")) == [("x", 1), ("y", 0), ("y", 1), ("y", 2)]
    assert rows(stream_queries.drained(counts, "complete")) == [("x", 3), ("y", 3)]
    assert rows(stream_queries.drained(counts, "update").groupBy("i").agg(F.max("reps"))) == [("x", 3), ("y", 3)]
    assert rows(stream_queries.drained(stream().filter("false"), "append")) == []


def test_export_of_a_large_item_is_several_documents(spark):
    rows = [("x", k, "big" if k < 900 else None if k < 1800 else f"i{k % 7}", k % 50, 3, "text", None) for k in range(2000)]
    events = ev(spark, rows)
    docs = log.exported(events, ["i"], bound=100)
    sizes = [r["n"] for r in docs.select(F.size(F.from_json("json", log.EXPORT_SCHEMA)["events"]).alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 100
    back = log.imported(docs, events.drop("a").filter("false"))
    assert sorted(r["n"] for r in back.collect()) == list(range(2000))
    assert back.exceptAll(events.drop("a").select(*back.columns)).isEmpty()
    assert log.exported(events, ["i"]).count() == 9


def test_migrated_alternatives_are_numbered_by_range(spark):
    old = spark.createDataFrame([(None if k == 0 else f"i{k:04}", [f"a{k}", f"b{k}"]) for k in range(1000)], "i string, alts array<string>").repartition(5)
    out = log.migrate_alternatives(old, "dev", 100)
    assert [(r["n"], r["a"]) for r in out.orderBy("n").collect()] == [(101 + 2 * k + j, f"{x}{k}") for k in range(1000) for j, x in enumerate("ab")]
    assert "hashpartitioning(_range" in out._jdf.queryExecution().executedPlan().toString()
    numbered = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line]
    assert numbered and all("_range" in line for line in numbered)
    assert log.migrate_alternatives(old.filter("false"), "dev", 0).count() == 0


def test_all_spellings_of_a_verb_give_alternatives(spark):
    spellings = [f"食{k}べます" for k in range(130)]
    vocab = spark.createDataFrame([(1, 1, "たべます", "、".join(spellings))], "lesson int, pos int, kana string, kanji string")
    verbs = spark.createDataFrame([(spellings[0], "II", "たべます")], "cite string, group string, reading string")
    rows = items.transform(vocab, verbs).collect()
    assert rows and all(len(r["alternatives"]) == 130 for r in rows)
