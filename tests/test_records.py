"""Dictionary annotation and record parsers against plain versions and worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, lexicon, patterns, records, tables


def plain_tokens(text, entries, inside):
    """The longest entry at each place of a run, else one character on; plain stretches are joined."""
    out, i = [], 0
    text = text or ""
    while i < len(text):
        end = i
        while end < len(text) and inside(text[end]):
            end += 1
        hit = next((text[i:j] for j in range(end, i, -1) if text[i:j] in entries), None)
        if hit:
            out.append((hit, entries[hit]))
        elif out and out[-1][1] is None:
            out[-1] = (out[-1][0] + text[i], None)
        else:
            out.append((text[i], None))
        i += len(hit or text[i])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_annotate(spark, seed):
    rng = random.Random(seed)
    entries = {"".join(rng.choice("手紙本日") for _ in range(rng.randint(1, 5))): f"よみ{k}" for k in range(rng.choice([0, 3, 12]))}
    texts = ["".join(rng.choice("手紙本日とa 。\n") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "と", "手" * 400, "手紙", "手紙"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    words = spark.createDataFrame([*entries.items(), *[(b, "ん") for b in entries], ("", "nothing")], "base string, reading string")
    got = {r["k"]: [(t["text"], t["reading"]) for t in r["tokens"]] for r in lexicon.annotate(rows, ["k"], "text", words).collect()}
    assert got == {k: plain_tokens(t, {b: min(v, "ん") for b, v in entries.items()}, lambda c: "一" <= c <= "鿿") for k, t in enumerate(texts)}


def test_annotate_examples(spark):
    rows = spark.createDataFrame([(1, "手紙と紙"), (2, "大学生と大 学")], "k int, text string")
    words = spark.createDataFrame([("紙", "かみ"), ("手紙", "てがみ"), ("大学", "だいがく"), ("生", "せい"), ("学生と", "x")], "base string, reading string")
    got = {r["k"]: [(t["text"], t["reading"]) for t in r["tokens"]] for r in lexicon.annotate(rows, ["k"], "text", words).collect()}
    assert got == {1: [("手紙", "てがみ"), ("と", None), ("紙", "かみ")], 2: [("大学", "だいがく"), ("生", "せい"), ("と大 学", None)]}


def lines(spark, *cells):
    return spark.createDataFrame([("s", i, [(float(x), t) for x, t in own]) for i, own in enumerate(cells)], "s string, at int, cells array<struct<x:double,text:string>>")


def words(spark, *cells):
    out = records.vocabulary(lines(spark, *cells), ["s"], "at", "cells", F.lit(30.0), F.lit(100.0), F.lit(200.0)).orderBy("at").collect()
    return [(r["category"], r["no"], r["kana"], r["kanji"], r["zh"], r["usage"] and tuple(r["usage"]), r["group"]) for r in out]


def test_vocabulary(spark):
    got = words(
        spark,
        [(30, "がいとう")],  # before the first entry
        [(10, "1."), (30, "たちます Ⅱ立ちます"), (200, "站")],
        [(205, "起來"), (240, "。")],
        [(32, "［ここに］"), (150, "［立つ］")],
        [(28, "（たつ）"), (210, "又")],
        [(32, "［second usage］")],  # ends the entry
        [(205, "lost")],
        [(10, "3."), (30, "notnext")],
        [(10, "2.ほん"), (98, "本"), (203, "書")],
        [(10, " ")],
        [(205, "本")],
        [(10, "3."), (30, "でんわ"), (101, "〔"), (205, "打〕")],
        [(30, "■会話")],
        [(205, "first, so an entry")],
        [(30, "ごめんください。"), (205, "請問")],
        [(205, "有人在嗎")],
        [],
        [(30, "以下單字請自行練習")],
        [(205, "another part")],
        [(12, "富士大学")],
        [(30, "■会話")],
        [(10, "4."), (30, "x")],
    )
    assert got == [
        ("numbered", 1, "たちます", "立ちます", "站起來。 （たつ）又", ("ここに", "立つ"), "II"),
        ("numbered", 2, "ほん", "本", "書本", None, None),
        ("numbered", 3, "でんわ", None, "〔打〕", None, None),
        ("conversation", None, None, None, "first, so an entry", None, None),
        ("conversation", None, "ごめんください。", None, "請問有人在嗎", None, None),
        ("supplementary", None, None, None, "another part", None, None),
        ("supplementary", None, None, "富士大学", "", None, None),
        ("supplementary", None, "4.x", None, "", None, None),
    ]


def test_vocabulary_without_columns_or_lines(spark):
    assert words(spark) == []
    rows = lines(spark, [(10, "1."), (30, "か"), (205, "g")], [(205, "h")])
    out = records.vocabulary(rows, ["s"], "at", "cells", F.lit(30.0), F.lit(None).cast("double"), F.lit(None).cast("double")).collect()
    assert [(r["kana"], r["zh"]) for r in out] == [("かg", "")]


def test_grammar(spark):
    page = [["くうはく"], [" １２．題 "], ["body「", "いく」"], ["①れいか"], ["続"], ["（note）"], ["more body"], ["⑳れい", "例"], ["deeper"], ["at the mark"], ["３. last"], ["　"]]
    x = {0: 0, 1: 20, 2: 10, 3: 30, 4: 40, 5: 50, 6: 60, 7: 30, 8: 31, 9: 30, 10: 0, 11: 0}
    rows = [("s", i, j, t, float(x[i] + 300 * j), 10.0) for i, own in enumerate(page) for j, t in enumerate(own)]
    out = records.grammar(spark.createDataFrame(rows, "s string, n int, j int, t string, x double, z double"), ["s"], "n", "j", "t", "x", "z").orderBy("at").collect()
    assert [(r["at"], r["no"], r["title"], r["body"], [tuple(e) for e in r["examples"]]) for r in out] == [
        (1, 12, "題", "body「いく」（note）more bodyat the mark", [("れいか", "続"), ("れい", "例deeper")]),
        (10, 3, "last", "", []),
    ]


def test_grammar_sets_fragments_between_characters(spark):
    rows = [(0, 0, "1. t", 0.0), (1, 0, "要「」も", 0.0), (1, 1, "い", 15.0)]
    out = records.grammar(spark.createDataFrame(rows, "n int, j int, t string, x double").withColumns({"s": F.lit(1), "z": F.lit(10.0)}), ["s"], "n", "j", "t", "x", "z").collect()
    assert out[0]["body"] == "要「い」も"


def test_grammar_faults(spark):
    rows = [(1, ["a", "b①"], "x「」"), (2, [], "a ③"), (3, [" "], "①「」"), (4, ["a"], "①"), (5, None, None)]
    out = checks.grammar(spark.createDataFrame(rows, "k int, jp array<string>, body string"), ["k"], "jp", "body").collect()
    assert sorted((r["k"], r["rule"]) for r in out) == [(1, "circled"), (1, "quote"), (2, "lost"), (3, "lost"), (3, "quote")]


def table(spark, *rows):
    told = [(1, i, "".join(t for _, t in segs), [(float(x), t) for x, t in segs]) for i, segs in enumerate(rows)]
    return spark.createDataFrame(told, "k int, n int, raw string, segs array<struct<x:double,text:string>>")


BASE = [(0, "1."), (16, "本屋は"), (60, "えきの"), (100, "ちかく"), (150, "にあります。")]


def filled(spark, *rows):
    r = patterns.substitution(table(spark, *rows), ["k"], "n", "raw", "segs").head()
    return r["template"], r["slots"], r["rows"], r["question"]


def test_substitution(spark):
    got = filled(spark, BASE, [(61, "がっこう"), (70, "の"), (101, "まえ →")], [(100, "そば")], [(62, "どこ"), (151, "…か。")], [], [(60, "いえの"), (100, "ちかく")], [(0, "…本屋")], [(16, "gone")])
    assert got == ("本屋は{S}{T}にあります。", {"S": ["えきの", "がっこう の", "", "いえの"], "T": ["ちかく", "まえ", "そば", "ちかく"]}, [[0, 0], [1, 1], [2, 2], [3, 3]], "本屋はどこにありますか。")


def test_substitution_without_variants(spark):
    assert filled(spark, BASE) == ("{S}えきのちかくにあります。", {"S": ["本屋は"]}, [[0]], None)
    assert filled(spark, [(0, "1.")], [(5, "x")]) == ("", {"S": [None, "x"]}, [[0], [1]], None)


def test_reference_table(spark):
    head = [(0, "1."), (20, "ます形"), (100, "て"), (108, "形"), (200, "ます 形"), (280, "て形")]
    rows = [head, [(12, "Ⅰ"), (22, "か い"), (40, "ます"), (101, "かいて"), (201, "ね"), (220, "ます"), (281, "ねて")], [(22, "い")], [(200, "ます形"), (280, "て 形")], [(22, "いき"), (83, "＊いって")]]
    assert patterns.reference_table(table(spark, *rows), ["k"], "n", "segs").head()["forms"] == [["かいます", "かいて"], ["ねます", "ねて"], ["いき", "＊いって"]]
    assert patterns.reference_table(table(spark, head[:4], rows[1]), ["k"], "n", "segs").head()["forms"] == []


def test_pattern_tables(spark):
    forms = [(0, "2."), (16, "たべ"), (30, "ます"), (60, "たべ"), (90, "ましょう")]
    out = patterns.pattern_tables(table(spark, [(5, "before")], BASE, [(60, "みせの")], forms, [(16, "のみ"), (30, "ます"), (60, "のみ"), (90, "ましょう")], [(0, "3."), (1, "と"), (2, "あ"), (3, "と")]), ["k"], "n", "raw", "segs", F.lit(False)).orderBy("at").collect()
    assert [(r["at"], r["table_no"], r["kind"]) for r in out] == [(1, 1, "substitution"), (3, 2, "conjugation"), (5, 3, "substitution")]
    assert out[0]["slots"] == {"S": ["えきの", "みせの"]} and out[1]["forms"] == [["たべます", "たべましょう"], ["のみます", "のみましょう"]]


def test_pattern_tables_are_dealt_out_once(spark):
    """Random sections: each table gives what its own parser gives of it alone; lines are moved once, to their section, and nothing is joined."""
    rng = random.Random(7)
    bases = [BASE[1:], [(16, "たべ"), (30, "ます"), (60, "たべ"), (90, "ましょう")], [(16, "い"), (20, "い"), (40, "です")]]
    texts = ["がっこう", "の", "まえ →", "のみ", "ます", "い", "です", "だれ…か。", "…本屋", " x  y "]
    rows = []
    for k in range(40):
        for n in range(rng.randrange(1, 25)):
            opens = n == 0 or rng.random() < 0.2
            segs = [(float(x), t) for x, t in [(0, f"{n}."), *rng.choice(bases)]] if opens else sorted((float(rng.randrange(10, 200)), rng.choice(texts)) for _ in range(rng.randrange(6)))
            rows.append((k, n, "".join(t for _, t in segs), segs))
    shaped = spark.createDataFrame(rows, "k int, n int, raw string, segs array<struct<x:double,text:string>>")
    out = patterns.pattern_tables(shaped, ["k"], "n", "raw", "segs", F.expr("table_no % 4 = 3"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {(r["k"], r["at"]): r for r in out.collect()}
    assert len(got) == sum(raw.startswith(f"{n}.") for _, n, raw, _ in rows) and {r["kind"] for r in got.values()} == {"reference", "conjugation", "substitution"}
    own = spark.createDataFrame([(*t, n, raw, segs) for t in got for k, n, raw, segs in rows if k == t[0] and n >= t[1] and not any(u[0] == k and t[1] < u[1] <= n for u in got)], "k int, at int, n int, raw string, segs array<struct<x:double,text:string>>")
    for r in patterns.substitution(own, ["k", "at"], "n", "raw", "segs").collect():
        assert got[r["k"], r["at"]]["kind"] != "substitution" or all(got[r["k"], r["at"]][c] == r[c] for c in ("template", "slots", "rows", "question"))
    for kind, alone in (("conjugation", patterns.conjugations(own, ["k", "at"], "n", "raw", "segs")), ("reference", patterns.reference_table(own, ["k", "at"], "n", "segs"))):
        assert all(got[r["k"], r["at"]]["kind"] != kind or got[r["k"], r["at"]]["forms"] == r["forms"] for r in alone.collect())


def test_conjugations_vote_as_rows_do(spark):
    """The vote within a table equals the one over rows (tables.conjugation_forms), ties too."""
    rng = random.Random(3)
    rows = [(k, n, "", [(float(i), rng.choice("abct")) for i in range(rng.randrange(3, 7) + (n == 0))]) for k in range(60) for n in range(rng.randrange(1, 9))]
    shaped = spark.createDataFrame(rows, "k int, n int, raw string, segs array<struct<x:double,text:string>>")
    got = {r["k"]: r["forms"] for r in patterns.conjugations(shaped, ["k"], "n", "raw", "segs").collect()}
    texts = spark.createDataFrame([(k, n, [t for _, t in segs][n == 0 :]) for k, n, _, segs in rows], "k int, n int, cells array<string>")
    want = {k: [] for k in got}
    for r in sorted(tables.conjugation_forms(texts, ["k"], "n", "cells", patterns.PARTICLES).collect(), key=lambda r: r["n"]):
        want[r["k"]].append(r["forms"])
    assert got == want and any(len(f) > 2 for f in got.values())
