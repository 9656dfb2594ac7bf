"""Records out of the ordered lines of a section: vocabulary entries and grammar points, as windows over lines.

Both parsers are state machines over lines. What their state depends on comes from windows: a mode that never goes back is a running
maximum, the open record is the last line that opened one, and a line that closes it closes it for all lines up to the next that opens
one. Only the numbering of entries, where each accepted number changes which one is next, is a fold, over a section's numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import layout, tables
from tidemark.sources.shared import written

#: Fixed values of printed vocabulary pages.
SUPPLEMENTARY, CONVERSATION = "以下單字", "■会話"
GROUPS = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III"}
KANJI_NEAR, ALIGNED, USAGE_GAP = 5.0, 16.0, 50.0
#: Fixed values of printed grammar pages.
TITLE, NOTE, FULL_DIGITS = r"^([0-9０-９]+)[.．]\s*", r"^[（(]\S+[）)]\z", "０１２３４５６７８９"


def _joined(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: c["text"]), "")


def _in_order(value: Column, *order: str) -> Column:
    """Aggregate: the values, which may be null, joined in this order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("v")))), lambda r: r["v"]), "")


def _grouped(text: Column) -> tuple[Column, Column]:
    mark, rest = T.extract_group(text, tuple(GROUPS))
    return F.replace(F.replace(F.replace(mark, F.lit("Ⅲ"), F.lit("III")), F.lit("Ⅱ"), F.lit("II")), F.lit("Ⅰ"), F.lit("I")), rest


def _first(cells: Column, test) -> Column:
    """How many cells stand before the first that passes; all without one."""
    at = F.array_position(F.transform(cells, lambda c: F.coalesce(test(c), F.lit(False))), True).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(cells))


def at_readings(cells: Column, kana_x: Column) -> Column:
    """True where a line begins where readings stand."""
    return F.coalesce(F.abs(F.get(cells, F.lit(0))["x"] - kana_x) <= ALIGNED, F.lit(False))


def bracketed(cells: Column) -> Column:
    return _joined(cells).rlike("[［〔]")


def usage_line(cells: Column, kana_x: Column) -> Column:
    """True for a line that may be an entry's usage: brackets, at the readings."""
    return at_readings(cells, kana_x) & bracketed(cells)


def gloss_line(cells: Column, floor: Column) -> Column:
    """True for a line all of whose cells stand among the glosses; never without cells or where there is no such column."""
    return F.coalesce((F.size(cells) > 0) & F.forall(cells, lambda c: c["x"] >= floor), F.lit(False))


def reading_line(cells: Column, kana_x: Column) -> Column:
    """True for a line that may give another reading or a note: at the readings, no brackets."""
    return at_readings(cells, kana_x) & ~bracketed(cells)


def vocabulary(rows: DataFrame, keys: list[str], order: str, cells: str, kana_x: Column, kanji_x: Column, floor: Column) -> DataFrame:
    """keys, at, category, no, kana, kanji, zh, usage (kana, kanji), group: the entries of a section's lines.

    cells: a line's (x, text) in order of x. kana_x, kanji_x, floor: where readings, spellings and glosses stand in the section, the last
    two null where it has no such column (see layout.learn_columns). Numbered entries count on from 1; any other line with a number
    is no entry. Under an entry, the first line with brackets at the readings is its usage; lines wholly among the glosses go on with its
    gloss; lines at the readings without brackets do, after a space; any other line that is not blank ends the entry. After the line that
    heads the conversation box, and after the one that heads the supplementary words, each line is an entry without a number, or goes on
    with the gloss of the one before in the same part. at: the order of the entry's own line.
    """
    upto = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    lines = rows.select(*keys, F.col(order).cast("bigint").alias("at"), F.col(cells).alias("cells"), kana_x.alias("kana_x"), kanji_x.alias("kanji_x"), floor.alias("floor"))
    lines = lines.withColumn("text", _joined(F.col("cells")))
    marker = F.when(F.col("text").contains(SUPPLEMENTARY), 2).when(F.col("text").contains(CONVERSATION), 1)
    lines = lines.withColumns({"marker": marker, "mode": F.max(F.coalesce(marker, F.lit(0))).over(upto)}).filter("marker IS NULL AND size(cells) > 0")
    label = F.when(F.col("mode") == 0, F.regexp_extract("text", r"^\s*(\d{1,9})\.?", 1))
    lines = lines.withColumn("label", F.when(label != "", label.cast("bigint")))
    numbers = layout.contiguous_numbering(lines.filter("label IS NOT NULL"), keys, "at", "label").withColumnRenamed("label", "no")
    lines = lines.join(numbers, [*keys, "at"], "left")

    free = F.col("mode") > 0
    first = F.row_number().over(W.partitionBy(*keys, "mode").orderBy("at")) == 1
    cells_, kana_ = F.col("cells"), F.col("kana_x")
    lines = lines.withColumns({"usage_like": usage_line(cells_, kana_), "reading_like": reading_line(cells_, kana_), "among": gloss_line(cells_, F.col("floor"))})
    lines = lines.withColumn("opens", F.when(free, first | ~F.col("among")).otherwise(F.col("no").isNotNull()))
    lines = lines.withColumn("entry", F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(upto)).filter("entry IS NOT NULL")
    own = W.partitionBy(*keys, "mode", "entry").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    used = F.col("usage_like") & ~F.col("opens") & ~free
    lines = lines.withColumn("usage", used & (F.sum(used.cast("int")).over(own) == 1))
    part = F.when(F.col("opens"), "entry").when(F.col("usage"), "usage").when(F.col("among"), "gloss").when(~free & F.col("reading_like"), "note").when(T.trimmed(F.col("text")) != "", "other").otherwise("blank")
    lines = lines.withColumn("part", part).withColumn("over", F.max(F.col("part") == "other").over(own)).filter(~F.col("over"))

    rest = F.regexp_extract(F.get("cells", F.lit(0))["text"], r"(?s)^\s*\d+\.?(.*)\z", 1)
    told = F.slice("cells", 2, F.size("cells"))
    told = F.when(T.trimmed(rest) != "", F.concat(F.array(F.struct(F.get("cells", F.lit(0))["x"].alias("x"), rest.alias("text"))), told)).otherwise(told)
    lines = lines.withColumn("data", F.when(free, F.col("cells")).otherwise(told))
    lines = lines.withColumn("z", _first(F.col("data"), lambda c: c["x"] >= F.col("floor")))
    lines = lines.withColumn("k", F.least("z", _first(F.col("data"), lambda c: F.abs(c["x"] - F.col("kanji_x")) <= KANJI_NEAR)))
    lines = lines.withColumns({"c_kana": _joined(F.slice("data", F.lit(1), F.col("k"))), "c_kanji": _joined(F.slice("data", F.col("k") + 1, F.col("z") - F.col("k"))), "c_zh": _joined(F.slice("data", F.col("z") + 1, F.size("data")))})
    real = T.has_real_content(F.col("c_kanji"))
    lines = lines.withColumns({"c_zh": F.when(real | free, F.col("c_zh")).otherwise(F.concat("c_kanji", "c_zh")), "c_kanji": F.when(real | free, F.col("c_kanji")).otherwise("")})
    at = T.first_ideograph(F.col("c_kana"))
    cut = ~free & (F.col("c_kanji") == "") & (at >= 0)
    lines = lines.withColumns({"c_kanji": F.when(cut, F.substring("c_kana", at + 1, F.length("c_kana"))).otherwise(F.col("c_kanji")), "c_kana": F.when(cut, F.substring("c_kana", F.lit(1), at)).otherwise(F.col("c_kana"))})
    group, term = _grouped(F.when(free, F.concat("c_kana", "c_kanji")).otherwise(F.col("c_kana")))
    lines = lines.withColumns({"group": group, "term": T.trimmed(term)})
    spelt = T.first_ideograph(F.col("term")) >= 0
    kana = F.when(~free, F.col("term")).when(~spelt & (F.col("term") != ""), F.col("term"))
    kanji = F.when(free & spelt, F.col("term")).when(~free & (T.trimmed(F.col("c_kanji")) != ""), T.trimmed(F.col("c_kanji")))
    gaps = F.transform(F.slice("cells", 2, F.size("cells")), lambda c, i: F.struct((c["x"] - F.get("cells", i)["x"]).alias("gap"), i.alias("i")))
    widest = F.array_max(gaps)
    left = F.when(widest["gap"] >= USAGE_GAP, widest["i"] + 1).otherwise(F.size("cells"))
    usage = F.struct(T.strip_brackets(_joined(F.slice("cells", F.lit(1), left))).alias("kana"), F.when(left < F.size("cells"), T.strip_brackets(_joined(F.slice("cells", left + 1, F.size("cells"))))).alias("kanji"))
    said = T.trimmed(F.col("text"))
    more = F.when(F.col("part") == "entry", T.trimmed(F.col("c_zh"))).when((F.col("part") == "gloss") & (said != ""), said).when((F.col("part") == "note") & (said != ""), F.concat(F.lit(" "), said)).otherwise("")
    lines = lines.select(*keys, "entry", "mode", "at", "part", "no", kana.alias("kana"), kanji.alias("kanji"), "group", more.alias("more"), usage.alias("usage"))
    opening = lambda c: F.max(F.when(F.col("part") == "entry", F.col(c))).alias(c)
    out = lines.groupBy(*keys, "mode", "entry").agg(*map(opening, ("no", "kana", "kanji", "group")), T.trimmed(_in_order(F.col("more"), "at")).alias("zh"), F.max(F.when(F.col("part") == "usage", F.col("usage"))).alias("usage"))
    category = F.get(F.array(F.lit("numbered"), F.lit("conversation"), F.lit("supplementary")), F.col("mode"))
    return out.select(*keys, F.col("entry").alias("at"), category.alias("category"), "no", "kana", "kanji", "zh", "usage", "group")


def grammar(rows: DataFrame, keys: list[str], line: str, seq: str, text: str, x: str, size: str) -> DataFrame:
    """keys, at, no, title, body, examples (array of jp, zh): the points of a section's lines, given as fragments.

    A line that begins with a number and a point opens a point. Under it, a circled number opens an example, and lines that begin
    further right than it go on with it; a line that does not, or a lone bracketed note, ends the example and belongs to the body, as do
    all lines up to the next example. Lines before the first point and blank lines go. Titles and examples join their fragments in
    order; the body's lines set inserted fragments between the characters around them (see tables.line_text).
    """
    own = [*keys, "_line"]
    fragments = rows.select(*keys, F.col(line).cast("bigint").alias("_line"), F.col(seq).alias("_nth"), text, F.col(x).cast("double").alias(x), F.col(size).cast("double").alias(size))
    held = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), "_nth", F.col(text).alias("v"), (F.col(x) + T.text_width(F.col(text), F.col(size))).alias("end"))))
    lines = fragments.groupBy(*own).agg(T.trimmed(_in_order(F.col(text), "_nth")).alias("said"), F.min_by(x, "_nth").alias("left"), held.alias("held")).filter("said <> ''")
    inserted = F.exists("held", lambda f: F.exists("held", lambda h: (h["x"] < f["x"]) & (f["x"] < h["end"])))
    lines = written(lines.withColumns({"inserted": inserted, "plain": F.array_join(F.transform("held", lambda f: f["v"]), "")}).drop("held"), "lines")
    odd = fragments.join(lines.filter("inserted").select(*own), own, "left_semi")
    lines = lines.join(tables.split_example_line(fragments, own, "_nth", text, x, size, True), own).join(tables.line_text(odd, own, "_nth", text, x, size).withColumnRenamed("text", "set"), own, "left")
    lines = lines.withColumn("whole", F.coalesce("set", "plain"))
    upto = W.partitionBy(*keys).orderBy("_line").rowsBetween(W.unboundedPreceding, 0)
    title, circled = F.col("said").rlike(TITLE), F.col("said").rlike(tables.CIRCLED)
    lines = lines.withColumns({"title": title, "circled": circled & ~title}).withColumn("at", F.last(F.when(F.col("title"), F.col("_line")), ignorenulls=True).over(upto)).filter("at IS NOT NULL")
    point = W.partitionBy(*keys, "at").orderBy("_line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("example", F.last(F.when(F.col("circled"), F.col("_line")), ignorenulls=True).over(point))
    under = W.partitionBy(*keys, "at", "example").orderBy("_line").rowsBetween(W.unboundedPreceding, 0)
    ends = ~F.col("circled") & (F.col("said").rlike(NOTE) | (F.col("left") <= F.first("left").over(under)))
    lines = lines.withColumn("ends", ends).withColumn("body", ~F.col("title") & (F.col("example").isNull() | F.max("ends").over(under)))
    number = F.translate(F.regexp_extract("said", TITLE, 1), FULL_DIGITS, "0123456789").cast("bigint")
    points = lines.groupBy(*keys, "at").agg(F.max(F.when(F.col("title"), number)).alias("no"), F.max(F.when(F.col("title"), T.trimmed(F.regexp_replace("said", TITLE, "")))).alias("title"), T.trimmed(_in_order(F.when(F.col("body"), F.col("whole")), "_line")).alias("body"))
    examples = lines.filter("example IS NOT NULL AND NOT body").groupBy(*keys, "at", "example").agg(T.trimmed(_in_order(F.col("jp"), "_line")).alias("jp"), T.trimmed(_in_order(F.col("zh"), "_line")).alias("zh"))
    examples = examples.filter("jp <> '' OR zh <> ''").groupBy(*keys, "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("example", "jp", "zh"))), lambda e: F.struct(e["jp"].alias("jp"), e["zh"].alias("zh"))).alias("examples"))
    return points.join(examples, [*keys, "at"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<struct<jp:string,zh:string>>"))).select(*keys, "at", "no", "title", "body", "examples")
