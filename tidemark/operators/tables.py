"""Lines and rows of printed tables: nested fragments, segments, slots, forms. Groups here are one line or one table, of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import layout

HAS_KANA = r"[぀-ヿ]"
CIRCLED = "^[①-⑳]"


def chars_of(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_places(text: Column, x: Column, size: Column) -> Column:
    """Where each character of a fragment stands, and where the fragment ends: one more than it has characters."""
    return F.aggregate(chars_of(text), F.array(x.cast("double")), lambda a, c: F.array_append(a, F.element_at(a, -1) + T.char_width(c, size)))


def bound(value: Column, of) -> Column:
    """of(value), with value worked out once however often `of` names it: a fold over nothing, since what it ends with is not copied."""
    return F.aggregate(F.array(), value, lambda a, _: a, of)


def line_text(rows: DataFrame, keys: list[str], seq: str, text: str, x: str, size: str) -> DataFrame:
    """keys, text: fragments of a line in order of x, those that begin strictly inside another set between its characters.

    A fragment's host is the shortest one around its start; it stands before the first of the host's characters that is not left of it,
    and may itself hold others. A line is collected. Since what a fragment holds begins right of it, fragments are set from the right,
    each with its own text already whole. Fragments that begin at one x stay whole, in order of seq. Lines without a key have no hosts.
    """
    width = F.aggregate(chars_of(F.col(text)), F.col(x).cast("double"), lambda a, c: a + T.char_width(c, F.col(size)))
    told = rows.filter(F.col(text) != "").select(*keys, F.struct(F.col(x).cast("double").alias("x"), F.col(seq).cast("double").alias("seq"), F.col(text).alias("text"), F.col(size).alias("size"), width.alias("right")).alias("_f"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def host(f: Column, r: Column, i: Column) -> Column:
        """Place of the host of the fragment at place i."""
        around = lambda h, j: F.when((h["x"] < r["x"]) & (r["x"] < h["right"]), F.struct((h["right"] - h["x"]).alias("span"), h["seq"].alias("seq"), j.alias("place")))
        return F.array_min(F.transform(F.slice(f, F.lit(1), i), around))["place"]

    def left_of(h: Column, r: Column) -> Column:
        """How many of the host's characters stand left of the fragment."""
        step = lambda a, c: F.struct((a["x"] + T.char_width(c, h["size"])).alias("x"), (a["n"] + (a["x"] < r["x"]).cast("int")).alias("n"))
        return F.aggregate(chars_of(h["text"]), F.struct(h["x"].alias("x"), F.lit(0).alias("n")), step)["n"]

    def with_host(f: Column) -> Column:
        each = lambda r, i: bound(host(f, r, i), lambda h: F.struct(i.alias("place"), r["text"].alias("text"), h.alias("host"), F.when(h.isNotNull(), left_of(F.get(f, h), r)).alias("at")))
        return F.transform(f, each)

    def nested(g: Column) -> Column:
        def step(a: Column, r: Column) -> Column:
            holds = lambda e: F.coalesce(e["host"] == r["place"], F.lit(False))
            put = lambda t, e: F.concat(F.substring(t, F.lit(1), e["at"]), e["text"], F.substring(t, e["at"] + 1, F.length(t)))
            whole = F.aggregate(F.filter(a, holds), r["text"], put)
            return F.array_append(F.filter(a, lambda e: ~holds(e)), F.struct(r["host"].alias("host"), r["at"].alias("at"), whole.alias("text")))

        none = F.array().cast("array<struct<host:int,at:int,text:string>>")
        return F.array_join(F.reverse(F.aggregate(F.reverse(g), none, step)["text"]), "")

    plain = lambda f: F.array_join(f["text"], "")
    set_in = lambda f: bound(with_host(f), lambda g: F.when(F.exists(g, lambda r: r["host"].isNotNull()), nested(g)).otherwise(plain(f)))
    return told.groupBy(*keys).agg(F.sort_array(F.collect_list("_f")).alias("_f")).select(*keys, bound(F.col("_f"), lambda f: F.when(known, set_in(f)).otherwise(plain(f))).alias("text"))


def fine_segments(rows: DataFrame, keys: list[str], seq: str, text: str, x: str, size: str, gap: float = 5.0) -> DataFrame:
    """keys, k (from 0), x, text: a line cut where two or more white spaces stand, and between fragments more than `gap` apart; blank pieces go."""
    line = W.partitionBy(*keys).orderBy(seq)
    far = F.col(x) - F.lag(F.element_at("_places", -1)).over(line) > gap
    f = rows.withColumn("_places", char_places(F.col(text), F.col(x), F.col(size))).withColumn("_far", F.coalesce(far, F.lit(False)))
    chars = f.select(*keys, F.col(seq).alias("_seq"), "_places", "_far", F.posexplode(chars_of(F.col(text))).alias("_i", "_ch"))
    order = W.partitionBy(*keys).orderBy("_seq", "_i")
    chars = chars.withColumns({"_blank": F.col("_ch").rlike(T.SPACES), "_x": F.get("_places", F.col("_i"))})
    wide = F.col("_blank") & (F.coalesce(F.lag("_blank").over(order), F.lit(False)) | F.coalesce(F.lead("_blank").over(order), F.lit(False)))
    chars = chars.withColumn("_wide", wide)
    starts = (F.col("_far") & (F.col("_i") == 0)) | (F.col("_wide") != F.lag("_wide").over(order))
    chars = layout.running_groups(chars.withColumn("_starts", F.coalesce(starts, F.lit(False))), keys, ["_seq", "_i"], F.col("_starts"))
    place = F.struct("_seq", "_i")
    pieces = chars.groupBy(*keys, "group").agg(T.trimmed(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_seq", "_i", "_ch"))), lambda r: r["_ch"]), "")).alias("text"), F.min_by("_x", place).alias("x"))
    return pieces.filter("text <> ''").select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("group")) - 1).alias("k"), "x", "text")


def split_example_line(rows: DataFrame, keys: list[str], seq: str, text: str, x: str, size: str, marker: bool) -> DataFrame:
    """keys, jp, zh: a line's fragments cut once at the widest gap (the first of equals), if what follows is not blank and has no kana.

    A line without kana is all zh. marker: a circled number before the first other character goes, with the white space around it.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text"), F.col(x).alias("x"), (F.col(x) + T.text_width(F.col(text), F.col(size))).alias("end"))))
    lines = rows.groupBy(*keys).agg(parts.alias("f"))
    texts = F.transform("f", lambda r: r["text"])
    left = lambda s: F.regexp_replace(s, f"^{T.SPACES}+", "")
    if marker:
        first = F.array_position(F.transform("f", lambda r: left(r["text"]) != ""), True) - 1
        own = left(F.get(texts, F.col("first").cast("int")))
        cleaned = F.transform(texts, lambda t, i: F.when(i < F.col("first"), "").when(i == F.col("first"), left(F.regexp_replace(left(t), CIRCLED, ""))).otherwise(t))
        lines = lines.withColumn("first", first).withColumn("t", F.when((F.col("first") >= 0) & own.rlike(CIRCLED), cleaned).otherwise(texts))
    else:
        lines = lines.withColumn("t", texts)
    gaps = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda r, i: r["x"] - F.get("f", i)["end"])
    lines = lines.withColumns({"whole": F.array_join("t", ""), "gaps": gaps}).withColumn("cut", F.array_position("gaps", F.array_max("gaps")).cast("int"))
    tail = F.array_join(F.slice("t", F.col("cut") + 1, F.size("t")), "")
    cuts = (F.size("gaps") > 0) & (T.trimmed(tail) != "") & ~tail.rlike(HAS_KANA)
    none = ~F.col("whole").rlike(HAS_KANA)
    jp = F.when(none, "").when(cuts, F.array_join(F.slice("t", F.lit(1), F.col("cut")), "")).otherwise(F.col("whole"))
    return lines.select(*keys, jp.alias("jp"), F.when(none, F.col("whole")).when(cuts, tail).otherwise("").alias("zh"))


def redistribute_slots(rows: DataFrame, keys: list[str], row: str, cells: str, bases: Column, slots: Column) -> DataFrame:
    """Rows of tables with a slot's missing value taken from the nearest column before it that the row prints and that still holds
    something: its last segment, if that stands nearer to where the slot's values stand in the other rows than to where its own column's do.

    cells: for each column an array of segments (x, text); bases: where each column of the table's first row stands; slots: an array of
    columns. Means are taken before any change and leave the row itself out. Slots are filled from the left, each on what the one before left.
    """
    told = rows.select(*keys, row, bases.alias("_bases"), slots.alias("_slots"), F.posexplode(cells).alias("_column", "_segments"))
    own_sum, own_n = F.aggregate("_segments", F.lit(0.0), lambda a, s: a + s["x"]), F.size("_segments")
    told = told.withColumns({"_sum": own_sum, "_n": own_n})
    w = W.partitionBy(*keys, "_column")
    mean = (F.get("_bases", F.col("_column")) + F.sum("_sum").over(w) - F.col("_sum")) / (1 + F.sum("_n").over(w) - F.col("_n"))
    told = told.select(*keys, row, "_slots", F.struct(F.col("_column").alias("column"), F.col("_segments").alias("segments"), mean.alias("mean"), (F.col("_n") > 0).alias("printed")).alias("cell"))
    state = told.groupBy(*keys, row, "_slots").agg(F.sort_array(F.collect_list("cell")).alias("state"))
    return state.select(*keys, row, F.transform(slots_filled(F.col("state"), F.col("_slots")), lambda c: c["segments"]).alias(cells))


def slots_filled(state: Column, slots: Column) -> Column:
    """state, the cells (column, segments, mean, printed) of a row in order of columns, after its slots have taken what they may, see redistribute_slots."""
    def fill(a: Column, m: Column) -> Column:
        filled = F.filter(a, lambda c: (c["column"] < m) & c["printed"] & (F.size(c["segments"]) > 0))
        return F.when(F.size(F.get(a, m)["segments"]) > 0, a).otherwise(bound(F.try_element_at(filled, F.lit(-1)), lambda source: moved(a, m, source)))

    def moved(a: Column, m: Column, source: Column) -> Column:
        last = F.try_element_at(source["segments"], F.lit(-1))
        moves = F.coalesce(F.abs(last["x"] - F.get(a, m)["mean"]) < F.abs(last["x"] - source["mean"]), F.lit(False))
        now = lambda c: F.when(c["column"] == m, F.array(last)).when(c["column"] == source["column"], F.slice(c["segments"], 1, F.size(c["segments"]) - 1)).otherwise(c["segments"])
        return F.when(moves, F.transform(a, lambda c: F.struct(c["column"].alias("column"), now(c).alias("segments"), c["mean"].alias("mean"), c["printed"].alias("printed")))).otherwise(a)

    return F.aggregate(F.sort_array(slots), state, fill)


def reconstruct_question(base: Column, values: Column, start: Column, slots: Column) -> Column:
    """A question row as a sentence: what it prints instead of the base's columns up to where its ellipsis starts; from there on the base, with か.

    values: map of column to text. After the first printed column, slots without a text of their own go: the question word stands for
    them too. Null without an ellipsis.
    """
    first = F.array_min(F.filter(F.map_keys(values), lambda k: k < start))
    head = F.transform(F.slice(base, 1, start), lambda b, i: F.coalesce(F.try_element_at(values, i), F.when(F.coalesce(first < i, F.lit(False)) & F.array_contains(slots, i), "").otherwise(b)))
    tail = F.concat(F.coalesce(F.try_element_at(values, start), F.get(base, start)), F.array_join(F.slice(base, start + 2, F.size(base)), ""))
    return F.when(start.isNotNull(), F.concat(F.array_join(head, ""), F.regexp_replace(tail, "。\\z", ""), F.lit("か。")))


def form_marker(texts: Column, ignored: tuple[str, ...] = ()) -> Column:
    """The first text, none of the ignored ones, that comes again two places on or later; null without one."""
    def again(t: Column, i: Column) -> Column:
        return (F.array_position(texts, t) < i) & F.coalesce(F.get(texts, i - 1) != t, F.lit(True)) & ~t.isin(*ignored)

    return F.get(F.filter(texts, again), F.lit(0))


def form_starts(texts: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Where the forms of a row begin: at each place of the row's marker (see form_marker), and at 0; null without one."""
    places = lambda m: F.filter(F.transform(texts, lambda t, i: F.when(t == m, i)), lambda i: i.isNotNull())
    return bound(form_marker(texts, ignored), lambda m: F.when(m.isNotNull(), F.array_union(F.array(F.lit(0)), places(m))))


def conjugation_forms(rows: DataFrame, keys: list[str], row: str, texts: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, forms: each row's texts joined to forms, cut where most rows of its table with as many texts are cut; rows of a length
    for which no row tells are left out. Of equal votes the cut seen first counts."""
    told = rows.select(*keys, row, texts, F.size(texts).alias("_n"), form_starts(F.col(texts), ignored).alias("_starts"))
    best = layout.boundary_vote(told.filter("_starts IS NOT NULL"), [*keys, "_n"], "_starts", row).drop("votes").withColumnRenamed("_starts", "_best")
    out = told.join(best, [*keys, "_n"])
    forms = F.transform("_best", lambda s, i: F.array_join(F.slice(texts, s + 1, F.coalesce(F.get("_best", i + 1), F.col("_n")) - s), ""))
    return out.select(*keys, row, forms.alias("forms"))
