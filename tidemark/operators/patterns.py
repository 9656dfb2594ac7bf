"""Printed pattern tables: substitution tables, tables of forms, and sections that hold both.

A line is its number, its raw text and its segments (x, text), see tables.fine_segments. Groups are one table, of bounded size: its lines
are collected in order, and what it holds is one expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import layout, tables
from tidemark.operators.tables import bound

#: Fixed values of the printed tables.
QUESTION, SAMPLE, NUMBER = r"…+か。?\s*\z", r"^\s*…+", r"^\s*(\d{1,9})\."
LABELS, CLASSES, WIDE = ("ます形", "て形"), ("Ⅰ", "Ⅱ", "Ⅲ"), 0.25
PARTICLES = ("は", "が", "を", "に", "で", "と", "も", "へ", "から", "まで", "や", "、")
LETTERS = "STUVWXYZ"
SEGMENTS = "array<struct<x:double,text:string>>"


def _joined(segments: Column) -> Column:
    return T.collapse_ws(F.array_join(segments["text"], " "))


def _cleaned(segments: Column) -> Column:
    """Without arrows and the white space around texts; what is then empty goes."""
    return F.filter(F.transform(segments, lambda s: F.struct(s["x"].alias("x"), T.trimmed(F.replace(s["text"], F.lit("→"), F.lit(""))).alias("text"))), lambda s: s["text"] != "")


def _collected(rows: DataFrame, keys: list[str], line: str, raw: str | None, segments: str) -> DataFrame:
    """keys, lines: each table's lines (line, raw, segments) in order."""
    held = F.struct(F.col(line).cast("bigint").alias("line"), (F.col(raw) if raw else F.lit("")).alias("raw"), F.col(segments).cast(SEGMENTS).alias("segments"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(held)).alias("lines"))


def _columns(lines: Column) -> Column:
    """The columns (x, text) of a table: its first line, whose label goes."""
    first = F.get(lines, F.lit(0))["segments"]
    return F.slice(first, 2, F.size(first))


def _based(lines: Column, of) -> Column:
    """of(xs, starts, texts), the columns of the table's first line: where they stand and begin, what they say."""
    told = lambda base, xs: bound(layout.column_starts(xs), lambda starts: bound(base["text"], lambda texts: of(xs, starts, texts)))
    return bound(_columns(lines), lambda base: bound(base["x"], lambda xs: told(base, xs)))


def _question(lines: Column, starts: Column, texts: Column, chosen: Column) -> Column:
    """The last question line of a table as a sentence, see tables.reconstruct_question: what it prints in each column, and the column where its ellipsis begins."""
    def placed(s: Column) -> Column:
        asked = s["text"].rlike(QUESTION)
        said = F.when(asked, T.trimmed(F.regexp_replace(s["text"], QUESTION, ""))).otherwise(T.trimmed(F.regexp_replace(s["text"], r"…+\z", "")))
        return F.struct(layout.last_crossed(s["x"], starts).alias("column"), asked.alias("asked"), said.alias("said"))

    def told(p: Column) -> Column:
        text = lambda c: T.collapse_ws(F.array_join(F.filter(p, lambda s: (s["column"] == c) & (s["said"] != ""))["said"], " "))
        printed = F.filter(F.transform(F.array_distinct(p["column"]), lambda c: F.struct(c.alias("column"), text(c).alias("text"))), lambda e: e["text"] != "")
        start = F.try_element_at(F.filter(p, lambda s: s["asked"]), F.lit(-1))["column"]
        return bound(F.struct(F.map_from_entries(printed).alias("values"), start.alias("start")), lambda q: tables.reconstruct_question(texts, q["values"], q["start"], chosen))

    last = F.try_element_at(F.filter(lines, lambda r: r["question"]), F.lit(-1))
    return bound(last, lambda q: F.when(q.isNotNull(), bound(F.transform(q["segments"], placed), told)))


def _upto_sample(lines: Column) -> Column:
    """The lines under the base that print something, each with whether it is a question, up to the first sample."""
    def flagged(r: Column) -> Column:
        question = r["raw"].rlike(QUESTION)
        return F.struct(r["segments"].alias("segments"), question.alias("question"), (r["raw"].rlike(SAMPLE) & ~question).alias("sample"))

    held = F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda r: F.size(r["segments"]) > 0), flagged)
    cut = lambda f: bound(F.array_position(f["sample"], True).cast("int"), lambda at: F.when(at > 0, F.slice(f, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(f))
    return bound(held, cut)


def _letter(i: Column) -> Column:
    return F.when(i < len(LETTERS), F.substring(F.lit(LETTERS), i + 1, F.lit(1))).otherwise(F.concat(F.lit("S"), i.cast("string")))


def _candidates(lists: Column, i: Column, own: Column) -> Column:
    """count, gap, places, found of slot i, whose text in the base is own: lists has for each line what it puts into each slot, null for nothing."""
    def step(a: Column, r: Column) -> Column:
        text, fresh = F.get(r, i), F.coalesce(own != "", F.lit(False))
        of = lambda count, gap, place, found: F.struct(count.alias("count"), gap.alias("gap"), F.array_append(a["places"], place).alias("places"), found.alias("found"))
        gap = F.coalesce(a["gap"], F.when(own == "", F.lit(0)).otherwise(a["count"] + fresh.cast("int")))
        new = a["gap"].isNull() & fresh
        none = of(a["count"] + new.cast("int"), gap, gap, F.when(new, F.array_append(a["found"], F.lit(""))).otherwise(a["found"]))
        return F.when(text.isNotNull(), of(a["count"] + 1, a["gap"], a["count"] + 1, F.array_append(a["found"], text))).otherwise(none)

    start = F.struct(F.lit(0).alias("count"), F.lit(None).cast("int").alias("gap"), F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(lists, start, step)


def _substitution(lines: Column) -> Column:
    """template, slots, rows, question of one table, see substitution."""
    def cells(segments: Column, xs: Column, starts: Column) -> Column:
        """For each column its segments, the sum of where they stand."""
        placed = F.transform(_cleaned(segments), lambda s: F.struct(s["x"].alias("x"), s["text"].alias("text"), layout.last_crossed(s["x"], starts).alias("column")))
        cell = lambda s: F.struct(s.alias("segments"), F.aggregate(s, F.lit(0.0), lambda a, e: a + e["x"]).alias("sum"))
        return bound(placed, lambda p: F.transform(places(xs), lambda c: bound(F.filter(p, lambda e: e["column"] == c), cell)))

    def places(xs: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(xs), F.lit(1)) - 1)

    def chosen(told: Column, xs: Column, texts: Column) -> Column:
        differs = lambda s, c: (F.size(s) > 0) & ~_joined(s).eqNullSafe(F.get(texts, c))
        some = F.filter(places(xs), lambda c: F.exists(told, lambda t: differs(F.get(t, c)["segments"], c)))
        return bound(some, lambda s: F.when(F.size(s) > 0, s).when(F.size(texts) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))

    def totals(told: Column, xs: Column) -> Column:
        add = lambda c: lambda a, t: F.struct((a["sum"] + F.get(t, c)["sum"]).alias("sum"), (a["n"] + F.size(F.get(t, c)["segments"])).alias("n"))
        return F.transform(places(xs), lambda c: F.aggregate(told, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), add(c)))

    def put(t: Column, total: Column, xs: Column, slots: Column) -> Column:
        """What a line puts into each slot, null for nothing."""
        mean = lambda e, c: (F.get(xs, c) + F.get(total, c)["sum"] - e["sum"]) / (1 + F.get(total, c)["n"] - F.size(e["segments"]))
        state = F.transform(t, lambda e, c: F.struct(c.alias("column"), e["segments"].alias("segments"), mean(e, c).alias("mean"), (F.size(e["segments"]) > 0).alias("printed")))
        text = lambda s: F.when(F.size(s) > 0, _joined(s))
        return bound(tables.slots_filled(state, slots), lambda f: F.transform(slots, lambda m: text(F.get(f, m)["segments"])))

    def lists(told: Column, xs: Column, slots: Column) -> Column:
        return bound(totals(told, xs), lambda total: F.filter(F.transform(told, lambda t: put(t, total, xs, slots)), lambda r: F.exists(r, lambda x: x.isNotNull())))

    def written(held: Column, starts: Column, texts: Column, slots: Column, own: Column, found: Column) -> Column:
        shown = lambda t, k: F.when(k >= 0, F.concat(F.lit("{"), _letter(k), F.lit("}"))).otherwise(t)
        template = F.array_join(F.transform(texts, lambda t, i: bound((F.array_position(slots, i) - 1).cast("int"), lambda k: shown(t, k))), "")
        entry = lambda m, i: F.struct(_letter(i).alias("k"), F.concat(F.array(F.get(texts, m)), F.get(found, i)["found"]).alias("v"))
        zeros = F.array(F.transform(slots, lambda m: F.lit(0)))
        rows = F.concat(zeros, F.transform(own, lambda r, l: F.transform(found, lambda s: F.get(s["places"], l))))
        return F.struct(template.alias("template"), F.map_from_entries(F.transform(slots, entry)).alias("slots"), rows.alias("rows"), _question(held, starts, texts, slots).alias("question"))

    def with_slots(held: Column, told: Column, xs: Column, starts: Column, texts: Column, slots: Column) -> Column:
        found = lambda own: F.transform(slots, lambda m, i: _candidates(own, i, F.get(texts, m)))
        return bound(lists(told, xs, slots), lambda own: bound(found(own), lambda each: written(held, starts, texts, slots, own, each)))

    def with_lines(held: Column, xs: Column, starts: Column, texts: Column) -> Column:
        told = F.transform(F.filter(held, lambda r: ~r["question"]), lambda r: cells(r["segments"], xs, starts))
        return bound(told, lambda t: bound(chosen(t, xs, texts), lambda slots: with_slots(held, t, xs, starts, texts, slots)))

    return _based(lines, lambda xs, starts, texts: bound(_upto_sample(lines), lambda held: with_lines(held, xs, starts, texts)))


def substitution(rows: DataFrame, keys: list[str], line: str, raw: str, segments: str) -> DataFrame:
    """keys, template, slots (letter to candidates), rows (places in these, one a slot), question: substitution tables.

    The first line is the base: a label and the columns. The others print what they put in place of a column; a line that begins with an
    ellipsis gives sample answers and ends the table, one that ends in an ellipsis and か is the base as a question. A column where any
    line differs from the base is a slot, the first one if there is none. A slot that a line leaves out may take the nearest text before
    it (see tables.redistribute_slots), else it is empty there. Lines that fill no slot go. Candidates stand in the order of lines, the
    base's first, an empty one once.
    """
    made = _collected(rows, keys, line, raw, segments).select(*keys, _substitution(F.col("lines")).alias("made"))
    return made.select(*keys, "made.template", "made.slots", "made.rows", "made.question")


def label_columns(header: Column, labels: tuple[str, ...] = LABELS, most: int = 4) -> Column:
    """Where the columns of a header begin: at each segment that is a label, spaces aside, or one together with the segment after it."""
    text = lambda s: F.replace(s["text"], F.lit(" "), F.lit(""))
    pairs = F.transform(header, lambda s, i: F.struct(s["x"].alias("x"), text(s).alias("one"), F.concat(text(s), text(F.get(header, i + 1))).alias("both")))
    start = F.struct(F.lit(False).alias("taken"), F.array().cast("array<double>").alias("xs"))

    def step(a: Column, s: Column) -> Column:
        more = F.struct((~s["one"].isin(*labels)).alias("taken"), F.array_append(a["xs"], s["x"]).alias("xs"))
        hit = s["one"].isin(*labels) | F.coalesce(s["both"].isin(*labels), F.lit(False))
        return F.when(a["taken"] | ~hit | (F.size(a["xs"]) >= most), F.struct(F.lit(False).alias("taken"), a["xs"].alias("xs"))).otherwise(more)

    return F.aggregate(pairs, start, step, lambda a: a["xs"])


def _reference(lines: Column) -> Column:
    """forms of one table, see reference_table."""
    def pairs(r: Column, starts: Column) -> Column:
        placed = F.transform(F.filter(r["segments"], lambda s: ~s["text"].isin(*CLASSES)), lambda s: F.struct(layout.last_crossed(s["x"], starts).alias("column"), F.replace(s["text"], F.lit(" "), F.lit("")).alias("text")))
        half = lambda p, c: F.array_join(F.filter(p, lambda e: e["column"] == c)["text"], "")
        both = bound(placed, lambda p: F.array(*[F.array(half(p, a), half(p, a + 1)) for a in (0, 2)]))
        return F.filter(both, lambda p: (p[0] != "") & (p[1] != "") & ~((p[0] == LABELS[0]) & (p[1] == LABELS[1])))

    under = lambda starts: F.flatten(F.transform(F.slice(lines, 2, F.size(lines)), lambda r: pairs(r, starts)))
    none = F.array().cast("array<array<string>>")
    return bound(bound(_columns(lines), lambda header: label_columns(header)), lambda xs: F.coalesce(F.when(F.size(xs) == 4, bound(layout.column_starts(xs, WIDE), under)), none))


def reference_table(rows: DataFrame, keys: list[str], line: str, segments: str) -> DataFrame:
    """keys, forms (array of pairs): a table whose lines hold two pairs of forms side by side, under a header that says where they stand.

    Segments go to the header's columns (see layout.column_of), class marks go; a pair counts if both its halves are there and it is no
    repeated header. A table without four labelled columns has no forms.
    """
    return _collected(rows, keys, line, None, segments).select(*keys, _reference(F.col("lines")).alias("forms"))


def _conjugations(lines: Column) -> Column:
    """forms of one table, see conjugations."""
    def best(told: Column, n: Column) -> Column:
        """The most frequent starts of the rows of n texts, of equals those seen first: a fold over the rows in order of starts."""
        votes = F.sort_array(F.filter(F.transform(told, lambda r, i: F.struct(F.when(r["n"] == n, r["starts"]).alias("starts"), i.alias("i"))), lambda v: v["starts"].isNotNull()))
        top = "struct<votes:int,first:int,starts:array<int>>"

        def step(a: Column, v: Column) -> Column:
            same = F.coalesce(a["starts"] == v["starts"], F.lit(False))
            count, first = F.when(same, a["votes"] + 1).otherwise(1), F.when(same, a["first"]).otherwise(-v["i"])
            now = F.struct(count.alias("votes"), first.alias("first"), v["starts"].alias("starts"))
            return bound(now, lambda e: F.struct(e["starts"].alias("starts"), e["votes"].alias("votes"), e["first"].alias("first"), F.greatest(a["top"], e).alias("top")))

        start = F.struct(F.lit(None).cast("array<int>").alias("starts"), F.lit(0).alias("votes"), F.lit(0).alias("first"), F.lit(None).cast(top).alias("top"))
        return F.aggregate(votes, start, step)["top"]["starts"]

    def cut(r: Column, bests: Column) -> Column:
        own = F.get(F.filter(bests, lambda e: e["n"] == r["n"]), F.lit(0))["starts"]
        form = lambda b, s, i: F.array_join(F.slice(r["texts"], s + 1, F.coalesce(F.get(b, i + 1), r["n"]) - s), "")
        return bound(own, lambda b: F.transform(b, lambda s, i: form(b, s, i)))

    def voted(told: Column) -> Column:
        bests = F.transform(F.array_distinct(told["n"]), lambda n: F.struct(n.alias("n"), best(told, n).alias("starts")))
        return bound(bests, lambda b: F.filter(F.transform(told, lambda r: cut(r, b)), lambda f: f.isNotNull()))

    kept = F.filter(lines, lambda r, i: (i == 0) | ~(r["raw"].rlike(QUESTION) | r["raw"].rlike(SAMPLE)))
    base = _columns(lines)["text"]
    texts = F.transform(kept, lambda r, i: F.when(i == 0, base).otherwise(_cleaned(r["segments"])["text"]))
    told = F.transform(F.filter(texts, lambda t: F.size(t) > 0), lambda t: F.struct(t.alias("texts"), F.size(t).alias("n"), tables.form_starts(t, PARTICLES).alias("starts")))
    return bound(told, voted)


def conjugations(rows: DataFrame, keys: list[str], line: str, raw: str, segments: str) -> DataFrame:
    """keys, forms: tables each of whose lines is several forms, cut as tables.conjugation_forms does; question and sample lines go."""
    return _collected(rows, keys, line, raw, segments).select(*keys, _conjugations(F.col("lines")).alias("forms"))


def pattern_tables(rows: DataFrame, keys: list[str], line: str, raw: str, segments: str, reference: Column) -> DataFrame:
    """keys, at, table_no, kind, template, slots, rows, question, forms: the tables of a section's lines, each by the parser that it needs.

    A line that begins with a number and a point opens a table; lines before the first go. kind: reference where `reference`, a condition
    on keys and table_no, holds; conjugation where a text of the first line comes again (see tables.form_starts); else substitution. What a
    kind does not have is null. Lines are dealt out by section once; a table is collected and read by the parser of its kind alone.
    """
    order = W.partitionBy(*keys).orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    opens = F.when(F.regexp_extract(raw, NUMBER, 1) != "", F.col(line).cast("bigint"))
    lines = rows.withColumn("at", F.last(opens, ignorenulls=True).over(order)).filter("at IS NOT NULL")
    each = _collected(lines, [*keys, "at"], line, raw, segments)
    each = each.withColumn("table_no", F.regexp_extract(F.get("lines", F.lit(0))["raw"], NUMBER, 1).cast("bigint"))
    marked = bound(_columns(F.col("lines"))["text"], lambda texts: tables.form_marker(texts, PARTICLES)).isNotNull()
    each = each.withColumn("kind", F.when(reference, "reference").when(marked, "conjugation").otherwise("substitution"))
    made = F.when(F.col("kind") == "substitution", _substitution(F.col("lines")))
    forms = F.when(F.col("kind") == "reference", _reference(F.col("lines"))).when(F.col("kind") == "conjugation", _conjugations(F.col("lines")))
    each = each.select(*keys, "at", "table_no", "kind", made.alias("made"), forms.alias("forms"))
    return each.select(*keys, "at", "table_no", "kind", "made.template", "made.slots", "made.rows", "made.question", "forms")
