"""Order-dependent steps: runs, sections, clusters, nearest hosts. Windows where a window is exact, an ordered fold where acceptance changes the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _before(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def _upto(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def section_assign(rows: DataFrame, keys: list[str], order: list[str], rank: str) -> DataFrame:
    """section: rank of the last accepted title. rank: a candidate title's place in the fixed order, null on other rows.

    A title is accepted if no title before it ranks higher. The running maximum over candidates equals that over accepted ones,
    since a rejected title is below it; so a window is exact. Rows before the first title have a null section.
    """
    accepted = F.col(rank).isNotNull() & (F.col(rank) >= F.coalesce(F.max(rank).over(_before(keys, order)), F.lit(-1)))
    out = rows.withColumn("accepted", accepted)
    return out.withColumn("section", F.last(F.when(F.col("accepted"), F.col(rank)), ignorenulls=True).over(_upto(keys, order)))


def running_groups(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """group: number of starts so far; rows before the first start have 0."""
    return rows.withColumn("group", F.sum(starts.cast("int")).over(_upto(keys, order)))


def gaps(rows: DataFrame, keys: list[str], order: list[str], value: str, most: float) -> DataFrame:
    """cell: a new one where the value is more than `most` after the row before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return running_groups(rows.withColumn("_gap", F.col(value) - F.lag(value).over(w)), keys, order, F.col("_gap") > most).withColumnRenamed("group", "cell").drop("_gap")


def split_geometry(rows: DataFrame, keys: list[str], order: list[str], x: str, size: str, least: float = 0.5, most: float = 2.0) -> DataFrame:
    """block: a new one where a row stands less than `least` after the row before, on it or back, or more than `most` times that row's size."""
    w = W.partitionBy(*keys).orderBy(*order)
    gap = F.col(x) - F.lag(x).over(w)
    broken = rows.withColumn("_broken", F.coalesce((gap < least) | (gap > most * F.lag(size).over(w)), F.lit(False)))
    return running_groups(broken, keys, order, F.col("_broken")).withColumnRenamed("group", "block").drop("_broken")


def learn_columns(rows: DataFrame, keys: list[str], x: str, own: str, order: str, hits: int = 3, apart: float = 100.0) -> DataFrame:
    """Where a group's columns stand: first, second, third.

    first: the most frequent x of the rows that are `own`, of equals the one seen first. Of the others' places, those with enough hits
    and far enough after the first count: the least is the second column, the least far enough after that the third; a single one is
    the third, and there is no second.
    """
    counted = rows.groupBy(*keys, x, own).agg(F.count("*").alias("votes"), F.min(order).alias("seen"))
    first = F.max_by(F.when(F.col(own), F.col(x)), F.when(F.col(own), F.struct(F.col("votes"), -F.col("seen")))).alias("first")
    places = F.sort_array(F.collect_set(F.when(~F.col(own) & (F.col("votes") >= hits), F.col(x)))).alias("places")
    out = counted.groupBy(*keys).agg(first, places).filter("first IS NOT NULL")
    out = out.withColumn("places", F.filter("places", lambda p: p - F.col("first") >= apart)).withColumn("one", F.get("places", F.lit(0)))
    two = F.get(F.filter("places", lambda p: p - F.col("one") >= apart), F.lit(0))
    return out.select(*keys, "first", F.when(two.isNotNull(), F.col("one")).alias("second"), F.coalesce(two, "one").alias("third"))


def merge_blocks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers as lo and hi."""
    w = W.partitionBy(*keys).orderBy(value)
    island = rows.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(w))
    return island.groupBy(*keys, "_island").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("_island")


def running_offset(rows: DataFrame, keys: list[str], order: list[str], length: Column, separator: int = 0) -> DataFrame:
    """offset: where a piece starts in the joined text."""
    return rows.withColumn("offset", F.coalesce(F.sum(length + separator).over(_before(keys, order)), F.lit(0)).cast("bigint"))


def sticky(rows: DataFrame, keys: list[str], order: list[str], flags: list[tuple[str, Column]], default: str) -> DataFrame:
    """mode: name of the first flag in the list that has been up on this or an earlier row."""
    w, mode = _upto(keys, order), F
    for name, flag in flags:
        mode = mode.when(F.max(flag.cast("int")).over(w) == 1, name)
    return rows.withColumn("mode", mode.otherwise(default))


def adjacent_match(rows: DataFrame, keys: list[str], index: str, valid: Column) -> DataFrame:
    """other: index of the first other valid row of the group, null without one. Two smallest indexes suffice."""
    least = rows.filter(valid).groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set(index)), 1, 2).alias("_two"))
    out = rows.filter(valid).join(least, keys)
    return out.withColumn("other", F.when(F.get("_two", F.lit(0)) != F.col(index), F.get("_two", F.lit(0))).otherwise(F.get("_two", F.lit(1)))).drop("_two")


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Column, step, finish) -> DataFrame:
    """One row a group: a left fold over its ordered rows, as an expression. For groups of bounded size (a page, a section)."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return rows.groupBy(*keys).agg(ordered.alias("_rows")).select(*keys, F.aggregate("_rows", start, step, finish).alias("out"))


def line_cluster(rows: DataFrame, keys: list[str], y: str, seq: str, most: float = 2.0) -> DataFrame:
    """Fragments of a page, from the top, into lines: one joins while within `most` of the line's first. Returns keys, seq, line."""
    none = F.array().cast("array<struct<seq:bigint,line:int>>")
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("line"), none.alias("out"))

    def step(a: Column, r: Column) -> Column:
        new = a["anchor"].isNull() | (F.abs(r["y"] - a["anchor"]) > most)
        line = a["line"] + new.cast("int")
        return F.struct(F.when(new, r["y"]).otherwise(a["anchor"]).alias("anchor"), line.alias("line"), F.array_append(a["out"], F.struct(r["seq"].alias("seq"), line.alias("line"))).alias("out"))

    shaped = rows.select(*keys, (-F.col(y)).alias("down"), F.col(y).cast("double").alias("y"), F.col(seq).cast("bigint").alias("seq"))
    return fold(shaped, keys, ["down", "seq"], ["y"], start, step, lambda a: a["out"]).select(*keys, F.inline("out"))


def contiguous_numbering(rows: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Numbered rows that continue 1, 2, 3 ...: one is accepted only if it is the next expected. Returns keys, order, number."""
    none = F.array().cast(f"array<struct<{order}:bigint,{number}:bigint>>")
    start = F.struct(F.lit(1).cast("bigint").alias("next"), none.alias("out"))

    def step(a: Column, r: Column) -> Column:
        hit = r[number] == a["next"]
        return F.when(hit, F.struct((a["next"] + 1).alias("next"), F.array_append(a["out"], F.struct(r[order].alias(order), r[number].alias(number))).alias("out"))).otherwise(a)

    shaped = rows.select(*keys, F.col(order).cast("bigint").alias(order), F.col(number).cast("bigint").alias(number)).filter(F.col(number).isNotNull())
    return fold(shaped, keys, [order], [number], start, step, lambda a: a["out"]).select(*keys, F.inline("out"))


def continuation_append(rows: DataFrame, keys: list[str], order: str, kind: str, text: str) -> DataFrame:
    """Entries with what continues them: kind "entry" opens, "more" appends to the open one, anything else closes it. Returns keys, order, text."""
    none = F.array().cast(f"array<struct<{order}:bigint,text:string>>")
    start = F.struct(F.lit(False).alias("open"), none.alias("out"))

    def step(a: Column, r: Column) -> Column:
        last = F.element_at(a["out"], -1)
        added = F.array_append(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.struct(last[order].alias(order), F.concat(last["text"], r["text"]).alias("text")))
        opened = F.struct(F.lit(True).alias("open"), F.array_append(a["out"], F.struct(r[order].alias(order), r["text"].alias("text"))).alias("out"))
        more = F.struct(F.lit(True).alias("open"), added.alias("out"))
        return F.when(r["kind"] == "entry", opened).when((r["kind"] == "more") & a["open"], more).when(r["kind"] == "more", a).otherwise(F.struct(F.lit(False).alias("open"), a["out"].alias("out")))

    shaped = rows.select(*keys, F.col(order).cast("bigint").alias(order), F.col(kind).alias("kind"), F.col(text).alias("text"))
    return fold(shaped, keys, [order], ["kind", "text"], start, step, lambda a: a["out"]).select(*keys, F.inline("out"))


def column_starts(columns: Column, share: float = 0.2) -> Column:
    """From where on an x has crossed each column: its start, less a share of the gap before it."""
    return F.transform(columns, lambda c, i: c - share * F.coalesce(c - F.get(columns, i - 1), F.lit(0.0)))


def last_crossed(x: Column, starts: Column) -> Column:
    """Index of the last column that x has crossed, see column_starts; 0 for none."""
    return F.coalesce(F.array_max(F.transform(starts, lambda s, i: F.when(x >= s, i))), F.when(starts.isNotNull(), F.lit(0)))


def column_of(x: Column, columns: Column, share: float = 0.2) -> Column:
    """Index of the last column that x has crossed: past its start, less a share of the gap before it."""
    return last_crossed(x, column_starts(columns, share))


def host_fragments(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Fragments (x, right) strictly inside others of their line, each with its shortest host. The keys keep the join an equi-join."""
    f, h = rows.alias("f"), rows.alias("h")
    same = [F.col(f"f.{k}") == F.col(f"h.{k}") for k in keys]
    both = f.join(h, [*same, F.col("h.x") < F.col("f.x"), F.col("f.x") < F.col("h.right")])
    best = F.min(F.struct((F.col("h.right") - F.col("h.x")).alias("span"), F.col(f"h.{seq}").alias("host")))
    return both.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], F.col(f"f.{seq}").alias(seq)).agg(best["host"].alias("host"))


def longest_prefix(words: DataFrame, word: str, forms: DataFrame, form: str, tails: list[str] | None = None) -> DataFrame:
    """Words with the longest form that begins them, and what is left; the tail may have to be one of `tails`. Cuts are exploded, so the join is on equality."""
    cut = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.length(word)))).filter(F.length(word) > 0)
    cut = cut.withColumns({"head": F.substring(word, F.lit(1), F.col("cut")), "tail": F.substring(word, F.col("cut") + 1, F.length(word))})
    hit = cut.join(forms.select(F.col(form).alias("head")).distinct(), "head")
    hit = hit if tails is None else hit.filter(F.col("tail").isin(*tails))
    return hit.groupBy(word).agg(F.max_by(F.struct("head", "tail"), "cut").alias("m")).select(word, "m.head", "m.tail")


def boundary_vote(rows: DataFrame, keys: list[str], choice: str, order: str) -> DataFrame:
    """The most frequent choice of each group; of equals the one seen first."""
    votes = rows.groupBy(*keys, choice).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return votes.groupBy(*keys).agg(F.max_by(choice, F.struct(F.col("votes"), -F.col("first"))).alias(choice), F.max("votes").alias("votes"))


def slot_detect(cells: DataFrame, keys: list[str], row: str, column: str, value: str) -> DataFrame:
    """Columns of a table where some row differs from the base row (number 0)."""
    base = cells.filter(F.col(row) == 0).select(*keys, column, F.col(value).alias("_base"))
    return cells.join(base, [*keys, column]).groupBy(*keys, column).agg(F.bool_or(~F.col(value).eqNullSafe(F.col("_base"))).alias("varies")).filter("varies").drop("varies")
