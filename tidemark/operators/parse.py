"""Records out of ordered lines and fragments: the parts that are expressions, windows or joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T


def anchored(readings: DataFrame, bases: DataFrame, keys: list[str], dy: float = 12.0, slack: float = 2.5, reach: float = 12.0, tie: float = 1.0) -> DataFrame:
    """Readings (keys, rid, x, y) with the nearest base (keys, bid, x, y) above them: | |dy| - 12 | within slack, |dx| within reach.

    A later base wins only if nearer by more than `tie`, so candidates (few, by the reach) are folded in order of bid.
    """
    r, b = readings.alias("r"), bases.alias("b")
    near = [F.abs(F.col("r.y") - F.col("b.y") - dy) <= slack, F.abs(F.col("r.x") - F.col("b.x")) <= reach]
    both = r.join(b, [*[F.col(f"r.{k}") == F.col(f"b.{k}") for k in keys], *near])
    rows = both.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r.rid").alias("rid")).agg(F.sort_array(F.collect_list(F.struct(F.col("b.bid").alias("bid"), F.abs(F.col("r.x") - F.col("b.x")).cast("double").alias("d")))).alias("c"))
    start = F.struct(F.lit(None).cast("bigint").alias("bid"), F.lit(None).cast("double").alias("d"))
    step = lambda a, x: F.when(a["d"].isNull() | (x["d"] < a["d"] - tie), F.struct(x["bid"].cast("bigint").alias("bid"), x["d"].alias("d"))).otherwise(a)
    return rows.select(*keys, "rid", F.aggregate("c", start, step, lambda a: a["bid"]).alias("bid"))


def data_cells(rows: DataFrame, keys: list[str], x: str, kanji_x: float, floor: float, tolerance: float = 5.0) -> DataFrame:
    """part: kana, kanji or gloss of each cell in order of x; the state never goes back, so it is a running maximum."""
    code = F.when(F.col(x) >= floor, 2).when(F.abs(F.col(x) - kanji_x) <= tolerance, 1).otherwise(0)
    state = F.max(code).over(W.partitionBy(*keys).orderBy(x).rangeBetween(W.unboundedPreceding, 0))
    return rows.withColumn("part", F.get(F.array(F.lit("kana"), F.lit("kanji"), F.lit("gloss")), state))


def find_marker(rows: DataFrame, keys: list[str], place: str, text: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The first text of a group that comes again two places on or later. First and last place of each text decide; no pairs are made."""
    seen = rows.filter(~F.col(text).isin(*ignored)) if ignored else rows
    ends = seen.groupBy(*keys, text).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter(F.col("_last") - F.col("_first") >= 2)
    return ends.groupBy(*keys).agg(F.min_by(text, "_first").alias("marker"))


def group_starts(texts: Column, marker: Column) -> Column:
    """Places of the marker, with 0 in front."""
    places = F.filter(F.transform(texts, lambda x, i: F.when(x == marker, i)), lambda i: i.isNotNull())
    return F.array_union(F.array(F.lit(0)), places)


def fragment_chars(rows: DataFrame, key: list[str], text: str, x: str, size: str) -> DataFrame:
    """A row for each character with its own x, from the widths of those before it."""
    chars = rows.select(*key, x, size, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("place", "ch"))
    before = F.coalesce(F.sum(T.char_width(F.col("ch"), F.col(size))).over(W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return chars.select(*key, "place", "ch", (F.col(x) + before).alias("char_x"))


def fragment_end(x: Column, text: Column, size: Column) -> Column:
    return x + T.text_width(text, size)


def line_tokens(rows: DataFrame, keys: list[str], place: str, text: str) -> DataFrame:
    """Fragments of a line without what continues one: white space and an ellipsis at the line's start, across as many fragments as hold it.

    A line is one group of bounded size; only its leading part, up to the first other character, is looked at as a whole.
    """
    ordered = W.partitionBy(*keys).orderBy(place)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, text)).over(W.partitionBy(*keys))), lambda r: r[text]), "")
    out = rows.withColumns({"_whole": whole, "_at": F.coalesce(F.sum(F.length(text)).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    cut = F.length("_whole") - F.length(F.regexp_replace("_whole", r"^\s*…+", ""))
    gone = F.least(F.length(text), F.greatest(F.lit(0), cut - F.col("_at"))).cast("int")
    return out.withColumn(text, F.substring(text, gone + 1, F.length(text))).drop("_whole", "_at")


def sentences(rows: DataFrame, keys: list[str], place: str, text: str) -> DataFrame:
    """Sentences (no, sentence) of a group of lines: where any line begins with a number and a point, each such line opens one, else each
    line is one. Those without a word are left out; unnumbered ones are numbered after that."""
    label = F.regexp_extract(text, r"^\s*(\d+)\.", 1)
    out = rows.withColumn("_n", F.when(label != "", label.cast("int")))
    numbered = F.max(F.col("_n").isNotNull()).over(W.partitionBy(*keys))
    opened = F.count("_n").over(W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumns({"_numbered": numbered, "_open": opened}).filter(~F.col("_numbered") | (F.col("_open") > 0))
    unit = F.when(F.col("_numbered"), F.col("_open").cast("bigint")).otherwise(F.col(place).cast("bigint"))
    joined = out.groupBy(*keys, "_numbered", unit.alias("_unit")).agg(F.max("_n").alias("_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, text))), lambda r: r[text]), " ").alias("sentence"))
    joined = joined.filter(F.col("sentence").rlike(r"\p{L}"))
    return joined.select(*keys, F.coalesce("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_unit"))).alias("no"), "sentence")


def bracketed(pieces: Column) -> tuple[Column, Column]:
    """(other pieces, words of pieces that are wholly one bracketed word)."""
    mark = r"^[［〔\[(（]([^\s］〕\])）]+)[］〕\])）]\z"
    words = F.transform(F.filter(pieces, lambda p: p.rlike(mark)), lambda p: F.regexp_extract(p, mark, 1))
    return F.filter(pieces, lambda p: ~p.rlike(mark)), words


def trim_offsets(text: Column, offsets: Column) -> tuple[Column, Column]:
    """Trimmed text and its offsets, shifted by what was cut in front, those out of range dropped."""
    lead = F.length(text) - F.length(F.regexp_replace(text, f"^{T.SPACES}+", ""))
    short = T.trimmed(text)
    return short, F.filter(F.transform(offsets, lambda o: o - lead), lambda o: (o >= 0) & (o < F.length(short)))


def numbered_items(text: Column) -> Column:
    """ "1) a 2) b" as an array of (number, item), by printed number."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\)[^)]*?(?=\d+\)|\z))"), 1), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("no"), T.trimmed(F.regexp_replace(x, r"^\d+\)", "")).alias("item"))))


def entry(kana: Column, kanji: Column, gloss: Column) -> Column:
    """A word's cells: a spelling of marks alone belongs to the gloss; without one the reading ends at its first ideograph."""
    marks = T.is_pure_punctuation(F.coalesce(kanji, F.lit("")))
    at = T.first_ideograph(kana)
    cut = F.coalesce(kanji, F.lit("")) == ""
    return F.struct(
        T.trimmed(F.when(cut & (at > 0), F.substring(kana, F.lit(1), at)).otherwise(kana)).alias("kana"),
        F.when(cut & (at > 0), F.substring(kana, at + 1, F.length(kana))).when(marks, F.lit(None)).otherwise(F.nullif(kanji, F.lit(""))).alias("kanji"),
        T.trimmed(F.when(marks, F.concat(kanji, gloss)).otherwise(gloss)).alias("zh"),
    )


def freeform(term: Column, gloss: Column) -> Column:
    """An unnumbered word: a term with an ideograph is a spelling, else a reading; never cut."""
    there = T.first_ideograph(term) >= 0
    return F.struct(F.when(~there, term).otherwise("").alias("kana"), F.when(there, term).alias("kanji"), gloss.alias("zh"))
