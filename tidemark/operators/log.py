"""The event log: merge by compound key, replay into item and concept state, flags and accepted answers.

An event has d (device), n (number on the device), i (item), t (epoch seconds), g (grade), r (milliseconds), m (mode) and maybe a
(accepted answer). Its key is (d, n); its order is (t, n, d), so that equal times of two devices have one order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.sources.shared import written

HISTORY = 10
#: Counts of different times, 16 bytes each, that a task may hold.
FEW = 1 << 20
ORDER = ("t", "n", "d")


def event_order(*, desc: bool = False) -> list[Column]:
    cols = [F.col("t"), F.coalesce(F.col("n"), F.lit(0)), F.col("d")]
    return [c.desc() for c in cols] if desc else cols


def merge_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union without repeats of (d, n); right wins over left. One shuffle on the key."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("d", "n").orderBy(F.col("_side").desc(), F.col("t").desc(), F.col("i").desc())
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_side")


def answers_only(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("m").eqNullSafe("flag"))


def item_state(events: DataFrame) -> DataFrame:
    """Last attempt and number of attempts of each item; flags do not count. Partial aggregation, no sort."""
    return answers_only(events).groupBy("i").agg(F.max("t").alias("last_sec"), F.count("*").alias("reps"))


def latest(rows: DataFrame, keys: list[str], order: list[Column], history: int = HISTORY) -> DataFrame:
    """The first `history` rows of each key in this order; the window's group limit cuts the others before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= history).drop("_k")


def hit_share(attempts: DataFrame, keys: list[str], order: list[Column], hit: Column, history: int = HISTORY) -> DataFrame:
    """keys, a: share of hits in the last `history` attempts. Hits are summed as integers and divided once, so that every engine gets the same double."""
    last = latest(attempts.withColumn("_hit", hit.cast("int")), keys, order, history)
    return last.groupBy(*keys).agg((F.sum("_hit") / F.count("*")).alias("a"))


def concept_state(attempts: DataFrame, keys: list[str], order: list[Column], hit: Column, history: int = HISTORY) -> DataFrame:
    """Share of hits in the last `history` attempts for each key, and all attempts. order: newest first and total."""
    reps = attempts.groupBy(*keys).agg(F.count("*").alias("reps"))
    return hit_share(attempts, keys, order, hit, history).join(reps, keys).select(*keys, "a", "reps")


def replay(events: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item state, concept state) of a log. bridge: i, covers (array; a concept named twice counts twice; an item may have
    several rows, so that no list grows with it); items without a row there have item state only.

    A concept's last attempts are among the last ones of its items, and its number of attempts is the sum of theirs: so each item is cut
    and counted before its events are multiplied by what it covers.
    """
    state, order = item_state(events), event_order(desc=True)
    told = latest(answers_only(events), ["i"], order).join(bridge, "i").select("t", "n", "d", "g", F.explode("covers").alias("concept"))
    reps = state.join(bridge, "i").select("reps", F.explode("covers").alias("concept")).groupBy("concept").agg(F.sum("reps").alias("reps"))
    return state, hit_share(told, ["concept"], order, F.col("g") >= 2).join(reps, "concept").select("concept", "a", "reps")


def last_flags(events: DataFrame) -> DataFrame:
    return events.filter("m = 'flag'").groupBy("i").agg(F.max("t").alias("flagged_at"))


def user_alternatives(events: DataFrame) -> DataFrame:
    """(i, a, at): each accepted answer of an item once, where it was first seen; empty ones are ignored. See mastery.listed for lists."""
    return events.filter(F.coalesce("a", F.lit("")) != "").groupBy("i", "a").agg(F.min(F.struct(*event_order())).alias("at"))


def max_seq(events: DataFrame) -> DataFrame:
    """Highest number of each device; -1 where a device has none."""
    return events.groupBy("d").agg(F.coalesce(F.max("n"), F.lit(-1)).alias("max_n"))


def median_rt(events: DataFrame, keys: list[str]) -> DataFrame:
    """Median time of each group, two middle ones averaged, 0 without any. All events count, flags with their 0 too.

    Exact, and no task holds a large group: equal times are counted first and written. Up to FEW of these counts are grouped as they are;
    more are summed by range of time, and only the ranges that hold a group's middle places are ordered.
    """
    counted = written(events.groupBy(*keys, "r").agg(F.count("*").alias("_n")), "counted")
    if counted.count() <= FEW:
        return counted.groupBy(*keys).agg(F.coalesce(F.expr("percentile(r, 0.5D, _n)"), F.lit(0.0)).alias("median_r"))
    told = ranged(counted.filter("r IS NOT NULL"), ["r"])
    over = W.partitionBy(*keys)
    held = told.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    held = held.withColumns({"_before": F.sum("_sum").over(over.orderBy("_range")) - F.col("_sum"), "_all": F.sum("_sum").over(over)})
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    held = held.filter((F.col("_before") <= hi) & (F.col("_before") + F.col("_sum") > lo)).drop("_sum").toDF(*[f"_key{i}" for i in range(len(keys))], "_same", "_before", "_all")
    rows = told.join(held, [F.col("_range") == F.col("_same"), *[F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]])
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy("r"))
    rows = rows.withColumns({"_upto": upto, "_from": upto - F.col("_n")})
    at = lambda place: F.max(F.when((F.col("_from") <= place) & (place < F.col("_upto")), F.col("r")))
    found = rows.groupBy(*keys).agg(((at(lo) + at(hi)) / 2).alias("_m"))
    names = [f"_key{i}" for i in range(len(keys))]
    found = found.toDF(*names, "_m")
    return counted.select(*keys).distinct().join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left").select(*keys, F.coalesce("_m", F.lit(0.0)).alias("median_r"))


def ranged(rows: DataFrame, order: list[str], per_range: int = 20) -> DataFrame:
    """rows with _range, from 0: the range of this order that a row lies in. Rows that are equal in `order` share one.

    A sample of places, drawn by hash, cuts the rows into as many ranges as Spark has shuffle partitions. A row is compared with every
    root-th cut, then with those of one stretch between them.
    """
    spark, place = rows.sparkSession, F.struct(*order)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = rows.select(*order).orderBy(F.xxhash64(*order)).limit(per_range * ranges).agg(F.sort_array(F.collect_list(place)).alias("_cuts"))
    cuts = drawn.head()["_cuts"][per_range::per_range]
    step = math.isqrt(len(cuts)) + 1
    array = drawn.schema["_cuts"].dataType
    both = StructType([StructField("every", array), StructField("all", array)])
    held = spark.createDataFrame([((cuts[step - 1 :: step], cuts),)], StructType([StructField("_cuts", both)]))
    rows = rows.withColumn("_cuts", held.scalar())
    passed = lambda some: F.size(F.filter(some, lambda c: c <= place))
    rows = rows.withColumn("_coarse", passed(F.col("_cuts.every")) * step)
    return rows.withColumn("_range", F.col("_coarse") + passed(F.slice(F.col("_cuts.all"), F.col("_coarse") + 1, F.lit(step)))).drop("_cuts", "_coarse")


def numbered(rows: DataFrame, key: str | None, order: list[str], name: str, per_range: int = 20) -> DataFrame:
    """rows with their number from 1 in this order, within each key; no task holds all rows of a key.

    Each range of a key (see ranged) is numbered by itself, after the rows of the key in the ranges before it.
    """
    keys, columns = [key] if key else [], rows.columns
    rows = ranged(rows, order, per_range)
    held = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = held.select(*[F.col(k).alias("_key") for k in keys], F.col("_range").alias("_same"), (F.sum("_n").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    rows = rows.join(before, [F.col("_range") == F.col("_same"), *[F.col(k).eqNullSafe(F.col("_key")) for k in keys]])
    return rows.withColumn(name, (F.col("_before") + F.col("_k")).cast("bigint")).select(*columns, name)


def previous(rows: DataFrame, key: str, order: list[str], value: str, name: str, per_range: int = 20) -> DataFrame:
    """rows with the value of the row before, within each key and in this order, which must tell a key's rows apart; null in the first one.

    As `lag` gives, but no task holds all rows of a key: each range of a key looks back by itself, and its first row at the last one of
    the range before.
    """
    columns = rows.columns
    rows = ranged(rows, order, per_range)
    boxed = F.struct(F.col(value).alias("v"))
    last = rows.groupBy(key, "_range").agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    carried = last.select(F.col(key).alias("_key"), F.col("_range").alias("_same"), F.lag("_last").over(W.partitionBy(key).orderBy("_range")).alias("_carried"))
    rows = rows.withColumn("_own", F.lag(boxed).over(W.partitionBy(key, "_range").orderBy(*order)))
    rows = rows.join(carried, [F.col("_range") == F.col("_same"), F.col(key).eqNullSafe(F.col("_key"))])
    return rows.withColumn(name, F.coalesce("_own", "_carried")["v"]).select(*columns, name)


def migrate_alternatives(old: DataFrame, device: str, start: int) -> DataFrame:
    """Legacy map rows (i, alts array) as events with t 0 and grade 3, numbered after `start` in order of item and position."""
    rows = numbered(old.select("i", F.posexplode("alts").alias("pos", "a")), None, ["i", "pos"], "n")
    return rows.select(F.lit(device).alias("d"), (F.col("n") + start).alias("n"), "i", F.lit(0).cast("bigint").alias("t"), F.lit(3).alias("g"), F.lit("alt").alias("m"), "a")


def exported(events: DataFrame, keys: list[str], bound: int = 10_000) -> DataFrame:
    """JSON documents {version, events} for each group of keys, events in their order; one a group, or several where it has more than `bound` events.

    A large group is dealt out by hash of the event, to documents of about half of `bound` events, so that no row grows with a group.
    """
    cols = ["t", "n", "d", "i", "g", "r", "m"]
    large = events.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound)
    large = large.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.ceil(F.col("_n") * 2 / bound).alias("_parts"))
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    rows = events.join(large, same, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*cols), "_parts"), F.lit(0)))
    body = F.sort_array(F.collect_list(F.struct(*cols)))
    return rows.groupBy(*keys, "_part").agg(F.to_json(F.struct(F.lit(1).alias("version"), body.alias("events"))).alias("json")).drop("_part")


EXPORT_SCHEMA = "version int, events array<struct<t:bigint,n:bigint,d:string,i:string,g:int,r:double,m:string>>"


def imported(documents: DataFrame, into: DataFrame) -> DataFrame:
    """Merge exported documents (json) into a log; importing twice changes nothing."""
    rows = documents.select(F.explode(F.from_json("json", EXPORT_SCHEMA)["events"]).alias("e")).select("e.*")
    return merge_events(into, rows)
