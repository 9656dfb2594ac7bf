"""What to practise next: priority, buckets, pool and weighted sampling with a quota of new items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import written

SCALE_DAYS, HIGH, MID, NEW_SHARE, SEEN_DECAY, FLOOR = 7.0, 1.0, 0.4, 0.3, 0.05, 1e-6
DAY = 86400


def days_since(last: Column, now: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now) - last) / F.lit(float(DAY)))


def time_factor(days: Column) -> Column:
    """days / (days + 7); 0 for null or none."""
    return F.when(days.isNull() | (days <= 0), 0.0).otherwise(days / (days + SCALE_DAYS))


def priority(least_a: Column, last: Column, now: int) -> Column:
    return (1 - F.coalesce(least_a, F.lit(0.0))) + time_factor(days_since(last, now))


def bucket(w: Column) -> Column:
    return F.when(w >= HIGH, "high").when(w >= MID, "mid").otherwise("low")


def priorities(items: DataFrame, concepts: DataFrame, states: DataFrame, now: int) -> DataFrame:
    """items (i, covers), concepts (concept, a), states (i, last_sec) -> i, w, bucket, is_new. The least a of what an item covers counts; never seen is 0."""
    told = items.select("i", F.explode_outer("covers").alias("concept")).join(concepts, "concept", "left")
    least = told.groupBy("i").agg(F.min(F.when(F.col("concept").isNotNull(), F.coalesce("a", F.lit(0.0)))).alias("least_a"))
    out = least.join(states.select("i", "last_sec"), "i", "left").withColumn("w", priority(F.col("least_a"), F.col("last_sec"), now))
    return out.select("i", "w", bucket(F.col("w")).alias("bucket"), F.col("last_sec").isNull().alias("is_new"))


def candidate_pool(ranked: DataFrame, count: int) -> DataFrame:
    """High and mid buckets if they suffice, else all. The number is a scalar subquery over the written ranks, which are computed once."""
    ranked = written(ranked, "ranked")
    enough = ranked.agg((F.count(F.when(F.col("bucket") != "low", 1)) >= count).alias("enough"))
    return ranked.filter((F.col("bucket") != "low") | ~enough.scalar())


def draw_key(w: Column, u: Column, seen: Column | None = None) -> Column:
    """Ascending order of this key is the order of weighted draws without replacement; u in (0, 1)."""
    weight = F.greatest(F.lit(FLOOR), w)
    return -F.log(u) / (weight if seen is None else weight * F.when(seen, SEEN_DECAY).otherwise(1.0))


def pick_items(pool: DataFrame, count: int, u: Column, seen: Column | None = None) -> DataFrame:
    """`count` rows of the pool (i, w, is_new): weighted draws, new items at most NEW_SHARE of them while old ones last.

    Only the first `count` of old and of new can be picked, so each side is cut by a top-k before the ranks are taken.
    """
    keyed = pool.withColumn("_key", draw_key(F.col("w"), u, seen))
    ranked = keyed.withColumn("_nr", F.row_number().over(W.partitionBy("is_new").orderBy("_key", "i"))).filter(F.col("_nr") <= count)
    late = F.col("is_new") & (F.col("_nr") > int(NEW_SHARE * count))
    return ranked.orderBy(late, "_key", "i").limit(count).drop("_key", "_nr")


def pick_playback(pool: DataFrame, alpha: float, u: Column) -> DataFrame:
    """One row with chance in proportion to w**alpha."""
    weight = F.greatest(F.lit(FLOOR), F.pow(F.greatest(F.lit(0.0), F.col("w")), F.lit(alpha)))
    return pool.orderBy(-F.log(u) / weight, "i").limit(1)
