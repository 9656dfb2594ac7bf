"""Roll-ups over a scope, repairs and look-ups by item and concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.log import numbered

#: Values of a key that are listed in one row.
LIST = 1000


def scope_state(scope: DataFrame, state: DataFrame, on: str) -> DataFrame:
    """Every key in scope with its state; never attempted ones have a 0 and reps 0."""
    return scope.join(state, on, "left").withColumns({"a": F.coalesce("a", F.lit(0.0)), "reps": F.coalesce("reps", F.lit(0))})


def aggregate_skills(scoped: DataFrame, skill: Column, skills: DataFrame) -> DataFrame:
    """Unweighted mean of a over distinct scope keys of each skill, practised and total. skills: all skills (skill); one without keys has a null score."""
    sums = scoped.withColumn("skill", skill).filter("skill IS NOT NULL").groupBy("skill").agg(F.sum("a").alias("s"), F.count("*").alias("total"), F.count(F.when(F.col("reps") > 0, 1)).alias("practiced"))
    return skills.join(sums, "skill", "left").select("skill", (F.col("s") / F.col("total")).alias("score"), F.coalesce("practiced", F.lit(0)).alias("practiced"), F.coalesce("total", F.lit(0)).alias("total"))


def scope_filter(items: DataFrame, low: Column, high: Column, skills: Column, chosen: list[str], least: int, most: int) -> DataFrame:
    return items.filter((low >= least) & (high <= most) & F.arrays_overlap(skills, F.array(*map(F.lit, chosen))))


def apply_corrections(items: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Override answer and prompt where the correction has one (empty text counts), add its alternatives. fixes: key, fix_answer, fix_prompt, fix_alternatives."""
    joined = items.join(fixes, key, "left")
    return joined.withColumns(
        {
            "answer": F.coalesce("fix_answer", "answer"),
            "prompt": F.coalesce("fix_prompt", "prompt"),
            "alternatives": F.when(F.col("fix_alternatives").isNull(), F.col("alternatives")).otherwise(F.array_union("alternatives", "fix_alternatives")),
        }
    ).drop("fix_answer", "fix_prompt", "fix_alternatives")


def flagged_items(flags: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Flagged ids with what is known of the item, the time as ISO text in UTC."""
    day = F.expr("date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, flagged_at), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")")
    return flags.join(items, key, "left").withColumn("flagged_at", day)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def collision_suffix(rows: DataFrame, key: str, suffix: Column) -> Column:
    """The key, with a suffix where several rows share it."""
    return F.when(F.count("*").over(W.partitionBy(key)) > 1, F.concat(F.col(key), F.lit(":"), suffix)).otherwise(F.col(key))


def listed(rows: DataFrame, key: str, order: list[str], value: Column, name: str, bound: int = LIST) -> DataFrame:
    """key, chunk (from 0), name: the values of each key in order, `bound` to a row, so that no row grows with a key."""
    told = numbered(rows, key, order, "_n").select(key, F.floor((F.col("_n") - 1) / bound).cast("bigint").alias("chunk"), "_n", value.alias("_value"))
    return told.groupBy(key, "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_value"))), lambda r: r["_value"]).alias(name))


def inverted(rows: DataFrame, array: str, key: Column, bound: int = LIST) -> DataFrame:
    """Element -> keys that name it, in order: element, chunk, keys (see listed)."""
    return listed(rows.select(F.explode(array).alias("element"), key.alias("key")), "element", ["key"], F.col("key"), "keys", bound)


def lexicon(readings: DataFrame) -> DataFrame:
    """base -> its readings (base, kana): one reading is usable, several are ambiguous."""
    found = readings.groupBy("base").agg(F.sort_array(F.collect_set("kana")).alias("readings"))
    return found.select("base", F.when(F.size("readings") == 1, F.element_at("readings", 1)).alias("auto"), F.when(F.size("readings") > 1, F.array_join("readings", "|")).alias("ambiguous"))


def overlay(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """base, kana: the manual reading where there is one."""
    return auto.withColumnRenamed("kana", "k1").join(manual.withColumnRenamed("kana", "k2"), "base", "full").select("base", F.coalesce("k2", "k1").alias("kana"))
