"""Shards of near equal bytes by sampled splitters. DataFrame functions only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import kept_columns, numbered, private, quoted

#: Ranges for each shard; keys drawn for each range; cells that a range is subdivided into.
RANGES, DRAWN, CELLS = 64, 16, 1024
#: A range of so many times the mean size is overfull. A cell above this share of a shard is placed by itself, one above a shard's
#: size (a group of equal texts, of which there are fewer than shards) is cut by row into PIECES for each shard it would fill.
OVERFULL, GIANT, PIECES = 3, 0.025, 64
STEP = 24


def rank_among(key: Column, splitters: list[int]) -> Column:
    """How many of the ascending splitters are at most key: first among every STEP-th, then within that stretch."""
    if not splitters:
        return F.lit(0)
    every = F.array(*map(F.lit, splitters[STEP - 1 :: STEP])) if len(splitters) >= STEP else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(every, lambda s: s <= key)) * STEP
    return coarse + F.size(F.filter(F.slice(F.array(*map(F.lit, splitters)), coarse + 1, STEP), lambda s: s <= key))


def splitters_of(drawn: list[tuple[int, float]], ranges: int) -> list[int]:
    """Quantile boundaries of weighted keys: at most ranges - 1, ascending, distinct."""
    drawn = sorted(drawn)
    total, out, at = sum(w for _, w in drawn), [], 0.0
    for key, w in drawn:
        if at + w > total * (len(out) + 1) / ranges and len(out) < ranges - 1:
            out.append(key)
        at += w
    return sorted(set(out))


def placed(ranges: dict[int, int], cells: dict[int, dict[int, int]], giants: dict[tuple[int, int], list[int]], room: list[float]) -> dict[tuple[int, int], int]:
    """Shard of each unit (range, cell; cell -1: the whole range), filling the shards' room in order of range and cell by each unit's middle."""
    units = [((r, c), n) for r in sorted(ranges) for c, n in (sorted(cells[r].items()) if r in cells else [(-1, ranges[r])]) if (r, c) not in giants]
    scale = sum(n for _, n in units) / max(1e-9, sum(room))
    ends, out, at, shard = list(accumulate(x * scale for x in room)), {}, 0.0, 0
    for unit, n in units:
        while shard < len(room) - 1 and at + n / 2 >= ends[shard]:
            shard += 1
        out[unit] = shard
        at += n
    return out


def crossing(ranges: dict[int, int], cells: dict[int, dict[int, int]], giants: dict[tuple[int, int], list[int]], room: list[float]) -> set[int]:
    """Ranges that hold a boundary between two shards."""
    sizes = [(r, sum(n for c, n in cells[r].items() if (r, c) not in giants) if r in cells else ranges[r]) for r in sorted(ranges)]
    scale = sum(n for _, n in sizes) / max(1e-9, sum(room))
    ends, out, at = [x * scale for x in accumulate(room)][:-1], set(), 0.0
    for r, n in sizes:
        if any(at < e < at + n for e in ends):
            out.add(r)
        at += n
    return out - set(cells)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text; more columns pass through) with size, law ("bytes"), shard (0 to shards - 1), slot (gapless from 0 in each shard).

    size: UTF-8 bytes of the text (null: none) plus 1. Equal texts share a key, so a group stays in one shard unless it alone is
    larger than a shard; then it is cut by row, by a number that each row gets when docs is stored, so that rows equal in all columns
    part too. Steps: draw keys with a chance in proportion to size; their weighted quantiles bound the ranges; sum the true sizes;
    subdivide ranges that are overfull or hold a boundary into cells of keys; place cells above GIANT of a shard one by one on the
    emptiest shard, the rest in order. The driver gets keys and sums whose number depends on `shards` alone. Null doc_ids, null and
    empty texts and repeated rows are rows like others; no rows give none. Shards equally empty are filled from the first. A very long text
    is one row, in one shard; only its size and hash are computed, and shards can then differ by as much as it is long. A column named like a result, in any case, is replaced.
    """
    spark = docs.sparkSession
    results = ["size", "law", "shard", "slot"]
    keep = kept_columns(docs, results)
    key, number, range_, cell, unit_, pieces, bucket, n_, before_, place_ = private(docs, *results, "key", "number", "range", "cell", "unit", "pieces", "bucket", "n", "before", "place")[4:]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    rows = numbered(docs.select(*map(quoted, keep), size.alias("size"), F.xxhash64("text").alias(key)), number)
    total, count = rows.agg(F.sum("size"), F.count("*")).head()
    total, n_ranges = total or 1, shards * RANGES
    chance = F.col("size") * (n_ranges * DRAWN / total)
    drawn = rows.filter(F.pmod(F.xxhash64(key, number), F.lit(1 << 30)) < chance * (1 << 30)).select(key, F.greatest(chance, F.lit(1.0)).alias("w"))
    splitters = splitters_of([(r[0], r[1]) for r in drawn.groupBy(key).agg(F.sum("w")).collect()], n_ranges)
    rows = rows.withColumn(range_, rank_among(F.col(key), splitters)).withColumn(cell, F.pmod(F.xxhash64(key, F.lit(3)), F.lit(CELLS)).cast("int"))
    ranges = {r[0]: r[1] for r in rows.groupBy(range_).agg(F.sum("size")).collect()}

    def cells_of(some: set[int]) -> dict[int, dict[int, int]]:
        out: dict[int, dict[int, int]] = {r: {} for r in some}
        if some:
            for r, c, n in rows.filter(F.col(range_).isin(*some)).groupBy(range_, cell).agg(F.sum("size")).collect():
                out[r][c] = n
        return out

    fair = total / shards
    cells = cells_of({r for r, n in ranges.items() if n > OVERFULL * total / n_ranges})
    room = [fair] * shards
    sizes = {(r, c): n for r, own in cells.items() for c, n in own.items() if n > GIANT * fair}
    parts: dict[tuple[int, int], list[int]] = {unit: [n] for unit, n in sizes.items()}
    for unit, n in sizes.items():
        if n > fair:
            parts[unit] = [0] * min(CELLS, PIECES * -(-n // max(1, int(fair))))
            piece = F.pmod(F.xxhash64(number), F.lit(len(parts[unit]))).cast("int")
            for p, m in rows.filter((F.col(range_) == unit[0]) & (F.col(cell) == unit[1])).groupBy(piece).agg(F.sum("size")).collect():
                parts[unit][p] = m
    giants = {unit: [0] * len(own) for unit, own in parts.items()}
    for n, unit, i in sorted(((n, unit, i) for unit, own in parts.items() for i, n in enumerate(own)), key=lambda x: (-x[0], x[1:])):
        giants[unit][i] = max(range(shards), key=lambda k: (room[k], -k))
        room[giants[unit][i]] -= n
    room = [max(0.0, x) for x in room]
    cells |= cells_of(crossing(ranges, cells, giants, room))
    units = [(r, c, [s]) for (r, c), s in placed(ranges, cells, giants, room).items()] + [(r, c, s) for (r, c), s in giants.items()]
    where = spark.createDataFrame(units, f"{range_} int, {unit_} int, {pieces} array<int>")
    split = F.array(*map(F.lit, sorted(cells))) if cells else F.array().cast("array<int>")
    rows = rows.withColumn(unit_, F.when(F.array_contains(split, F.col(range_)), F.col(cell)).otherwise(-1))
    rows = rows.join(F.broadcast(where), [range_, unit_])
    rows = rows.withColumn("shard", F.get(pieces, F.pmod(F.xxhash64(number), F.size(pieces)).cast("int")))
    buckets = max(1, round((count / shards) ** 0.5))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(number, F.lit(11)), F.lit(buckets)))
    held = rows.groupBy("shard", bucket).agg(F.count("*").alias(n_))
    before = F.sum(n_).over(W.partitionBy("shard").orderBy(bucket)) - F.col(n_)
    starts = held.select("shard", bucket, before.alias(before_))
    place = F.row_number().over(W.partitionBy("shard", bucket).orderBy(number))
    out = rows.withColumn(place_, place).join(starts.hint("merge"), ["shard", bucket])
    return out.select(*map(quoted, keep), "size", F.lit("bytes").alias("law"), "shard", (F.col(before_) + F.col(place_) - 1).cast("bigint").alias("slot"))
