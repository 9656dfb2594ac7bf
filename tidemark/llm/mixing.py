"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks of about equal words by a hash. Its quota is a number of whole blocks (all of them once for
each full pass, then some of a permutation of them, the last of them exchanged for others that fill it better) and part of one block, so that the words taken
come near the target. A binary
tree over the output shards splits the quotas: at each node a multivariate-hypergeometric draw says how many blocks of each source
go left. A shard then gets disjoint stretches of each source's permuted blocks, and its rows are ordered by a hash.

The block that is taken in part is cut into finer ones by a second hash, some of which are taken whole; only the rows of one of those,
a 16-millionth of a large source, are put in order to be taken up to a word count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, discard, kept_columns, private, quoted, stored

WEIGHTS = (5, 2, 1)
#: Times a source, and so a document, is taken at most.
MOST = 3
#: All sources together have about so many blocks.
BLOCKS = 4096
SHARDS = 8
#: Blocks taken, and blocks left, that are chosen again to fill a quota; words that these may fill.
EXCHANGED, EXACT = 64, 1 << 20


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Words to take from each source: all words shared by weight; what is above `most` times a source's size is shared again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = left * weights[i] / total
        over = {i for i in open_ if out[i] > most * sizes[i]}
        if not over:
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def split_tree(quotas: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[s] blocks of each source over the shards: row per source, column per shard; shards' totals differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        middle, total = (first + last) // 2, int(counts.sum())
        left = rng.multivariate_hypergeometric(counts, total * (middle - first) // (last - first), method="marginals")
        node(left, first, middle)
        node(counts - left, middle, last)

    node(np.array(quotas, np.int64), 0, shards)
    return out


@dataclass
class Plan:
    """For each source its blocks' takes (pass, shard) and, for one block at most, of which in the last pass so many words are taken more."""

    takes: dict[tuple[int, int], list[tuple[int, int]]]
    edges: dict[int, tuple[int, int, int, float]]


def fullest(sizes: list[int], target: int) -> list[int]:
    """Places of a subset of sizes with the largest sum that is at most target; a bit for each sum tells which can be reached."""
    reach = [1]
    for n in sizes:
        reach.append((reach[-1] | reach[-1] << n) & ((1 << target + 1) - 1))
    at, out = reach[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> at & 1:
            out.append(i)
            at -= sizes[i]
    return out[::-1]


def filling(sizes: dict[int, int], room: float, order: list[int]) -> tuple[list[int], int | None, float]:
    """Of blocks those that fill room best; the smallest of the others, to be taken in part; and the room that is left.

    In this order each that fits is taken. Then the last EXCHANGED of these and as many of the others, smallest first, are chosen again,
    to fill it as far as they can, if what they fill is at most EXACT words; blocks of more are cut finer, and fill a smaller room there.
    """
    some, skipped = [], []
    left = room
    for b in order:
        if sizes[b] <= left:
            some.append(b)
            left -= sizes[b]
        else:
            skipped.append(b)
    pool = some[-EXCHANGED:] + sorted((b for b in skipped if sizes[b]), key=lambda b: (sizes[b], b))[:EXCHANGED]
    target = int(left + sum(sizes[b] for b in some[-EXCHANGED:]))
    if pool and target <= EXACT:
        chosen = [pool[i] for i in fullest([sizes[b] for b in pool], target)]
        some = some[:-EXCHANGED] + chosen
        skipped = [b for b in order if b not in set(some)]
        left = room - sum(sizes[b] for b in some)
    skipped = [b for b in skipped if sizes[b]]
    return some, min(skipped, key=lambda b: (sizes[b], b)) if skipped and left >= 1 else None, left


def plan(blocks: dict[int, dict[int, int]], want: list[float], shards: int, seed: int) -> Plan:
    rng = np.random.default_rng(seed)
    items: list[list[tuple[int, int]]] = []
    edge_words: dict[int, tuple[int, float]] = {}
    passes = []
    for s, target in enumerate(want):
        own = blocks.get(s, {})
        size = sum(own.values())
        full = min(MOST, int(target // size)) if size else 0
        some, edge, rest = filling(own, target - full * size, rng.permutation(sorted(own)).tolist()) if full < MOST else ([], None, 0.0)
        passes.append(full)
        if edge is not None:
            edge_words[s] = (edge, rest)
        items.append([(p, b) for p in range(full) for b in sorted(own)] + [(full, b) for b in some] + ([(full, edge)] if edge is not None else []))
    quotas = split_tree([len(x) for x in items], shards, rng)
    out = Plan({}, {})
    for s, own_items in enumerate(items):
        where = np.repeat(np.arange(shards), quotas[s])
        for i, k in enumerate(rng.permutation(len(own_items)).tolist()):
            p, b = own_items[k]
            if s in edge_words and (p, b) == (passes[s], edge_words[s][0]):
                out.edges[s] = (b, p, int(where[i]), edge_words[s][1])
            else:
                out.takes.setdefault((s, b), []).append((p, int(where[i])))
    return out


TAKES = "array<struct<pass:int,shard:int>>"


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source; more columns pass through) with size (words), source_size, target, takes (array of pass, shard, place).

    A document is in the mix once for each entry of takes (at most MOST); `emitted` makes those rows. Sources in code-point order,
    null last, weigh as `weights`, repeating. Null and empty texts have size 0. Takes depend on a row's doc_id and text, the sums and
    the seed, so reruns agree, in any order and layout of the rows. The driver holds a row for each source and for each block (BLOCKS
    and one a source, twice): a recipe's size, not the corpus's. Rows equal in doc_id and text fall into the same block; no rows give
    none. Rows that the hash does not tell apart are taken or left together, but for a last few. A very long text is one row with its words
    counted: a source of one such text is taken whole, up to MOST times, or not at all. A column named like a result, in any case, is replaced.
    """
    spark = docs.sparkSession
    results = ["size", "source_size", "target", "takes"]
    keep = kept_columns(docs, results)
    name, number, n_blocks, block, fine, h, takes_, pass_, shard_, whole_, last_, words_ = private(docs.select(*map(quoted, keep)).withColumns(dict.fromkeys(results, F.lit(0))), "name", "number", "n_blocks", "block", "fine", "h", "all_takes", "pass", "shard", "whole", "last", "words")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    hashed = docs.select(*map(quoted, keep), F.xxhash64("doc_id", "text", F.lit(seed)).alias(h))
    slim = stored(hashed.select(F.col("source").cast("string").alias(name), F.col(h), size.alias("size")), "sizes")
    sums = slim.groupBy(name).agg(F.sum("size")).collect()
    sources = sorted(((r[0], r[1]) for r in sums), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in sources]
    want = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))])
    each = max(1, sum(sizes) // BLOCKS)
    names = spark.createDataFrame([(s, i, sizes[i], want[i], max(1, -(-sizes[i] // each))) for i, (s, _) in enumerate(sources)], f"{name} string, {number} int, source_size bigint, target double, {n_blocks} int")
    in_block = F.pmod(F.col(h), F.col(n_blocks)).cast("int")

    def summed(rows: DataFrame, part: str) -> dict[int, dict[int, int]]:
        out: dict[int, dict[int, int]] = {}
        for s, b, n in rows.groupBy(number, part).agg(F.sum("size")).collect():
            out.setdefault(s, {})[b] = n
        return out

    placed = slim.join(F.broadcast(names), slim[name].eqNullSafe(names[name])).select(number, h, "size", in_block.alias(block))
    made = plan(summed(placed, block), want, shards, seed)
    in_fine = F.pmod(F.xxhash64(h, F.lit(2)), F.lit(max(16, BLOCKS // max(1, len(made.edges))))).cast("int")
    rng, edges = np.random.default_rng([seed, 1]), []
    if made.edges:
        bounds = spark.createDataFrame([(s, b) for s, (b, _, _, _) in made.edges.items()], f"{number} int, {block} int")
        finer = summed(placed.join(F.broadcast(bounds), [number, block]).withColumn(fine, in_fine), fine)
        for s, (b, p, where, rest) in sorted(made.edges.items()):
            some, last, left = filling(finer[s], rest, rng.permutation(sorted(finer[s])).tolist())
            edges.append((s, b, p, where, some, last, round(left)))
    discard(spark, [slim])
    whole = spark.createDataFrame([(s, b, t) for (s, b), t in made.takes.items()], f"{number} int, {block} int, {takes_} {TAKES}")
    edge = spark.createDataFrame(edges, f"{number} int, {block} int, {pass_} int, {shard_} int, {whole_} array<int>, {last_} int, {words_} bigint")
    rows = hashed.join(F.broadcast(names), hashed["source"].cast("string").eqNullSafe(names[name])).withColumn(block, in_block)
    rows = rows.join(F.broadcast(whole), [number, block], "left").join(F.broadcast(edge), [number, block], "left").withColumn(fine, in_fine)
    at_last = F.coalesce(F.col(fine) == F.col(last_), F.lit(False))
    once, never = F.array(F.struct(F.col(pass_).alias("pass"), F.col(shard_).alias("shard"))), F.array().cast(TAKES)

    def taken(part: DataFrame, more: Column) -> DataFrame:
        both = F.concat(F.coalesce(takes_, never), F.when(more, once).otherwise(never))
        return part.select(*map(quoted, keep), "size", "source_size", "target", F.transform(both, lambda t: F.struct(t["pass"].alias("pass"), t["shard"].alias("shard"), F.xxhash64(h, t["pass"]).alias("place"))).alias("takes"))

    rest = taken(rows.filter(~at_last).withColumn("size", size), F.coalesce(F.array_contains(whole_, F.col(fine)), F.lit(False)))
    if not any(e[5] is not None for e in edges):
        return rest
    before = F.sum("size").over(W.partitionBy(number).orderBy(h).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return rest.unionByName(taken(rows.filter(at_last).withColumn("size", size), before + F.col("size") / 2 <= F.col(words_)))


def emitted(mixed: DataFrame) -> DataFrame:
    """One row for each time a document of mix() is taken, with shard and place instead of takes; rows of a shard are shuffled, by place, within tasks.

    Documents never taken go; no rows give none. A shard is spread over enough tasks to fill Spark's shuffle partitions. Columns of
    docs that are named shard or place are replaced.
    """
    spark = mixed.sparkSession
    keep = [c for c in kept_columns(mixed, ["shard", "place"]) if c != "takes"]
    (take,) = private(mixed, "take")
    out = mixed.select(*map(quoted, keep), F.explode("takes").alias(take)).select(*map(quoted, keep), F.col(f"{take}.shard").alias("shard"), F.col(f"{take}.place").alias("place"))
    salt = F.pmod("place", F.lit(max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return out.repartition("shard", salt).sortWithinPartitions("shard", "place")
