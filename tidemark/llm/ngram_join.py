"""N-gram Jaccard self-join as a blocked sparse product, and its components.

Rows of the incidence matrix are documents, columns their distinct word n-grams (as 64-bit hashes). Only products that can reach the
bound are formed:

1. A document of n n-grams needs ceil(0.8 n) of them in common with another, so k of the first n - ceil(0.8 n) + k in any order fixed
   for all; k is n / 10, or the partner's, whose n is at least 0.8 n. A census over blocks of documents (see blocks.py) tells which
   of these, by hash, occur twice. Documents with too few have no partner.
2. For the others a second census counts all their n-grams. One found once is in no overlap, so the s found more often bound every
   overlap; a document with s below ceil(0.8 n) is out, and its columns are its s - ceil(0.8 n) + 1 rarest ones.
3. Equal rows are one class; a class goes on as one row.
4. Each column is first multiplied with one of its rows, its head: the one with the fewest n-grams of its own (in a group of edited
   copies nearest to their original). The product is taken block by block of listed entries, whose overlaps are counted together.
   Components of these links come next. Then, in columns that hold a row outside their head's component, such rows are multiplied with
   all rows there, in pairs of blocks: rows of like sizes meet, since a size below 0.8 of another's cannot reach the bound, and
   overlaps are accumulated over whole rows. So a group of copies costs one product a member, unless members are no link of their
   head; then blocks of those meet all blocks, inside a task. No link between different components is lost, and no pairs are listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.blocks import BLOCK_BYTES, DOC_BITS, answers, census, mixed, packed, with_states, word_hashes
from tidemark.llm.common import WORD, by_place, discard, private, quoted, ship, stored

N = 5
#: Two documents link when DEN * intersection >= NUM * union.
NUM, DEN = 4, 5
NAME = 5
#: Rows of a block in the product of rows under one head; columns that are multiplied at a time.
BLOCK_ROWS, CHUNK = 512, 8192
#: Entries of the product with heads that are counted at a time, and n-grams of both sides in them.
BLOCK_ENTRIES, BLOCK_TOKENS = 1 << 14, 1 << 21
#: Tables of a few numbers a row are broadcast up to so many rows (some tens of MB), so that whole rows of the matrix stay in place.
BROADCAST_ROWS = 1 << 20
TO_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ROWS = "rid bigint, row binary, doc_id bigint, n bigint, s bigint, sig1 bigint, sig2 bigint, tokens binary, columns array<bigint>"


def shingle_sets(row: dict, n: int) -> list[np.ndarray]:
    """For each document of a block its distinct n-gram hashes, ascending; with fewer words, one for the whole sequence."""
    data, at, docs = row["data"], 0, []
    for size in row["lens"]:
        docs.append(data[at : at + size].translate(TO_LOWER).split())
        at += size
    kept: dict[bytes, int] = {}
    ids = np.array([kept.setdefault(w, len(kept)) for ws in docs for w in ws], np.int64)
    h = word_hashes(list(kept))[ids] if len(ids) else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in docs:
        own = h[at : at + len(ws)]
        at += len(ws)
        k = min(n, len(ws))
        grams = np.zeros(max(0, len(ws) - k + 1) if ws else 0, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[j : j + len(grams)]
        out.append(np.unique(mixed(grams + np.uint64(k))))
    return out


def needed(n: int) -> int:
    return -(-NUM * n // DEN)


def spare(n: int) -> int:
    """How many more of the first n-grams are looked at than one match would need, so that as many have to match."""
    return max(1, n // 10)


def firsts(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [s[: len(s) - needed(len(s)) + spare(len(s))] for s in sets]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _first_columns(n: int):
    return lambda row: (mixed(joined(firsts(shingle_sets(row, n)))), None)


def candidates(row: dict, sets: list[np.ndarray]) -> list[bool]:
    """Documents with enough of their first columns found twice: as many as the smallest partner has to spare."""
    first = firsts(sets)
    twice = answers(mixed(joined(first)), row["s0"], NAME)
    hits = np.concatenate([[0], np.cumsum(twice)])
    ends = np.cumsum([len(f) for f in first])
    return [len(s) > 0 and hits[e] - hits[e - len(f)] >= spare(needed(len(s))) for e, f, s in zip(ends.tolist(), first, sets, strict=True)]


def _all_columns(n: int):
    def emit(row: dict):
        sets = shingle_sets(row, n)
        return joined([s for s, c in zip(sets, candidates(row, sets), strict=True) if c]), None

    return emit


def _rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                sets = shingle_sets(row, n)
                chosen = candidates(row, sets)
                code = answers(joined([s for s, c in zip(sets, chosen, strict=True) if c]), row["s1"], NAME, flags=False)
                at, out = 0, []
                for k, (s, c, doc) in enumerate(zip(sets, chosen, row["doc_ids"], strict=True)):
                    made = {"rid": (row["block"] << DOC_BITS) + k, "row": row["rows"][k], "doc_id": doc, "n": len(s), "s": 0, "sig1": 0, "sig2": 0, "tokens": None, "columns": None}
                    if c:
                        own = code[at : at + len(s)]
                        at += len(s)
                        shared = s[own > 0]
                        made["s"] = len(shared)
                        if len(s) and len(shared) >= needed(len(s)):
                            rarest = np.lexsort((shared, own[own > 0]))[: len(shared) - needed(len(s)) + 1]
                            sums = np.stack([s, mixed(s)]).sum(1, dtype=np.uint64).view(np.int64)
                            short = np.unique(shared >> np.uint64(16))
                            made |= {"sig1": int(sums[0]), "sig2": int(sums[1]), "tokens": short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), "columns": (shared[rarest] >> np.uint64(1)).astype(np.int64)}
                    out.append(made)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("rid", pa.int64()), ("row", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("tokens", pa.binary()), ("columns", pa.list_(pa.int64()))]))

    return run


def tokens_of(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def overlaps(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """How many n-grams the k-th rows of both sides share, for all k: coordinates of a block of the product, accumulated by entry."""
    lens = [np.array([len(x) // 6 for x in side], np.int64) for side in (one, two)]
    place = np.concatenate([np.repeat(np.arange(len(n)), n) for n in lens]).astype(np.uint64)
    keys = (place << np.uint64(48)) | tokens_of(b"".join([*one, *two]))
    keys.sort()
    shared = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(48)
    return np.bincount(shared.astype(np.int64), minlength=len(one))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        tokens = np.cumsum(pc.add(pc.binary_length(whole.column(4)), pc.binary_length(whole.column(5))).to_numpy(zero_copy_only=False) // 6)
        at = 0
        while at < len(whole):
            end = max(at + 1, min(at + BLOCK_ENTRIES, int(np.searchsorted(tokens, (tokens[at - 1] if at else 0) + BLOCK_TOKENS, "right"))))
            batch = whole.slice(at, end - at)
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = (NUM + DEN) * overlaps(batch.column(4).to_pylist(), batch.column(5).to_pylist()) >= NUM * (na + nb)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["x", "y"])
            at = end


def can_link(s: Column, n: Column, other_s: Column, other_n: Column) -> Column:
    return F.least(s, other_s) * (NUM + DEN) >= (n + other_n) * NUM


def bounded(rows: DataFrame, size: DataFrame) -> DataFrame:
    """rows, to be broadcast if the stored table `size`, which has as many or more, has at most BROADCAST_ROWS; else shuffled like the other side."""
    return F.broadcast(rows) if size.count() <= BROADCAST_ROWS else rows


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (x, y; stored), each once, those that link. sets: rid, n, tokens."""
    one = sets.select(F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    two = sets.select(F.col("rid").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    return one.join(bounded(pairs, pairs), "x").join(two, "y").select("x", "y", "nx", "ny", "tx", "ty").mapInArrow(_overlaps, "x bigint, y bigint")


def _product(table: pa.Table) -> pa.Table:
    """Links between the two sides of a block pair (side 1: odd rows) that join different components: a forest, not all pairs."""
    side = table.column("side").to_numpy()
    rid, n, comp = (table.column(c).to_numpy() for c in ("rid", "n", "comp"))
    sets = [tokens_of(t) for t in table.column("tokens").to_pylist()]
    a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    columns = np.intersect1d(joined([sets[i] for i in a]), joined([sets[i] for i in b]))
    overlap = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(columns), CHUNK):
        part = columns[at : at + CHUNK]
        one, two = (np.zeros((len(rows), len(part)), np.float32) for rows in (a, b))
        for matrix, rows in ((one, a), (two, b)):
            for k, i in enumerate(rows):
                own = sets[i]
                place = np.searchsorted(part, own)
                place[place == len(part)] = 0
                matrix[k, place[part[place] == own]] = 1
        overlap += one @ two.T
    hit = ((NUM + DEN) * overlap >= NUM * (n[a][:, None] + n[b][None, :])) & (comp[a][:, None] != comp[b][None, :])
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    links = []
    for i, j in np.argwhere(hit).tolist():
        x, y = top(int(comp[a[i]])), top(int(comp[b[j]]))
        if x != y:
            up[x] = y
            links.append((int(rid[a[i]]), int(rid[b[j]])))
    return pa.table({"x": pa.array([x for x, _ in links], pa.int64()), "y": pa.array([y for _, y in links], pa.int64())})


def across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (x, y) between rows under heads of one component (rid, comp, head_comp; stored) that lie in different components.

    One of such a pair is odd, that is outside the heads' component. All rows there, and the odd ones once more, are cut into blocks
    of a level: sizes within a factor of DEN / NUM, so that only the same and the next levels can link. Each pair of blocks is
    multiplied as matrices in one task: both are of bounded size, however many rows there are.
    """
    is_odd = F.col("comp") != F.col("head_comp")
    level = F.floor(F.log("n") / math.log(DEN / NUM)).cast("int").alias("level")
    sized = placed.join(bounded(sets.select("rid", "n", level), placed), "rid").select("head_comp", "rid", "comp", "level")
    counts = stored(sized.groupBy("head_comp", "level").agg(F.count("*").alias("all"), F.count(F.when(is_odd, 1)).alias("odd")), "levels")
    odd = counts.filter("odd > 0").select("head_comp", F.col("level").alias("la"), F.ceil(F.col("odd") / BLOCK_ROWS).alias("na"))
    every = counts.select("head_comp", F.col("level").alias("lb"), F.ceil(F.col("all") / BLOCK_ROWS).alias("nb"))
    grid = stored(odd.join(every, "head_comp").filter(F.abs(F.col("la") - F.col("lb")) <= 1), "grid")
    rows = placed.join(bounded(grid.select("head_comp").distinct(), grid), "head_comp", "left_semi").join(sets, "rid").select("*", level)
    at, zero = F.xxhash64("rid", F.lit(5)), F.lit(0).cast("bigint")
    one = rows.filter(is_odd).join(bounded(grid.withColumn("level", F.col("la")), grid), ["head_comp", "level"])
    one = one.select("head_comp", "la", "lb", F.pmod(at, "na").alias("a"), F.explode(F.sequence(zero, F.col("nb") - 1)).alias("b"), F.lit(1).alias("side"), "rid", "n", "comp", "tokens")
    two = rows.join(bounded(grid.withColumn("level", F.col("lb")), grid), ["head_comp", "level"])
    two = two.select("head_comp", "la", "lb", F.explode(F.sequence(zero, F.col("na") - 1)).alias("a"), F.pmod(at, "nb").alias("b"), F.lit(0).alias("side"), "rid", "n", "comp", "tokens")
    return one.unionByName(two).groupBy("head_comp", "la", "lb", "a", "b").applyInArrow(_product, "x bigint, y bigint")


def components(links: DataFrame) -> DataFrame:
    """(rid, comp) for every end of a link: comp is the smallest rid reachable. Least labels of neighbours, then of labels, until none changes."""
    spark = links.sparkSession
    edges = stored(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y"), "edges")
    labels = stored(edges.groupBy(F.col("x").alias("rid")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["rid"]).groupBy("x").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels["rid"] == near["x"]).select("rid", "comp", F.least("comp", "least").alias("next"))
        jump = labels.select(F.col("rid").alias("at"), F.col("comp").alias("there"))
        moved = stored(step.join(jump, step["next"] == jump["at"], "left").select("rid", F.least("next", F.coalesce("there", "next")).alias("comp"), (F.col("comp") != F.least("next", F.coalesce("there", "next"))).alias("changed")), "labels")
        discard(spark, [labels])
        labels = moved.select("rid", "comp")
        labels.stored_at = moved.stored_at
        if not moved.filter("changed").limit(1).count():
            discard(spark, [edges])
            return labels


def join_components(docs: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES, row: str | None = None) -> DataFrame:
    """One row a document of docs (doc_id, text): rid (a number of its own), row (what docs' column of that name holds, if one is named), doc_id, n_shingles, component_id, first.

    component_id: smallest doc_id reachable by links, its own included; first: whether the row stands for its component (smallest
    doc_id, then rid). Null or empty texts, or of white space alone, have no n-grams and link with nothing. Rows with equal doc_id
    are documents of their own; a null doc_id is below all others. Of rows that share the smallest doc_id the first as read stands for them.
    A very long text is a block of its own: a task holds it with its n-grams' hashes. Other columns of docs are not read. No rows give none.
    """
    blocks = packed(docs, block_bytes, row)
    states = [census(blocks, [], _first_columns(n), width=NAME)]
    states.append(census(blocks, states, _all_columns(n), width=NAME, flags=False))
    rows = stored(with_states(blocks, states).mapInArrow(_rows(n), ROWS), "rows")
    able = rows.filter(F.col("columns").isNotNull())
    classes = stored(able.groupBy("n", "sig1", "sig2").agg(F.min("rid").alias("rep")), "classes")
    reps = able.join(bounded(classes.select(F.col("rep").alias("rid")), classes), "rid", "left_semi")
    sets = reps.select("rid", "n", "tokens")
    columns = stored(reps.select("rid", "n", "s", F.explode("columns").alias("column")), "columns")
    own = F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("alone"), "rid", "n", "s")
    heads = columns.groupBy("column").agg(F.count("*").alias("many"), F.min("n").alias("least_n"), F.min(own).alias("head")).filter("many > 1").drop("many")
    heads = stored(heads, "heads")
    alive = F.col("s") * (NUM + DEN) >= (F.col("n") + F.col("least_n")) * NUM
    table = stored(columns.join(heads, "column").filter(alive), "product")
    star = table.filter((F.col("rid") != F.col("head.rid")) & can_link(F.col("s"), F.col("n"), F.col("head.s"), F.col("head.n")))
    pairs = stored(star.select(F.greatest("rid", "head.rid").alias("x"), F.least("rid", "head.rid").alias("y")).distinct(), "pairs")
    first = stored(linked(pairs, sets), "links")
    labels = components(first)
    comp = labels.select(F.col("rid"), F.col("comp"))
    head_comp = labels.select(F.col("rid").alias("head_rid"), F.col("comp").alias("head_comp"))
    under = table.select("column", "rid", F.col("head.rid").alias("head_rid")).join(bounded(comp, labels), "rid", "left").join(bounded(head_comp, labels), "head_rid", "left")
    under = stored(under.select("column", "rid", F.coalesce("comp", "rid").alias("comp"), F.coalesce("head_comp", "head_rid").alias("head_comp")), "under")
    mixed_columns = stored(under.filter("comp <> head_comp").select("column").distinct(), "mixed")
    placed = stored(under.join(bounded(mixed_columns, mixed_columns), "column", "left_semi").drop("column").distinct(), "placed")
    second = stored(across(placed, sets), "links")
    begun = [*states, columns, heads, table, pairs, labels, under, mixed_columns, placed]
    labels = components(first.unionByName(second))
    member = able.select("rid", "n", "sig1", "sig2").join(bounded(classes, classes), ["n", "sig1", "sig2"]).select("rid", "rep")
    member = member.join(bounded(labels.withColumnRenamed("rid", "rep"), labels), "rep", "left").select("rid", F.coalesce("comp", "rep").alias("comp"))
    every = stored(rows.select("rid", "row", "doc_id", F.col("n").alias("n_shingles")).join(member, "rid", "left"), "members")
    low = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rid")
    least = stored(every.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(low).alias("low"), F.count("*").alias("many")).filter("many > 1").drop("many"), "least")
    out = every.join(bounded(least, least), "comp", "left")
    own_low = F.col("low.rid").isNull()
    out = out.select("rid", "row", "doc_id", "n_shingles", F.when(own_low, F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id"), (own_low | (F.col("rid") == F.col("low.rid"))).alias("first"))
    out = stored(out, "components")
    discard(docs.sparkSession, [blocks, *begun, first, second, rows, classes, labels, every, least])
    return out


def _first_copies(row_at: int):
    """Drops rows whose digest a row before them in the same task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for digest in batch.column(row_at).to_pylist():
                new.append(digest not in seen)
                seen.add(digest)
            yield batch.filter(pa.array(new, pa.bool_()))

    return run


def one_of_each(docs: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stand for their component (all columns), see join_components: the smallest doc_id, a null one before all others.

    Texts without n-grams (null, empty, white space) all stay. Rows are told apart by a 128-bit digest of all their columns, so those
    with equal digests are equal, and it does not matter which of them stays. Each task drops copies of its own before texts are
    shuffled, once, by digest, so a digest comes from each task once at most; what it remembers of its rows is 16 bytes each. No rows
    give none; further columns, whatever their names, pass through. A text is a cell of an Arrow batch.
    """
    row, nth = private(docs, "row", "nth")
    rows = docs.withColumn(row, F.unhex(F.md5(F.to_json(F.struct(*map(quoted, docs.columns))))))
    kept = join_components(rows, n, block_bytes, row).filter("first AND n_shingles > 0").select(F.col("row").alias(row)).distinct()
    spoken = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    own = by_place(rows.filter(spoken)).mapInArrow(_first_copies(len(docs.columns)), by_place(rows).schema).toDF(*rows.columns)
    both = own.join(kept.hint("merge"), row)
    one = both.withColumn(nth, F.row_number().over(W.partitionBy(row).orderBy(row))).filter(F.col(nth) == 1).select(*map(quoted, docs.columns))
    return one.unionByName(docs.filter(~spoken))


ship(__name__)
