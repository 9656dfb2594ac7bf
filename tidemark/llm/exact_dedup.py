"""Exact dedup by content sort: a range partition of normalised bytes, a sort, and comparisons of neighbours.

1. Each Arrow batch normalises its texts (A-Z lower-cased, null is empty) and keeps a text that it holds several times once, with the
   rows that hold it, so that copies are folded before anything is moved.
2. Spark draws splitters from a sample of keys and partitions by range: a key is the first PREFIX bytes, the first 8 bytes of the
   text's SHA-256 and the row's number, so that a sample of the largest corpus has some 50 bytes a key, texts that begin alike part,
   and a text that a third of all rows hold fills as many partitions as it needs.
3. Within a partition rows are sorted by prefix, digest and the whole text (Spark spills what does not fit), so equal texts are
   adjacent. Each is compared in full with the one before.
4. Only a partition's first and last key can go on in another partition. The groups that have such a key, a few a partition, are
   grouped by their whole text and get their size and the row to stay from all partitions.

A task holds an Arrow batch and the ids of one group in one partition, never a whole group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_columns, numbered, private, quoted, ship, stored

PREFIX = 32
FOLDED = "prefix binary, head bigint, salt bigint, text binary, digest binary, ids array<bigint>, numbers array<bigint>"
FOLDED_ARROW = pa.schema([("prefix", pa.binary()), ("head", pa.int64()), ("salt", pa.int64()), ("text", pa.binary()), ("digest", pa.binary()), ("ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))])
#: shared: the number that a group has among those of its partition that others may continue, else -1; whole: its text, in one of its rows.
MEMBERS = "doc_id bigint, number bigint, digest binary, part int, n bigint, top bigint, best boolean, shared bigint, whole binary"
MEMBERS_ARROW = pa.schema([("doc_id", pa.int64()), ("number", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("n", pa.int64()), ("top", pa.int64()), ("best", pa.bool_()), ("shared", pa.int64()), ("whole", pa.binary())])
#: Rows that a task gives at a time.
ROWS_OUT = 1 << 14


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[bytes, tuple[list[int | None], list[int]]] = {}
        for doc, number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            ids, numbers = held.setdefault((text or b"").lower(), ([], []))  # bytes.lower() changes A-Z alone
            ids.append(doc)
            numbers.append(number)
        digests = [hashlib.sha256(t).digest() for t in held]
        columns = [[t[:PREFIX] for t in held], [int.from_bytes(d[:8], "big", signed=True) for d in digests], [n[0] for _, n in held.values()], list(held), digests, [i for i, _ in held.values()], [n for _, n in held.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOLDED_ARROW, strict=True)], schema=FOLDED_ARROW)


class _Group:
    """Rows of one partition with the same text."""

    def __init__(self, text: bytes, digest: bytes, shared: int) -> None:
        self.text, self.digest, self.shared = text, digest, shared
        self.ids: list[int | None] = []
        self.numbers: list[int] = []

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """The rows, the last of those with the largest id marked as best; null is below all."""
        known = [i for i in self.ids if i is not None]
        top, n = max(known, default=None), len(self.ids)
        best = n - 1 - self.ids[::-1].index(top)
        for a in range(0, n, ROWS_OUT):
            ids = self.ids[a : a + ROWS_OUT]
            m = len(ids)
            whole = [self.text if a == 0 and self.shared >= 0 else None] + [None] * (m - 1)
            columns = [ids, self.numbers[a : a + ROWS_OUT], [self.digest] * m, [part] * m, [n] * m, [top] * m, [a + i == best for i in range(m)], [self.shared] * m, whole]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MEMBERS_ARROW, strict=True)], schema=MEMBERS_ARROW)


def _singles(groups: list[_Group], part: int) -> pa.RecordBatch:
    """The rows of groups that hold one row each and are not shared, at once."""
    n = len(groups)
    ids = [g.ids[0] for g in groups]
    columns = [ids, [g.numbers[0] for g in groups], [g.digest for g in groups], np.full(n, part, np.int32), np.ones(n, np.int64), ids, np.ones(n, bool), np.full(n, -1), [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MEMBERS_ARROW, strict=True)], schema=MEMBERS_ARROW)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a partition in content order. Those of the first key are shared; those of the last are, which is known at the end."""
    part, first, shared = TaskContext.get().partitionId(), True, 0
    key: tuple[bytes, int] | None = None
    open_: list[_Group] = []  # groups of the present key: one, unless digests collide
    singles: list[_Group] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for head, text, digest, ids, numbers in zip(*columns, strict=True):
            if (text[:PREFIX], head) != key:
                for g in open_:
                    if len(g.ids) == 1 and g.shared < 0:
                        singles.append(g)
                    else:
                        yield from g.rows(part)
                if len(singles) >= ROWS_OUT:
                    yield _singles(singles, part)
                    singles = []
                first, key, open_ = key is None, (text[:PREFIX], head), []
            if not open_ or open_[-1].text != text:
                open_.append(_Group(text, digest, shared if first else -1))
                shared += first
            open_[-1].ids += ids
            open_[-1].numbers += numbers
    for g in open_:
        if g.shared < 0:
            g.shared, shared = shared, shared + 1
        yield from g.rows(part)
    if singles:
        yield _singles(singles, part)


def exact_groups(docs: DataFrame, number: str | None = None) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text), number.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest doc_id is
    kept; null is below all others, and of rows that share the largest doc_id exactly one is kept. number: a column that tells rows
    apart and is handed back; without it rows are numbered as read. Other columns are not read; no rows give none. A text is a cell of
    an Arrow batch, so it may have up to 2 GB.
    """
    mark = quoted(number) if number else F.monotonically_increasing_id()
    folded = docs.select(F.col("doc_id").cast("bigint"), mark.cast("bigint").alias("number"), "text").mapInArrow(_fold, FOLDED)
    ordered = folded.repartitionByRange("prefix", "head", "salt").sortWithinPartitions("prefix", "head", "text", "salt")
    members = stored(ordered.select("head", "text", "digest", "ids", "numbers").mapInArrow(_compare, MEMBERS), "members")
    ends = members.filter("whole IS NOT NULL")
    best = F.max(F.struct(F.col("top").isNotNull().alias("some"), F.col("top").alias("top"), F.col("part").alias("part")))
    totals = ends.groupBy("whole").agg(F.sum("n").alias("total"), best.alias("best_of"), F.collect_list(F.struct("part", "shared")).alias("places"))
    totals = totals.select("total", F.col("best_of.top").alias("keep"), F.col("best_of.part").alias("at"), F.explode("places").alias("place")).select("total", "keep", "at", "place.part", "place.shared")
    own = members.filter("shared < 0").select("doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("best").alias("kept"), "digest", "number")
    over = members.filter("shared >= 0").join(totals, ["part", "shared"])
    over = over.select("doc_id", F.col("keep").alias("keep_id"), F.col("total").alias("group_size"), (F.col("best") & (F.col("at") == F.col("part"))).alias("kept"), "digest", "number")
    return own.unionByName(over)


def dedup_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text; more columns pass through) that exact_groups keeps, with group_size; a column so named, in any case, is replaced."""
    keep = kept_columns(docs, ["group_size"])
    (number,) = private(docs, "number")
    rows = numbered(docs.select(*map(quoted, keep)), number)
    groups = exact_groups(rows, number).filter("kept").select(F.col("number").alias(number), "group_size")
    return rows.join(groups, number).select(*map(quoted, keep), "group_size")


ship(__name__)
