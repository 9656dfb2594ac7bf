"""Benchmark decontamination by winnowing.

The hash of every run of K words is taken and, for each window of K + GUARANTEE - 1 = SPAN words, the least of its hashes is a
fingerprint. Equal windows have equal least hashes, so joining documents' fingerprints with the benchmark's loses no shared span of
SPAN words or more. A hit is then extended to its whole window and compared word by word; neighbouring windows make up the whole shared
passage. Items of fewer than SPAN words are one window each, looked up by the hash of all their words and compared likewise.

A benchmark of at most BLOCK_BYTES of words goes to the executors for a broadcast hash join inside one pass over the documents: words
are numbers there, and nothing is shuffled. A larger one is joined by shuffles: fingerprints first, then, for documents with a hit, the
windows that have the fingerprint; no task holds more than a document and its matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.blocks import word_hashes
from tidemark.llm.common import ascii_lower, by_place, kept_columns, numbered, private, quoted, ship

SPAN, K = 10, 5
GUARANTEE = SPAN - K + 1
BLOCK_BYTES = 8 << 20
#: An item is cut into stretches of so many words, overlapping by SPAN - 1, so that one item can fill several blocks.
STRETCH = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words stay, A-Z become a-z, all else becomes a space.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def run_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` ids; one for each start."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h = h * BASE + wide[j : j + n]
    return mixed(h)


def least(h: np.ndarray, width: int) -> np.ndarray:
    out = h[: max(0, len(h) - width + 1)].copy()
    for j in range(1, width):
        np.minimum(out, h[j : j + len(out)], out=out)
    return out


class Members:
    """A set of 64-bit hashes: a bit table first, then a binary search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.values >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices into h of those that are members."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.values) or not len(at):
            return at[:0]
        place = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[place] == h[at]]


class Windows:
    """All distinct windows of one length with the items that hold each."""

    def __init__(self, length: int, rows: np.ndarray, items: np.ndarray) -> None:
        self.length = length
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), items], 1), axis=0)
        self.items, self.starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        h = np.array([run_hashes(r, length)[0] for r in self.rows], np.uint64) if len(self.rows) < 64 else self._hashes()
        order = np.argsort(h, kind="stable")
        self.rows, self.hashes = self.rows[order], h[order]
        self.order = order
        self.most_alike = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(h) else 0
        self.members = Members(self.hashes)

    def plain(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "members"}

    @classmethod
    def of(cls, plain: dict) -> Windows:
        out = cls.__new__(cls)
        vars(out).update(plain, members=Members(plain["hashes"]))
        return out

    def _hashes(self) -> np.ndarray:
        h = np.zeros(len(self.rows), np.uint64)
        for j in range(self.length):
            h = h * BASE + self.rows[:, j].astype(np.uint64)
        return mixed(h)

    def at(self, ids: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the given starts (with their hashes) those where a window occurs, and which; every word is compared."""
        keep, which = [], []
        first = np.searchsorted(self.hashes, h)
        for k in range(self.most_alike):  # more than one only where hashes collide
            place = np.minimum(first + k, len(self.hashes) - 1)
            ok = self.hashes[place] == h
            words = ids[starts[ok][:, None] + np.arange(self.length)]
            same = (words == self.rows[place[ok]]).all(1)
            keep.append(starts[ok][same])
            which.append(self.order[place[ok][same]])
        return np.concatenate(keep or [starts[:0]]), np.concatenate(which or [starts[:0]])

    def items_of(self, window: int) -> np.ndarray:
        return self.items[self.starts[window] : self.starts[window + 1]]


class Block:
    """What a pass looks for. stretches: (item_id, words, words of the whole item)."""

    def __init__(self, stretches: list[tuple[str, list[str], int]]) -> None:
        self.item_ids = sorted({s[0] for s in stretches})
        number = {x: i for i, x in enumerate(self.item_ids)}
        self.vocabulary: dict[bytes, int] = {}
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        fingerprints = []
        for item_id, words, whole in stretches:
            ids = np.array([self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words], np.int32)
            length = min(SPAN, whole)
            if 0 < length <= len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, length)
                held.setdefault(length, []).append((number[item_id], rows))
                if length == SPAN:
                    fingerprints.append(least(run_hashes(ids, K), GUARANTEE))
        self.tables = [Windows(n, np.concatenate([r for _, r in x]), np.concatenate([np.full(len(r), i) for i, r in x])) for n, x in sorted(held.items())]
        self.fingerprints = Members(np.concatenate(fingerprints) if fingerprints else np.zeros(0, np.uint64))

    def plain(self) -> dict:
        """The block as dicts, lists and arrays: what is broadcast is unpacked where this package may be missing."""
        return {"item_ids": self.item_ids, "vocabulary": self.vocabulary, "tables": [t.plain() for t in self.tables], "fingerprints": self.fingerprints.values}

    @classmethod
    def of(cls, plain: dict) -> Block:
        out = cls.__new__(cls)
        out.item_ids, out.vocabulary, out.tables, out.fingerprints = plain["item_ids"], plain["vocabulary"], [Windows.of(t) for t in plain["tables"]], Members(plain["fingerprints"])
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[Windows, np.ndarray, np.ndarray]]:
        out = []
        for t in self.tables:
            h = None
            if t.length == SPAN:
                starts = self.fingerprints.find(least(run_hashes(ids, K), GUARANTEE))
                if len(starts):
                    h = mixed_at(ids, starts, SPAN)
            else:
                every = run_hashes(ids, t.length)
                starts = t.members.find(every)
                h = every[starts]
            if len(starts):
                found, which = t.at(ids, starts, h)
                if len(found):
                    out.append((t, found, which))
        return out


def mixed_at(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    words = ids[starts[:, None] + np.arange(length)].astype(np.uint64)
    h = np.zeros(len(starts), np.uint64)
    for j in range(length):
        h = h * BASE + words[:, j]
    return mixed(h)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _search(block, text_at: int, keep: list[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block.of(block.value)
        get = b.vocabulary.get
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(text_at).cast(pa.binary()).to_pylist()
                ids: list[int] = []
                starts, lens = [], []
                for t in texts:
                    words = t.translate(TO_WORDS).split() if t else []
                    starts.append(len(ids))
                    lens.append(len(words))
                    ids.extend(map(get, words, repeat(0)))
                    ids.append(0)
                first = np.array(starts)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for t, found, which in b.hits(np.array(ids, np.int32)):
                    docs = np.searchsorted(first, found, "right") - 1
                    for d in np.unique(docs).tolist():
                        own = docs == d
                        spans.setdefault(d, []).extend((p, p + t.length) for p in (found[own] - first[d]).tolist())
                        items.setdefault(d, set()).update(b.item_ids[i] for w in np.unique(which[own]).tolist() for i in t.items_of(w).tolist())
                n = range(len(texts))
                columns = [batch.column(i) for i in keep]
                columns += [pa.array(lens, pa.int64()), pa.array([merged(spans.get(d, [])) for d in n], schema.field("hit_spans").type), pa.array([sorted(items.get(d, ())) for d in n], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def words_of_text(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def stretches(benchmark: DataFrame) -> DataFrame:
    """item_id (as text; null: empty), words and whole (words of the item), one row for each stretch; items without words give none."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of_text(F.col("text")).alias("all")).filter(F.size("all") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(STRETCH)), lambda i: F.slice("all", i + 1, STRETCH + SPAN - 1))
    return rows.select("item_id", F.size("all").alias("whole"), F.explode(cut).alias("words"))


def _words(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of each text with their hashes."""
    every = [t.translate(TO_WORDS).split() if t else [] for t in texts]
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in words] for words in every]
    h = word_hashes(list(number))
    return ((words, h[i] if i else np.zeros(0, np.uint64)) for words, i in zip(every, ids, strict=True))


def _marks_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` words its fingerprint: the least hash of K words in it, or for a shorter window the hash of all."""
    return least(run_hashes(hashes, K), GUARANTEE) if length == SPAN else run_hashes(hashes, length)


def _fingerprints(lengths: list[int]):
    """(number, text) to (number, length, mark), each once a text; lengths: of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                for number, (_, h) in zip(batch.column(0).to_pylist(), _words(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    for n in lengths:
                        m = np.unique(_marks_of(h, n)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), number)), pa.array(np.full(len(m), n, np.int32)), pa.array(m)], names=["number", "length", "mark"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, text, marks: array of length and mark) to those windows with one of the marks: (number, start, length, words)."""
    for whole in batches:
        for at in range(0, len(whole), 64):
            batch = whole.slice(at, 64)
            for number, marks, (words, h) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _words(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                for n in sorted({m["length"] for m in marks}):
                    own = np.array([m["mark"] for m in marks if m["length"] == n], np.int64).view(np.uint64)
                    starts = np.flatnonzero(np.isin(_marks_of(h, n), own)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([n] * len(starts), pa.int32()), pa.array([b" ".join(words[i : i + n]) for i in starts], pa.binary())], names=["number", "start", "length", "words"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged([(s["start"], s["start"] + s["length"]) for s in x]) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["number", "spans"])


def _by_shuffles(docs: DataFrame, stretched: DataFrame, keep: list[str]) -> DataFrame:
    """decontaminate() for a benchmark of any size."""
    n, spans, items = private(docs, "number", "spans", "items")
    rows = numbered(docs.select(*[quoted(c) for c in dict.fromkeys([*keep, "text"])]), n)
    texts = rows.select(F.col(n).alias("number"), "text")
    length = F.least("whole", F.lit(SPAN)).alias("length")
    windows = stretched.filter(F.size("words") >= F.least("whole", F.lit(SPAN))).select("item_id", "words", length)
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    joined = windows.select(F.col("length").cast("bigint").alias("number"), F.array_join("words", " ").alias("text"))
    known = joined.mapInArrow(_fingerprints(lengths), "number bigint, length int, mark bigint").filter("number = length").select("length", "mark").distinct()
    marks = texts.mapInArrow(_fingerprints(lengths), "number bigint, length int, mark bigint").join(known, ["length", "mark"], "left_semi")
    hit = marks.groupBy("number").agg(F.collect_list(F.struct("length", "mark")).alias("marks"))
    found = texts.join(hit, "number").select("number", "text", "marks").mapInArrow(_windows, "number bigint, start bigint, length int, words binary")
    each = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.array_join(F.slice("words", i, F.col("length")), " ").cast("binary"))
    listed = windows.select("item_id", F.explode(each).alias("words")).distinct()
    hits = found.join(listed, "words")
    spans_of = hits.select("number", "start", "length").distinct().groupBy("number").agg(F.collect_list(F.struct("start", "length"))).mapInArrow(_merged, "number bigint, spans array<struct<start:bigint,end:bigint>>")
    items_of = hits.select("number", "item_id").distinct().groupBy("number").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    out = rows.join(spans_of.withColumnsRenamed({"number": n, "spans": spans}), n, "left").join(items_of.withColumnsRenamed({"number": n, "items": items}), n, "left")
    n_words = F.size(words_of_text(F.col("text"))).cast("bigint").alias("n_words")
    return out.select(*map(quoted, keep), n_words, F.coalesce(spans, F.array().cast(SPANS)).alias("hit_spans"), F.coalesce(items, F.array().cast("array<string>")).alias("hit_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with n_words, hit_spans (runs of hit words, from 0, end excluded) and hit_items (ids as sorted strings).

    docs needs text, benchmark item_id and text. columns: those of docs to keep, all by default; a column named like a result, in any
    case, is replaced. Null or empty texts have no words and no hits; a null item_id reads as an empty string; repeated items and rows
    are each searched, equal ids count once; an empty benchmark hits nothing; no documents give no rows.
    A very long text is searched whole: a task holds its words, and time is in proportion to them. Nothing is ranked, so there are no ties.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    results = ["n_words", "hit_spans", "hit_items"]
    keep = [c for c in kept_columns(docs, results) if columns is None or c in columns]
    rows = stretches(benchmark)
    size = rows.agg(F.sum(F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.octet_length(w) + 8))).head()[0] or 0
    if size > block_bytes:
        return _by_shuffles(docs, rows, keep)
    held = Block([(r["item_id"], r["words"], r["whole"]) for r in rows.select("item_id", "words", "whole").collect()])
    out = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, "text"])])
    schema = T.StructType([out.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    run = _search(spark.sparkContext.broadcast(held.plain()), out.columns.index("text"), [out.columns.index(c) for c in keep], to_arrow_schema(schema))
    return by_place(out).mapInArrow(run, schema)


ship(__name__)
