"""Documents packed into blocks, and a census of hashes over all blocks.

A block is a row: some documents' ids, lengths and bytes. Blocks are written once, bucketed by their number, so that what is learnt
about them joins without moving the texts. A census asks, for hashes that each block names, how often all blocks name them: a block
sends its distinct hashes, sorted and cut into buckets of the hash's range; each bucket is sorted by itself; the answers go back in
the block's own order. What is moved is a few bytes a hash, as binary columns, and a hash named by very many documents is sent once
a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_in_worker, quoted, shared_dir, ship, stored

BLOCK_BYTES = 4 << 20
BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BLOCK_SCHEMA = "block bigint, doc_ids array<bigint>, rows array<binary>, lens array<bigint>, data binary, own array<bigint>"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.binary())), ("lens", pa.list_(pa.int64())), ("data", pa.binary()), ("own", pa.list_(pa.int64()))])
#: Bits of a block's number inside its partition, and of a document's inside its block (a document counts as 64 bytes at least). What
#: is left of 63 bits numbers 67 million partitions.
BLOCK_BITS, DOC_BITS = 20, 17
#: Bytes of texts for each bucket of a census; there are BUCKETS buckets for each shuffle partition at least.
BUCKET_BYTES, BUCKETS = 32 << 20, 2

#: Gives the hashes of a block's row, as 64-bit numbers or as pairs of them, and how often each counts (None: once).
Emit = Callable[[dict], "tuple[np.ndarray, np.ndarray | None]"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word: its bytes, in chunks of 8, through a multiplicative hash."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    padded = -(-lens // 8) * 8 + 8
    ends = np.cumsum(padded)
    flat = np.frombuffer(b"".join([w + bytes(p - n) for w, p, n in zip(words, padded.tolist(), lens.tolist(), strict=True)]), "<u8")
    place = np.arange(len(flat)) - np.repeat((ends - padded) // 8, padded // 8)
    parts = mixed(flat + mixed((place + 1).astype(np.uint64)))
    return mixed(np.add.reduceat(parts, (ends - padded) // 8) + lens.astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n at least."""
    held = kept_in_worker(f"powers-{base}")
    if len(held.get("up", ())) <= n:
        inverse = pow(base, -1, 1 << 64)
        held["up"] = np.cumprod(np.full(n + 1, base, np.uint64)) * np.uint64(inverse)
        held["down"] = np.cumprod(np.full(n + 1, inverse, np.uint64)) * np.uint64(base)
    return held["up"], held["down"]


class Strings:
    """Hashes of substrings of one array of bytes."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        self.sums: dict[int, np.ndarray] = {}

    def _hash(self, starts: np.ndarray, length: int, base: int) -> np.ndarray:
        up, down = powers(len(self.symbols) + 1, base)
        if base not in self.sums:
            values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))[self.symbols]
            self.sums[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
        sums = self.sums[base]
        return mixed((sums[starts + length] - sums[starts]) * down[starts])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self._hash(starts, length, BASE)

    def wide_at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """128 bits each, from two bases."""
        return np.stack([self._hash(starts, length, BASE), self._hash(starts, length, BASE_2)], 1)


def _pieces(text: bytes, block_bytes: int, around: int) -> Iterator[tuple[bytes, list[int]]]:
    """A long text as pieces of about block_bytes, each with `around` bytes of its neighbours on both sides, and what is its own: where the
    piece begins in the text, from and to where in the piece its own bytes lie, and whether more pieces follow."""
    step = max(block_bytes, 4 * around)
    for a in range(0, len(text), step):
        b = min(len(text), a + step)
        lo, hi = max(0, a - around), min(len(text), b + around)
        yield text[lo:hi], [a, a - lo, b - lo, int(b < len(text))]


def _pack(block_bytes: int, around: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block = TaskContext.get().partitionId() << BLOCK_BITS, 0
        ids: list[int | None] = []
        rows: list[bytes | None] = []
        texts: list[bytes] = []
        size = 0

        def made(ids: list, rows: list, texts: list[bytes], own: list[int] | None) -> pa.RecordBatch:
            nonlocal block
            if block >> BLOCK_BITS:
                raise OverflowError(f"more than {1 << BLOCK_BITS} blocks in a partition")
            block += 1
            return pa.RecordBatch.from_pylist([{"block": first + block - 1, "doc_ids": ids, "rows": rows, "lens": [len(t) for t in texts], "data": b"".join(texts), "own": own}], schema=BLOCK_ARROW)

        for batch in batches:
            for doc, text, row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if around is not None and text and len(text) > max(2 * block_bytes, 8 * around):
                    mark = first + block
                    for piece, own in _pieces(text, block_bytes, around):
                        yield made([doc], [row], [piece], [mark, *own])
                    continue
                ids.append(doc)
                rows.append(row)
                texts.append(text or b"")
                size += len(texts[-1]) + 64
                if size >= block_bytes or len(ids) >> DOC_BITS:
                    yield made(ids, rows, texts, None)
                    ids, rows, texts, size = [], [], [], 0
        if ids:
            yield made(ids, rows, texts, None)

    return run


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, row: str | None = None, around: int | None = None) -> DataFrame:
    """Blocks of docs (doc_id, text; null text is empty; row: a binary column to carry along), written to the shared folder, bucketed by block.

    around: a text much longer than a block becomes several blocks of a piece each, which share so many bytes with their neighbours; own
    then holds a number of the document, where the piece begins, from and to where in it its own bytes lie, whether more follow.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemark_blocks_{uuid.uuid4().hex}"
    carried = quoted(row) if row else F.lit(None)
    blocks = docs.select(F.col("doc_id").cast("bigint"), "text", carried.cast("binary").alias("row")).mapInArrow(_pack(block_bytes, around), BLOCK_SCHEMA)
    path = shared_dir(spark, "blocks")
    blocks.write.bucketBy(n, "block").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


def with_states(blocks: DataFrame, states: list[DataFrame]) -> DataFrame:
    """Blocks with the columns s0, s1, ... of what earlier censuses answered."""
    for i, s in enumerate(states):
        blocks = blocks.join(s.withColumnRenamed("state", f"s{i}").hint("shuffle_hash"), "block", "left")
    return blocks


def ascending(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes (numbers or pairs), and which of them, so ordered, differ from the one before."""
    order = np.argsort(h if h.ndim == 1 else h[:, 0], kind="stable")
    s = h[order]
    if h.ndim == 2:
        if (s[1:, 1] != s[:-1, 1])[s[1:, 0] == s[:-1, 0]].any():  # pairs that share their first half only
            order = np.lexsort((h[:, 1], h[:, 0]))
            s = h[order]
        return order, np.concatenate([np.ones(min(1, len(h)), bool), (s[1:] != s[:-1]).any(1)])
    return order, np.concatenate([np.ones(min(1, len(h)), bool), s[1:] != s[:-1]])


def distinct(h: np.ndarray, n: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending (numbers cut to their first `width` bytes); place of each hash among them; summed counts (at most 255)."""
    if h.ndim == 1:
        h = h >> np.uint64(64 - 8 * width)
    order, new = ascending(h)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    u = h[order[new]]
    counts = np.bincount(inverse, weights=n, minlength=len(u)) if len(u) else np.zeros(0)
    return u, inverse, np.minimum(counts, 255).astype(np.uint8)


def as_bytes(u: np.ndarray, width: int) -> np.ndarray:
    return u.astype("<u8").view(np.uint8).reshape(-1, 8 * (u.size // max(1, len(u)) or 1))[:, :width]


def from_bytes(raw: bytes, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(raw, "<u8").reshape(-1, 2)
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _send(emit: Emit, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                h, n = emit(row)
                u, _, counts = distinct(h, n, width)
                top = u[:, 0] >> np.uint64(32) if u.ndim == 2 else u >> np.uint64(8 * width - 32)
                cut = np.searchsorted(top * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                raw = as_bytes(u, width)
                pairs = [(int(b), int(cut[b]), int(cut[b + 1])) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in pairs], pa.int32()), pa.array([row["block"]] * len(pairs), pa.int64()), pa.array([raw[x:y].tobytes() for _, x, y in pairs], pa.binary()), pa.array([counts[x:y].tobytes() for _, x, y in pairs], pa.binary())], names=["bucket", "block", "hashes", "counts"])

    return run


def _answer(width: int, least: int, flags: bool):
    def run(table: pa.Table) -> pa.Table:
        sent = table.column("hashes").to_pylist()
        lens = [len(x) // width for x in sent]
        h, n = from_bytes(b"".join(sent), width), np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        order, new = ascending(h)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(n[order].astype(np.int64), first)
        code = (sums >= least) if flags else np.minimum(np.log2(np.maximum(sums, 1)) * 8, 255)
        out = np.zeros(len(h), np.uint8)
        out[order] = np.repeat(code, np.diff(first, append=len(h))).astype(np.uint8)
        cuts = np.cumsum([0, *lens])
        answers = [(np.packbits(out[a:b]) if flags else out[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array(lens, pa.int32()), "answer": pa.array(answers, pa.binary())})

    return run


def buckets_for(blocks: DataFrame) -> int:
    """Buckets of a census of these blocks: by the bytes of their texts, so that a bucket stays as small however large the corpus."""
    if not hasattr(blocks, "n_buckets"):
        total = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, n: a + n))).head()[0] or 0
        blocks.n_buckets = max(BUCKETS * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    return blocks.n_buckets


def census(blocks: DataFrame, states: list[DataFrame], emit: Emit, *, width: int, least: int = 2, flags: bool = True) -> DataFrame:
    """(block, state): for the block's distinct hashes in ascending order whether the summed counts of all blocks reach `least`, or,
    without flags, 8 times the binary logarithm of that sum. emit gives a block row's hashes and their counts (None: 1 each).

    Hashes that are numbers are told apart by their first `width` bytes, pairs of numbers (width 16) by all their bits. A task holds a
    block or a bucket; their sizes are BLOCK_BYTES and what BUCKET_BYTES of texts send, whatever the corpus.
    """
    buckets = buckets_for(blocks)
    sent = with_states(blocks, states).mapInArrow(_send(emit, width, buckets), "bucket int, block bigint, hashes binary, counts binary")
    back = sent.groupBy("bucket").applyInArrow(_answer(width, least, flags), "block bigint, bucket int, n int, answer binary")
    return stored(back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "answer"))).alias("state")), "census")


def state_of(state: list[dict] | None, flags: bool = True) -> np.ndarray:
    """The answers of a census in the order of the block's distinct hashes."""
    parts = []
    for s in state or ():
        raw = np.frombuffer(s["answer"], np.uint8)
        parts.append(np.unpackbits(raw)[: s["n"]].astype(bool) if flags else raw)
    return np.concatenate(parts) if parts else np.zeros(0, bool if flags else np.uint8)


def answers(h: np.ndarray, state: list[dict] | None, width: int, flags: bool = True) -> np.ndarray:
    """For each of the hashes that the block sent, its answer."""
    known = state_of(state, flags)
    return known[distinct(h, None, width)[1]] if len(h) else known[:0]


ship(__name__)
