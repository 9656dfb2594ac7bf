"""Token-ID output: ids packed at a fixed width, in blocks that numpy unpacks and that can be read at random.

File format: a Parquet table, one row a block of whole documents, blocks in ascending order of (part, block).
  part, block      place of the block; parts are ranges of doc_id in ascending order
  doc_ids, lens    the block's documents and how many ids each has (its end id included)
  part_start       ids in the part's earlier blocks
  n_ids, bits      ids in the block, bits of one id: the least that hold the vocabulary
  payload          ids one after another, each in `bits` bits, most significant bit first, the last byte padded with 0
A document's ids are `lens[:k].sum()` ids into the block's payload, at bit `bits` times that.
Parquet's own commit makes a part appear whole or not at all, so a task that is run again leaves no second copy.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_in_worker, shared_dir, ship

BLOCK_SCHEMA = "part int, block int, doc_ids array<bigint>, lens array<bigint>, part_start bigint, n_ids bigint, bits int, payload binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary())])
#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 18
#: Words, and parts of words, that a worker keeps the ids of, at most.
STRINGS_KEPT = 800_000
#: Bytes of texts that are encoded at a time (one text at least).
SLICE_BYTES = 8 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below 2**bits) as a bit string."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8)).tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """`count` ids from the `start`-th on; reads only the bytes that hold them."""
    if bits == 16:
        return np.frombuffer(payload, ">u2", count, 2 * start).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8)[first : (start + count) * bits // 8 + 1]
    each = np.unpackbits(raw)[start * bits - first * 8 :][: count * bits].reshape(count, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


#: How a tokenizer file has to prepare texts so that each part below has ids of its own, whatever stands beside it.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that PART cuts into letters and marks, lower-cased without regard to their place: Latin letters, perhaps with ASCII marks behind.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", '!-&(-/:;=-@\\[-`{-~'
PLAIN = f"\\A[{LETTERS}]+[{MARKS}]*\\z"
SIMPLE = re.compile(f"[{LETTERS}]+|[{MARKS}]+")
EACH_LETTER, EACH_MARK = ("".join(c for c in map(chr, range(256)) if re.match(f"[{x}]", c)) for x in (LETTERS, MARKS))


class Kept:
    """Ids of strings seen of late (now), and of those before them; at most STRINGS_KEPT in all."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, strings: Collection[str]) -> list[str]:
        """Of strings those that nobody knows any more; the others are in now from here on."""
        if len(self.now) + len(strings) > STRINGS_KEPT // 2:
            self.before, self.now = self.now, {}
        strings = [s for s in strings if s not in self.now]
        self.now.update((s, self.before[s]) for s in strings if s in self.before)
        return [s for s in strings if s not in self.before]


class TextEncoder:
    """Ids of whole texts by a `tokenizers` file, equal to what the file's tokenizer gives.

    If the file lower-cases, drops white space and cuts by PART into strings that are encoded each by itself, texts are split at ASCII
    white space, the distinct words that are PLAIN are cut into letters and marks, and only new ones of these parts, and of all other
    words, go to the tokenizer. Any other file gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        cut, model = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}]), made["model"]
        self.by_parts = (
            (made["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and [x.get("type") for x in cut] == ["Split", "ByteLevel"]
            and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": PART}, "Removed", True)
            and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"])
            and model["type"] == "BPE"
            and not model.get("dropout")
            and not made["truncation"]
            and all(t["special"] and t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
        )
        self.kept = Kept()
        end = model.get("end_of_word_suffix") or None
        self.ends = np.zeros(self.vocabulary, bool)
        for piece, i in self.tokenizer.get_vocab().items() if end else ():
            self.ends[i] = piece.endswith(end)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each_part(self, parts: list[str]) -> list[bytes]:
        """Many parts go through the tokenizer as one text; where the vocabulary marks ends of parts, it tells where each one stops."""
        if not self.ends.any():
            return self._each(parts)
        out = []
        for e in self.tokenizer.encode_batch_fast([" ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)], add_special_tokens=False):
            ids, at = np.array(e.ids, np.uint32), 0
            raw = ids.tobytes()
            for end in (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist():
                out.append(raw[at:end])
                at = end
        return out if len(out) == len(parts) else self._each(parts)

    def _ids_of(self, strings: list[str]) -> list[bytes]:
        """Ids of strings that are parts or words."""
        kept = self.kept
        found = list(map(kept.now.get, strings))
        if gaps := [i for i, x in enumerate(found) if x is None]:
            new = kept.missing([strings[i] for i in gaps])
            parts, words = [], []
            for x in new:
                (parts if SIMPLE.fullmatch(x) else words).append(x)
            kept.now.update(zip(parts, self._each_part(parts), strict=True))
            kept.now.update(zip(words, self._each(words), strict=True))
            for i in gaps:
                found[i] = kept.now[strings[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, one text after another, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if self.by_parts:
            split = pc.ascii_split_whitespace(texts)
            words, ends = split.flatten().dictionary_encode(), np.diff(split.offsets.to_numpy()).cumsum() * 2
            each = words.dictionary
            plain, low = pc.match_substring_regex(each, PLAIN), pc.utf8_lower(each)
            pairs = pa.concat_arrays([pc.if_else(plain, pc.utf8_rtrim(low, EACH_MARK), each), pc.if_else(plain, pc.utf8_ltrim(low, EACH_LETTER), "")]).dictionary_encode()
            found = self._ids_of(pairs.dictionary.to_pylist())
            place = pairs.indices.to_numpy().reshape(2, -1).T[words.indices.to_numpy()].ravel()
        else:
            found, place, ends = self._each(texts.to_pylist()), np.arange(len(texts)), np.arange(1, len(texts) + 1)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), np.uint32), lens.cumsum() - lens
        n = lens[place]
        upto = np.concatenate([[0], n.cumsum()])
        return ids[np.repeat(first[place] - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[ends], prepend=0)


def encoder(path: str) -> TextEncoder:
    held = kept_in_worker("encoders")
    if path not in held:
        held[path] = TextEncoder(path)
    return held[path]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE_BYTES of texts."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64))
    cut = np.flatnonzero(np.diff((sizes.cumsum() - sizes) // SLICE_BYTES)) + 1
    edges = [0, *cut.tolist(), len(texts)]
    return zip(edges, edges[1:], strict=False)


def _blocks(path: str, bits: int, end_id: int | None):
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block, done = encoder(path), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, held, size, block, done
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_pylist([{"part": part, "block": block, "doc_ids": docs, "lens": [len(x) for x in held], "part_start": done, "n_ids": len(ids), "bits": bits, "payload": pack(ids, bits)}], schema=BLOCK_ARROW)
            docs, held, size, block, done = [], [], 0, block + 1, done + len(ids)
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                ids, lens = enc.encode(texts.slice(a, b - a))
                at = 0
                for doc, n in zip(doc_ids[a:b], lens.tolist(), strict=True):
                    docs.append(doc)
                    held.append(np.concatenate([ids[at : at + n], end]))
                    at += n
                    size += n + len(end)
                    if size >= BLOCK_IDS:
                        yield close()
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1) -> None:
    """Encode every whole text of docs (doc_id, text; other columns are ignored) and write the ids to `path` in ascending doc_id order.

    Null text counts as empty and yields the end id alone; a null doc_id sorts first; repeated doc_ids stay, ordered by a hash of
    their texts, equal rows in any order. No documents: a table without rows. The texts are shuffled once, by sampled ranges of
    doc_id; encoding comes after that, so that nothing is encoded twice.
    """
    bits = max(1, (TextEncoder(tokenizer_path).vocabulary - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(_blocks(tokenizer_path, bits, end_id), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
            raw, lens = memoryview(ids.astype("<u4").tobytes()), np.array(row["lens"], np.int64)
            ends = np.cumsum(lens)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lens + row["before"]), pa.array(lens), pa.array(crc, pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()), pa.array([row["block"]] * len(crc), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "block"])


def blocks_with_starts(spark, path: str) -> DataFrame:
    """The blocks of a written table with `before`: how many ids all earlier blocks hold.

    What is sent to the driver and back is one row a part (as many as the writer had tasks).
    """
    blocks = spark.read.parquet(path)
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    total, rows = 0, []
    for part in sorted(sums):
        rows.append((part, total))
        total += sums[part]
    parts = spark.createDataFrame(rows, "part int, part_before bigint")
    return blocks.join(F.broadcast(parts), "part").withColumn("before", F.col("part_before") + F.col("part_start")).drop("part_before")


def token_digests(spark, path: str) -> DataFrame:
    """Per document of a written table: doc_id, start (ids before it), n_tokens, ids_crc32 (over little-endian 32-bit ids), part, block."""
    rows = blocks_with_starts(spark, path)
    return rows.mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int, block int")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """Write docs' ids to a new folder under the shared one and return what is read back, see write_tokens and token_digests.

    A very long text is one document of one block: a task holds it and its ids at once. Rows that share a doc_id stand next to each other;
    which of them comes first does not depend on the layout of docs, unless they are equal.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digests(spark, path)


ship(__name__)
