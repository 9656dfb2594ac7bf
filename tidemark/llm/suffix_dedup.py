"""Removal of long byte strings that occur twice, by difference-cover blockwise suffix sorting.

Only equality of suffixes to `length` bytes matters here, so names stand for ranks: equal strings have equal names. COVER is a
difference cover modulo PERIOD: for any two places, some shift below PERIOD puts both on cover places. So two equal strings of
`length` bytes have cover places at the same shift whose strings of length - PERIOD + 1 bytes are equal.

1. Cover names: the strings at cover places (an eighth of all places) are named and counted; a suffix can repeat only if a cover
   place within PERIOD has a name found twice.
2. Long ties: at those places the string from PERIOD - 1 bytes before to `length` bytes behind is named and counted. Found twice, it
   settles all PERIOD suffixes inside it at once: the inner part of long copies, which is nearly all, is never sorted.
3. The rest, near the ends of copies, is sorted one bucket of suffixes at a time, by the names of their first `length` bytes.
   Settled suffixes with a cover name that an open suffix has too join in, since an open one may equal a settled one.

Every step is a census over blocks (see blocks.py): a task holds one block or one bucket of hashes, both of bounded size. A very long text
is several blocks, each with some bytes of the pieces beside it: it names the strings there too, but they count for the piece that owns
their start.
Names that decide are 128-bit hashes; in step 1 they have 40 bits, where a collision costs work and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import Strings, answers, census, packed, with_states
from tidemark.llm.common import discard, ship, stored

LENGTH = 400
#: A perfect difference set; each difference modulo 91 occurs once.
PERIOD, COVER = 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
NAME, FULL = 5, 16
#: A task holds some 100 bytes for each byte of a block.
BLOCK_BYTES = 1 << 20


class Suffixes:
    """One block's places, with what each census has told so far."""

    def __init__(self, row: dict, length: int) -> None:
        self.length = length
        self.lens = np.array(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.n = len(self.data)
        self.strings = Strings(self.data)
        self.states = [row[f"s{i}"] for i in range(4) if f"s{i}" in row]
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        self.own = row["own"]
        first = self.own[1] - self.own[2] if self.own else 0  # pieces of one text have the same cover places
        places = np.flatnonzero(np.resize(np.roll(in_cover, -(first % PERIOD)), self.n))
        self.start_of, self.end_of = self.ends - self.lens, self.ends
        doc = np.searchsorted(self.ends, places, "right")
        short = length - PERIOD + 1
        ok = places + short <= self.end_of[doc]
        self.places, self.doc = places[ok], doc[ok]
        self.names = self.strings.at(self.places, short)

    def counts(self, places: np.ndarray) -> np.ndarray | None:
        """How often strings that start there count: not at all at places that another piece of a long text owns."""
        return None if self.own is None else ((places >= self.own[2]) & (places < self.own[3])).astype(np.float64)

    def twice(self) -> np.ndarray:
        """Of the cover places those with a name found twice."""
        return answers(self.names, self.states[0], NAME)

    def long_places(self) -> np.ndarray:
        """Cover places whose long tie lies inside the document."""
        p, d = self.places, self.doc
        return np.flatnonzero(self.twice() & (p - (PERIOD - 1) >= self.start_of[d]) & (p + self.length <= self.end_of[d]))

    def long_names(self, at: np.ndarray) -> np.ndarray:
        return self.strings.wide_at(self.places[at] - (PERIOD - 1), self.length + PERIOD - 1)

    def before(self, places: np.ndarray) -> np.ndarray:
        """Marks the PERIOD suffixes up to each of the places, kept within documents by whole()."""
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, np.maximum(places - (PERIOD - 1), 0), 1)
        np.add.at(edge, places + 1, -1)
        return np.cumsum(edge)[: self.n] > 0

    def settled(self) -> np.ndarray:
        at = self.long_places()
        return self.before(self.places[at[answers(self.long_names(at), self.states[1], FULL)]]) & self.whole()

    def whole(self) -> np.ndarray:
        """Suffixes with at least `length` bytes left in their document."""
        edge = np.zeros(self.n + 1, np.int32)
        full = self.lens >= self.length
        np.add.at(edge, self.start_of[full], 1)
        np.add.at(edge, self.end_of[full] - self.length + 1, -1)
        return np.cumsum(edge)[: self.n] > 0

    def open(self) -> np.ndarray:
        """Suffixes that may repeat and are not settled."""
        return self.before(self.places[self.twice()]) & self.whole() & ~self.settled()

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover places named twice, and whether an open suffix has that name within PERIOD behind its start."""
        at = np.flatnonzero(self.twice())
        reach = np.concatenate([[0], np.cumsum(self.open())])
        p = self.places[at]
        return at, reach[p + 1] - reach[np.maximum(p - (PERIOD - 1), 0)] > 0

    def sorted_suffixes(self) -> np.ndarray:
        at, _ = self.asked()
        wanted = answers(self.names[at], self.states[2], NAME)
        return np.flatnonzero(self.open() | (self.before(self.places[at[wanted]]) & self.whole()))

    def removed(self) -> np.ndarray:
        """Bytes inside any suffix's first `length` bytes that repeat."""
        starts = self.sorted_suffixes()
        repeats = self.settled()
        repeats[starts[answers(self.strings.wide_at(starts, self.length), self.states[3], FULL)]] = True
        edge = np.zeros(self.n + 1, np.int32)
        at = np.flatnonzero(repeats)
        edge[at] += 1
        edge[at + self.length] -= 1
        return np.cumsum(edge)[: self.n] > 0


def _cover_names(length: int):
    def emit(row: dict):
        s = Suffixes(row, length)
        return s.names, s.counts(s.places)

    return emit


def _long_ties(length: int):
    def emit(row: dict):
        s = Suffixes(row, length)
        at = s.long_places()
        return s.long_names(at), s.counts(s.places[at])

    return emit


def _asked(length: int):
    def emit(row: dict):
        s = Suffixes(row, length)
        at, wanted = s.asked()
        return s.names[at], wanted.astype(np.float64)

    return emit


def _bucket_suffixes(length: int):
    def emit(row: dict):
        s = Suffixes(row, length)
        starts = s.sorted_suffixes()
        return s.strings.wide_at(starts, length), s.counts(starts)

    return emit


KEPT = "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, mark bigint, at bigint, begins boolean, ends boolean"
KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("mark", pa.int64()), ("at", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_())])


def _keep(length: int):
    """Documents without their repeats; of a long text its pieces: mark (a number of the document), at, and whether they begin, end removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                s = Suffixes(row, length)
                gone, own = s.removed(), row["own"]
                ranges = [(a, b) for a, b in zip(s.start_of.tolist(), s.end_of.tolist(), strict=True)] if own is None else [(own[2], own[3])]
                out = []
                for doc, (a, b) in zip(row["doc_ids"], ranges, strict=True):
                    cut = gone[a:b]
                    out.append((doc, s.data[a:b][~cut].tobytes(), b - a, int(cut.sum()), int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum()), own and own[0], own and own[1], bool(cut[:1].any()), bool(cut[-1:].any())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), KEPT_ARROW, strict=True)], schema=KEPT_ARROW)

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """The documents of pieces (as _keep gives them), each put together again; a removed run that goes over a cut is one."""
    row = F.struct("at", "kept", "n_bytes", "n_removed", "n_spans", "begins", "ends")
    whole = pieces.groupBy("mark").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(row)).alias("p"))
    total = lambda c: F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x[c])
    over = F.size(F.filter(F.transform("p", lambda x, i: x["ends"] & F.coalesce(F.get("p", i + 1)["begins"], F.lit(False))), lambda x: x))
    return whole.select("doc_id", F.array_join(F.transform("p", lambda x: x["kept"].cast("string")), "").cast("binary").alias("kept"), total("n_bytes").alias("n_bytes"), total("n_removed").alias("n_removed"), (total("n_spans") - over).alias("n_spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document of docs (doc_id, text): doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans.

    A byte goes if it lies in a string of `length` bytes (more than PERIOD) of its document that also starts elsewhere, in any
    document, itself included. Null text is empty; documents shorter than `length` stay whole; rows with equal doc_id are documents
    of their own, so equal texts of `length` bytes or more remove each other. Other columns of docs are not read. No rows give none.
    A text of more than two blocks is worked on in pieces; it is whole only as a row of the input and of the result.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"length must be at least {2 * PERIOD}")
    blocks = packed(docs, block_bytes, around=length + 2 * PERIOD)
    states: list[DataFrame] = []
    for emit, width, least in ((_cover_names, NAME, 2), (_long_ties, FULL, 2), (_asked, NAME, 1), (_bucket_suffixes, FULL, 2)):
        states.append(census(blocks, states, emit(length), width=width, least=least))
    out = stored(with_states(blocks, states).mapInArrow(_keep(length), KEPT), "suffixes")
    out = out.filter("mark IS NULL").drop("mark", "at", "begins", "ends").unionByName(_joined(out.filter("mark IS NOT NULL")))
    discard(docs.sparkSession, [blocks, *states])
    return out


ship(__name__)
