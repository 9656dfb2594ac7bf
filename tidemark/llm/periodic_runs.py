"""Periodic runs of words: Lyndon arrays under both orders by grouping suffixes, their roots extended into runs.

Every run (a maximal stretch with a period, at least twice as long as it) holds, under one of the two orders of the alphabet, a place
whose longest Lyndon word is as long as the period (Bannai et al.). So three steps give all runs of a stretch of words:

1. Grouping, the first phase of Baier's suffix sorter: suffixes are grouped by their first word, groups are taken from the highest
   down, and each group's members lengthen the context of the nearest place before them that no group taken so far holds. The length
   of a group's context when it is taken is the length of the longest Lyndon word at its members: the Lyndon array, in linear time
   and without any sorted suffixes. Once with the words' order, once with its reverse.
2. Each root is extended to the left and to the right by longest common extensions, by binary search over sums modulo a prime.
3. Roots that extend far enough are runs; each is compared word by word, and a false one (two stretches with equal sums) starts step 2
   again with another base.

Before that, stretches that hold no run are left out exactly: in a run of length L, at least `least`, with a period of L / times at
most, every word lies in a string of least - least // times words that its document holds twice. Rows stand alone; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import by_place, kept_columns, quoted, ship

LEAST, TIMES = 24, 3
#: Texts are worked on together up to so many bytes.
CHUNK = 4 << 20
PRIME = (1 << 31) - 1


def lyndon_array(ranks: list[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there; ranks are small numbers from 0, whose order is that of words."""
    n, groups = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(groups)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    below, above = list(range(-1, groups - 1)), [*range(1, groups), -1]  # neighbours in the order of groups
    group, length, taken, before = list(ranks), [1] * n, [False] * n, [-1] * n
    at = groups - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]  # ascending; the others have moved to higher groups
        for i in own:
            taken[i] = True
        parts: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = before[j]
            before[i] = j
            if j == last:
                times += 1
            else:
                if last >= 0:
                    parts.setdefault((times, group[last]), []).append(last)
                last, times = j, 1
        if last >= 0:
            parts.setdefault((times, group[last]), []).append(last)
        for times, old in sorted(parts, reverse=True):  # a place that is nearest to more members goes higher
            new, over = len(members), above[old]
            members.append(parts[times, old])
            more = times * length[own[0]]
            for j in members[new]:
                group[j] = new
                length[j] += more
            below.append(old)
            above.append(over)
            above[old], below[over] = new, new
        at = below[at]
    return length


def _extended(words: np.ndarray, starts: np.ndarray, periods: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words the period goes on before each start and behind start + period, told by sums modulo PRIME."""
    n = len(words)
    power = np.ones(1, np.int64)
    while len(power) <= n:
        power = np.concatenate([power, power * pow(base, len(power), PRIME) % PRIME])
    sums = np.concatenate([[0], np.cumsum((words + 1) * power[:n] % PRIME)])
    turn = power[periods]

    def same(at: np.ndarray, size: int, which: np.ndarray) -> np.ndarray:
        other = at + periods[which]
        return ((sums[at + size] - sums[at]) % PRIME * turn[which] - (sums[other + size] - sums[other])) % PRIME == 0

    left, right = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        some = np.flatnonzero(starts + periods + right + step <= n)
        right[some[same(starts[some] + right[some], step, some)]] += step
        some = np.flatnonzero(starts - left - step >= 0)
        left[some[same(starts[some] - left[some] - step, step, some)]] += step
        step >>= 1
    return left, right


def _is_run(words: np.ndarray, start: int, length: int, period: int) -> bool:
    end = start + length
    return bool((words[start : end - period] == words[start + period : end]).all()) and (start == 0 or words[start - 1] != words[start - 1 + period]) and (end == len(words) or words[end] != words[end - period])


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, ascending: length at least `least` and `times` (2 or more) periods."""
    n = len(words)
    _, ranks = np.unique(words, return_inverse=True)
    top = int(ranks.max(initial=0))
    starts, periods = [], []
    for order in (ranks, top - ranks):
        roots = np.array(lyndon_array(order.tolist()), np.int64)
        at = np.flatnonzero(roots * times <= n)
        starts.append(at)
        periods.append(roots[at])
    first, period = np.concatenate(starts), np.concatenate(periods)
    for base in count(1_000_003, 2):
        left, right = _extended(ranks.astype(np.int64), first, period, base)
        length = left + period + right
        long = (length >= least) & (length >= times * period)
        found = sorted(set(zip((first - left)[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True)), key=lambda r: (r[0], r[2]))
        if all(_is_run(ranks, *r) for r in found):
            return found


def _stretches(words: np.ndarray, ends: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(document, from, to) of the stretches that can hold runs, documents being cut at ends."""
    size = least - least // times
    m = len(words) - size + 1
    if m <= 0:
        return []
    value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    key = np.zeros(m, np.uint64)
    for j in range(size):
        key = key * np.uint64(0xD6E8FEB86659FD93) + value[j : j + m]
    doc = np.searchsorted(ends, np.arange(m), "right")
    at = np.flatnonzero(np.arange(m) + size <= ends[doc])
    key = (key[at] ^ (key[at] >> np.uint64(32))) + doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = at[np.union1d(order[1:][equal], order[:-1][equal])]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    held = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(held):
        return []
    owner = np.searchsorted(ends, held, "right")
    cut = np.flatnonzero((np.diff(held) > 1) | (np.diff(owner) > 0)) + 1
    first, last = held[np.concatenate([[0], cut])], held[np.concatenate([cut - 1, [len(held) - 1]])]
    return [(d, a, b + 1) for d, a, b in zip(owner[np.concatenate([[0], cut])].tolist(), first.tolist(), last.tolist(), strict=True) if b + 1 - a >= least]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(w for w, over in zip(words, np.cumsum(edge).tolist(), strict=False) if not over)


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _find(text_at: int, keep: list[int], least: int, times: int, schema: pa.Schema):
    run_type = schema.field("runs").type

    def solved(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
        split = [t.split() for t in texts]  # bytes.split() cuts at ASCII white space alone
        number: dict[bytes, int] = {}
        ends = np.cumsum([len(w) for w in split])
        words = np.fromiter((number.setdefault(w, len(number)) for own in split for w in own), np.int64, int(ends[-1]))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for d, a, b in _stretches(words, ends, least, times):
            shift = a - int(ends[d]) + len(split[d])
            runs[d] += [(s + shift, n, q) for s, n, q in runs_of(words[a:b], least, times)]
        return [len(w) for w in split], runs, [_collapsed(w, r) if r else b" ".join(w) for w, r in zip(split, runs, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = batch.column(text_at).cast(pa.binary()).to_pylist(), 0
            while at < len(raw):
                to, held = at, 0
                while to < len(raw) and (to == at or held + len(raw[to] or b"") <= CHUNK):
                    held += len(raw[to] or b"")
                    to += 1
                n, runs, kept = solved([t or b"" for t in raw[at:to]])
                rows = pa.array([[dict(start=s, length=m, period=q) for s, m, q in r] for r in runs], run_type)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(n, pa.int64()), rows, pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)
                at = to

    return run


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, columns: list[str] | None = None) -> DataFrame:
    """docs (text; more columns pass through) with n_words, runs (array of start, length, period, by start, then period) and collapsed.

    Words are the runs of characters other than ASCII white space, numbered from 0. A run is a stretch that has the period (words so far
    apart are identical), no smaller one, `least` words and `times` periods (2 or more) at least, and that no neighbouring word extends.
    collapsed: the words, joined by one space, without those that lie in any run after its first period. Null and empty texts have no
    words and an empty collapsed. Runs of different periods may overlap and are all given; repeated rows get the same answer, no rows
    none. columns: those of docs to keep, all by default; one named like a result, in any case, is replaced. A task holds CHUNK bytes of
    texts, or one longer text, with some 20 bytes of working memory for each of its bytes; time is linear in the words but for one sort
    of the strings' hashes and the logarithm of a stretch's length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if times < 2 or least < times:
        raise ValueError("times must be 2 at least, and least no smaller than times")
    results = ["n_words", "runs", "collapsed"]
    keep = [c for c in kept_columns(docs, results) if columns is None or c in columns]
    rows = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, "text"])])
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([*(rows.schema[c] for c in keep), *added])
    return by_place(rows).mapInArrow(_find(rows.columns.index("text"), [rows.columns.index(c) for c in keep], least, times, to_arrow_schema(schema)), schema)


ship(__name__)
