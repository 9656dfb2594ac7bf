"""Operators that compare documents, against plain versions on small fixtures."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import join_components, one_of_each
from tidemark.llm.suffix_dedup import PERIOD, COVER, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def edge_rows():
    return [(None, "same words in this one line here\nshort"), (1, None), (2, ""), (3, " \n\t "), (4, "same words in this one line here"), (4, "same words in this one line here"), (5, "SAME words in this one line HERE \nx"), (6, "ünï " * 900)]


# n-gram join


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    inverse = {}
    for i, s in enumerate(sets):
        for g in s:
            inverse.setdefault(g, []).append(i)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in inverse[g] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[top(j)] = top(i)
    order = lambda d: (d is not None, d or 0)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(groups[top(i)], key=order)) for i in range(len(rows))), key=str)


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 7, 20, 60, 150]))] for _ in range(15)]
    rows = []
    for k in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(p, rng.choice(words))
            elif p < len(b):
                b[p] = rng.choice(words)
        if rng.random() < 0.3:
            b += rng.choice(bases)
        rows.append((k, " ".join(b)))
    return rows


@pytest.mark.parametrize("rows", [near_copies(7, 300), [(k, " ".join(random.Random(k).choice("ab") for _ in range(k % 14))) for k in range(150)], edge_rows(), []], ids=["near", "short", "edge", "none"])
def test_components(spark, rows):
    got = join_components(frame(spark, rows), block_bytes=20_000).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows)
    assert len({r["rid"] for r in got}) == len(rows)


def test_one_of_each_keeps_one_row_of_a_component_and_all_columns(spark):
    rows = [*edge_rows(), (9, None), (9, None)]
    docs = frame(spark, rows).withColumn("size", F.lit("mine"))
    kept = one_of_each(docs).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted([(None, rows[0][1]), (1, None), (2, ""), (3, " \n\t "), (4, rows[4][1]), (5, rows[6][1]), (6, rows[7][1]), (9, None), (9, None)], key=str)
    assert {r["size"] for r in kept} == {"mine"}


# decontamination


def plain_hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = {}
    for i, t in items:
        w = word.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, ids = word.findall(lower(t)), set(), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if (x := held.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= x
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(3)
    v = "a b c A é B1".split()
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(v, k=rng.randint(0, 40)))) for i in range(120)] + [(3, "a b"), (None, "c c c")]
    items = [(i % 25 or None, None if i == 9 else ",".join(rng.choices(v, k=rng.choice([0, 1, 3, 5, 9, 10, 11, 30])))) for i in range(5, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(frame(spark, rows).withColumn("n_words", F.lit("old")), bench, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), r["hit_items"]) for r in got), key=str) == plain_hits(rows, items)


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {len(r["hit_spans"]) for r in decontaminate(frame(spark, edge_rows()), bench).collect()} == {0}
    assert decontaminate(frame(spark, []), bench).count() == 0


# suffixes


def plain_repeats(rows, n):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))))
    return sorted(out, key=str)


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize(("length", "block_bytes"), [(200, 5000), (400, 1 << 22)])
def test_remove_repeats(spark, length, block_bytes):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdé ") for _ in range(2500)) for _ in range(3)]
    rows = [*edge_rows(), (500, "ab" * 700), (501, "q" * 900), (502, bases[0]), (503, bases[0])]
    for k in range(60):
        t = ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 2000)
            t += rng.choice(bases)[a : a + rng.choice([150, length - 1, length, length + 1, 290, 500])] if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 300)))
        rows.append((k, t))
    got = remove_repeats(frame(spark, rows).withColumn("lens", F.lit(1)), length, block_bytes).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=str) == plain_repeats(rows, length)


@pytest.mark.parametrize("seed", range(3))
def test_remove_repeats_in_pieces(spark, seed):
    """Long texts are cut every 1,528 bytes; repeats lie inside pieces, across cuts, and over several of them."""
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(6000))
    rows = [(None, "q" * 12_000), (900, "".join(rng.choice("xyzü") for _ in range(9000))), (901, base), (902, None)]
    for k in range(8):
        t = ""
        while len(t) < rng.choice([300, 5000, 20_000]):
            a = rng.randint(0, 5000)
            t += base[a : a + rng.choice([150, 199, 200, 201, 900, 4000])] if rng.random() < 0.4 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 900)))
        rows.append((k, t))
    packed = blocks.packed(frame(spark, rows), 1500, around=200 + 2 * PERIOD)
    assert packed.filter("own IS NOT NULL").count() > 15 and packed.agg(F.max(F.octet_length("data"))).head()[0] < 7000
    got = remove_repeats(frame(spark, rows), 200, 1500).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=str) == plain_repeats(rows, 200)


def test_names_that_share_their_first_half(spark, monkeypatch):
    """Collisions in 64 bits: only the other 64 tell strings apart."""
    h = np.array([[5, 1], [5, 2], [5, 1], [7, 0]], np.uint64)
    u, place, counts = blocks.distinct(h, None, 16)
    assert u.tolist() == [[5, 1], [5, 2], [7, 0]] and place.tolist() == [0, 1, 0, 2] and counts.tolist() == [2, 1, 1]
    monkeypatch.setattr(blocks.Strings, "wide_at", lambda self, starts, length: np.stack([np.zeros(len(starts), np.uint64), self._hash(starts, length, blocks.BASE_2)], 1))
    rows = [(k, "".join(random.Random(k % 7).choice("abcdé ") for _ in range(700)) + "x" * (k % 3)) for k in range(12)]
    got = remove_repeats(frame(spark, rows), 200, 3000).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=str) == plain_repeats(rows, 200)


@pytest.mark.parametrize("partition", [0, 1 << 19, (1 << 26) - 1])
def test_numbers_fit_whatever_the_partition(monkeypatch, partition):
    from types import SimpleNamespace

    monkeypatch.setattr(blocks, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: partition)))
    texts = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["text"] * 500), pa.array([b"r"] * 500, pa.binary())], names=["doc_id", "text", "row"])
    made = [b for out in blocks._pack(1000)([texts]) for b in out.to_pylist()]
    rids = [(b["block"] << blocks.DOC_BITS) + k for b in made for k in range(len(b["doc_ids"]))]
    assert len(set(rids)) == 500 and rids == sorted(rids) and 0 <= rids[0] and rids[-1] < 1 << 63


def test_buckets_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 100)
    packed = blocks.packed(frame(spark, [(k, "x" * 50) for k in range(100)]))
    assert blocks.buckets_for(packed) == 50


def test_remove_repeats_empty(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="length"):
        remove_repeats(frame(spark, []), 100)


# lines


def plain_lines(rows):
    order = lambda d: (d is not None, d or 0)
    held = {}
    for i, t in rows:
        for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if not (len(k) >= 20 and len(held[k]) >= 3 and order(i) < max(map(order, held[k])))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [edge_rows(), [], [(i, "\n".join(random.Random(i).choices(["common line number one of all", " Common Line NUMBER one of all\t", "a rarer line, yet it is long", "short", "", f"own line of document {i}"], k=i % 7))) for i in range(80)]], ids=["edge", "none", "many"])
def test_dedup_lines(spark, rows):
    got = dedup_lines(frame(spark, rows).withColumn("n_lines", F.lit("old")).withColumn("k1", F.lit(1))).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=str) == plain_lines(rows)


def test_runs_are_compacted_and_sum_up(spark):
    """Counts and largest ids over several runs, batches and tasks, against plain ones; no run is shuffled again."""
    from tidemark.llm.line_dedup import LineRuns, long_lines

    lines = [f"a line that many documents hold, number {k}" for k in range(40)]
    texts = {i: "\n".join(random.Random(i).sample(lines, 12) + [f"a line of document {i} alone, and of no other"]) for i in range(120)}
    runs, held = LineRuns(spark, 10**9), {}
    for top in range(120, 0, -24):
        docs = frame(spark, [(i, texts[i]) for i in range(top - 24, top)]).repartition(5)
        runs.add(long_lines(docs.withColumn("number", F.col("doc_id"))))
    for i, t in texts.items():
        for line in t.split("\n"):
            held.setdefault(line, []).append(i)
    assert [r is not None for r in runs.levels] == [True, False, True]
    merged = runs._merged(*runs.runs())
    assert sorted((r["n"], r["last"]) for r in merged.collect()) == sorted((len(x), max(x)) for x in held.values())
    runs.levels = [merged]
    runs.discard()
    few = LineRuns(spark)
    for top in range(120, 0, -24):
        few.add(long_lines(frame(spark, [(i, texts[i]) for i in range(top - 24, top)]).repartition(5).withColumn("number", F.col("doc_id"))))
    assert sorted(r["last"] for r in few.repeated().collect()) == sorted(max(x) for x in held.values() if len(x) >= 3)
    few.discard()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_run_")]


def test_many_common_lines_in_a_document(spark):
    """Time in proportion to the lines: 40,000 of them took minutes when each was looked for among all."""
    import time

    rows = [(i, "\n".join(f"a common line with number {k}" for k in range(40_000))) for i in range(3)]
    began = time.time()
    got = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: 40_000, 1: 40_000, 2: 0} and time.time() - began < 60


def test_components_across_many_blocks(spark, monkeypatch):
    """Edited copies that are no link of their head, in blocks of three rows."""
    from tidemark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        b = list(base)
        for _ in range(rng.randint(0, 5)):
            del b[rng.randrange(len(b))]
        rows.append((k, " ".join(b)))
    got = join_components(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows)
