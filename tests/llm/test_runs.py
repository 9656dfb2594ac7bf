"""Periodic runs against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.periodic_runs import _stretches, find_runs, lyndon_array, runs_of


def plain_lyndon(r):
    """A longest Lyndon word ends before the next smaller suffix."""
    return [next((j - i for j in range(i + 1, len(r)) if r[j:] < r[i:]), len(r) - i) for i in range(len(r))]


def plain_runs(w, least, times):
    """All periods, smallest first; a stretch that has a smaller one is no run of a larger."""
    seen = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                seen.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def sequences(n):
    rng = random.Random(5)
    for _ in range(n):
        k, m, p = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 40), rng.randint(1, 6)
        own = [rng.randrange(k) for _ in range(m)]
        yield own if rng.random() < 0.5 else [own[i % p] if rng.random() > 0.04 else rng.randrange(k) for i in range(m)]


def test_lyndon_arrays():
    for r in sequences(800):
        ranks = np.unique(np.array(r, int), return_inverse=True)[1].tolist()
        assert lyndon_array(ranks) == plain_lyndon(ranks)


@pytest.mark.parametrize(("least", "times"), [(2, 2), (4, 2), (6, 3), (9, 3)])
def test_runs_and_stretches(least, times):
    for r in sequences(600):
        words = np.array(r, np.int64)
        want = plain_runs(r, least, times)
        assert runs_of(words, least, times) == want
        held = _stretches(words, np.array([len(r)]), least, times)
        assert all(any(a <= s and s + n <= b for _, a, b in held) for s, n, _ in want)


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


ROWS = [(1, None), (2, ""), (3, " \n"), (4, "ab " * 30), (5, "one two three four five six seven eight " * 3), (6, "one two three four five six seven eight " * 2), (7, "x y z\x1c w " * 20 + "end"), (7, "a " * 23), (None, "start " + "a b a b c " * 40 + "b a " * 50), (8, "No run at all, in these words.")]


def test_find_runs(spark):
    rng = random.Random(2)
    rows = ROWS + [(100 + i, " ".join(str(x) for x in s for _ in range(2))) for i, s in enumerate(sequences(200))] + [(999, " ".join(str(rng.randrange(3)) for _ in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"RUNS": F.lit(1), "a.b": F.lit("c")})
    out = find_runs(docs)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    for r in out.collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        want = plain_runs(words, 24, 3)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), want, collapse(words, want))
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="times"):
        find_runs(docs, 24, 1)


def test_a_very_long_run(spark):
    """Linear time: 300,000 words of period 1, 7 and none."""
    texts = ["a " * 300_000, "a b c d e f g " * 43_000, " ".join(map(str, range(300_000)))]
    got = find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[(0, 300_000, 1)], [(0, 301_000, 7)], []]
