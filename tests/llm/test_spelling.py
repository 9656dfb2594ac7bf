"""Spelling groups against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.spelling import VocabularyIndex, counted_words, near_pairs, spelling_groups, suffix_order


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    for c in letters:
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1 :] for i in range(len(w))}
    return out - {w}


def plain_pairs(words):
    letters = sorted(set("".join(words)))
    return {(w, u) for w in words for u in edits(w, letters) if u in words}


def plain_groups(counts, factor):
    near = {w: [] for w in counts}
    for w, u in plain_pairs(set(counts)):
        near[w].append(u)
    best = {w: min(own, key=lambda u: (-counts[u], [ord(c) for c in u])) for w, own in near.items() if own}
    form = {w: u for w, u in best.items() if counts[u] >= factor * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(str((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None)) for w, n in counts.items())


def made(seed, letters, size, least=6, most=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(size)}
    return {w: 5 * 6 ** rng.randint(0, 5) + rng.randint(0, 3) for w in sorted(words)}


def test_suffix_order():
    import numpy as np

    for seed in range(30):
        rng = np.random.default_rng(seed)
        t = np.append(rng.integers(1, 1 + rng.integers(1, 4), rng.integers(0, 60)), 0)
        assert suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("seed", range(8))
def test_index(seed):
    rng = random.Random(seed)
    letters = "abcéÿ"[: rng.randint(1, 5)]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 200))})
    asked = sorted({"".join(rng.choice(letters + "z") for _ in range(rng.randint(2, 8))) for _ in range(100)} | set(words))
    index, got = VocabularyIndex(words), set()
    for n in {len(w) for w in asked}:
        own = [w for w in asked if len(w) == n]
        for left in (True, False):
            got |= {(own[i], words[j]) for i, j in zip(*(x.tolist() for x in index.near(own, left)), strict=True)}
    assert got == {(w, u) for w in asked for u in edits(w, letters + "z") & set(words)}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)


@pytest.mark.parametrize(("symbols", "hot"), [(1 << 17, 1 << 14), (400, 1 << 14), (400, 12)], ids=["one block", "blocks", "crowded halves"])
def test_near_pairs(spark, symbols, hot):
    """Blocks and cut halves lose nothing: here most words share the half aaaa."""
    counts = made(1, "ab", 150) | {"aaaa" + w[:4]: n for w, n in made(2, "abcde", 200).items()}
    got = near_pairs(frame(spark, counts), symbols, hot).collect()
    assert {(r["word"], r["near"]) for r in got} == plain_pairs(set(counts)) and len(got) == len(plain_pairs(set(counts)))
    assert all(r["near_n"] == counts[r["near"]] for r in got)


@pytest.mark.parametrize("counts", [made(3, "abc", 300), made(4, "aé", 200, 2, 7), {"theirs": 2500, "theirss": 500, "theirsss": 100, "theirssss": 20, "theirsssss": 4, "alonely": 5}, {}], ids=["three", "short", "chain", "none"])
def test_spelling_groups(spark, counts):
    out = spelling_groups(frame(spark, counts).withColumns({"form": F.lit(1), "root": F.lit("x")}))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(str(tuple(r)) for r in out.collect()) == plain_groups(counts, 5)


def test_ties_take_the_smallest_word(spark):
    counts = {"abcdef": 5, "abcdez": 25, "abcdeé": 25, "xbcdef": 25}
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling_groups(frame(spark, counts)).collect()}
    assert got["abcdef"] == ("abcdez", 3) and got["abcdez"] == (None, 2)
    with pytest.raises(ValueError, match="factor"):
        spelling_groups(frame(spark, counts), 1)


def test_counted_words(spark):
    words = ["aéiouy"] * 5 + ["short"] * 9 + ["rarely"] * 4 + [None] * 7 + ["x" * 3000] * 6
    got = counted_words(spark.createDataFrame([(w,) for w in words], "word string"))
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in Counter(words).items() if w and len(w) >= 6 and n >= 5}
    rows = spelling_groups(got).collect()
    assert len(rows) == 2 and all(r["root"] == r["word"] and r["n_near"] == 0 for r in rows)


def test_planted_typos(spark):
    import zlib

    from tidemark.llm.queries import with_planted_typos

    rows = [(i, f"Straße ÀÉÎÕÜŸ WORDS{i % 7}Words wordswords, shorts  ×÷×÷×÷ x{'lengthy' * 40}") for i in range(400)] + [(None, "unlabelled"), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    import re

    want = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{i}:{r}".encode()) if i is not None else 1
            w = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 199 == 0 else r
            want[w] += len(w) >= 6
    got = {r["word"]: r["n"] for r in with_planted_typos(docs, 6).filter("char_length(word) >= 6").groupBy("word").agg(F.count("*").alias("n")).collect()}
    assert got == {w: n for w, n in want.items() if n}
