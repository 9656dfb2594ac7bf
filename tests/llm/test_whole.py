"""The registered queries without SQL, and the pipeline's stages, against plain versions over a whole small table."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import queries

sys.path.insert(0, str(Path(__file__).parent))
from test_pairs import plain_components, plain_hits  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def plain_tokens(texts):
    ids = [[*e.ids, 1] for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def test_op1(spark, documents):
    out = queries.op1_token_output(spark, DATA)
    assert [types(out)[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")] == ["bigint"] * 4
    docs = sorted(documents)
    made = plain_tokens([t for _, t, _, _ in docs])
    starts = np.cumsum([0, *(n for n, _ in made)]).tolist()
    want = [(d[0], s, n, c) for d, s, (n, c) in zip(docs, starts, made, strict=False)]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()) == want


def test_op3(spark, documents):
    out = queries.op3_language_id(spark, DATA)
    assert (types(out)["held_out"], types(out)["lang_pred"], types(out)["score"]) == ("boolean", "string", "double")
    langs = {d[0]: d[2] for d in documents}
    texts = {d[0]: d[1] for d in documents}
    rows = out.collect()
    assert len(rows) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")) for r in rows)
    told = [r for r in rows if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(told) > 20 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in told) >= 0.97 * len(told)


def test_op4(spark, documents):
    out = queries.op4_sharding(spark, DATA)
    assert [types(out)[c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")] == ["bigint", "bigint", "string", "int", "bigint", "int"]
    texts = {d[0]: (d[1] or "").encode() for d in documents}
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert set(sizes) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(w) for w in where.values()} == {1}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_op5(spark, documents):
    n = 400
    raw = {d[0]: (d[1] or "").encode() for d in documents}
    seen = Counter(hashlib.blake2b(b[p : p + n], digest_size=12).digest() for b in raw.values() for p in range(len(b) - n + 1))
    want = []
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - n + 1):
            if seen[hashlib.blake2b(b[p : p + n], digest_size=12).digest()] > 1:
                gone[p] += 1
                gone[p + n] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    out = queries.op5_suffix_dedup(spark, DATA)
    assert [types(out)[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")] == ["bigint"] * 4 + ["string"]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect())
    assert got == sorted(want) and sum(r[2] > 0 for r in got) > 5


def plain_targets(sizes):
    """Largest shares first cut to three times their size, until none is above."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        left, free = sum(sizes) - sum(fixed.values()), [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i: 3.0 * sizes[i] for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= over


def test_op7(spark, documents):
    out = queries.op7_mixing(spark, DATA)
    assert [types(out)[c] for c in ("size", "source_size", "target", "taken")] == ["bigint", "bigint", "double", "bigint"]
    size = {d[0]: len((d[1] or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()) for d in documents}
    source = {d[0]: d[3] for d in documents}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(n for d, n in size.items() if source[d] == s) for s in names]
    want = dict(zip(names, zip(sizes, plain_targets(sizes), strict=True), strict=True))
    taken = Counter()
    rows = out.collect()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], want[s][0]) and r["target"] == pytest.approx(want[s][1]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        assert r["taken"] == r["size"] * len([x for x in r["shards"].split(",") if x]) and r["shards"].count(",") == r["places"].count(",")
    for s in names:
        assert abs(taken[s] - want[s][1]) <= max(0.02 * want[s][1], min(size[d] for d in size if source[d] == s)), s
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op7_mixing(spark, DATA).collect()))


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of it on that stage's own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/whole-{name}"
        stages[name](spark, docs, DATA).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    first = step("language_id", docs)
    ids = [r["doc_id"] for r in first.collect()]
    assert set(ids) <= {r["doc_id"] for r in docs.collect()} and len(ids) > 0.9 * docs.count()
    kept = step("near_duplicates", first)
    plain = plain_components([(r["doc_id"], r["text"]) for r in first.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in plain if d == c)
    clean = step("decontaminate", kept)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _, n, _ in plain_hits([(r["doc_id"], r["text"]) for r in kept.collect()], bench) if n == 0)
    mixed = step("mixing", clean)
    held = {r["doc_id"]: r["text"] for r in clean.collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(held) and max(times.values()) <= 3
    words = lambda t: len((t or "").split())
    by_source = defaultdict(list)
    for r in clean.collect():
        by_source[r["source"]].append((words(r["text"]), times[r["doc_id"]]))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    for s, target in zip(names, plain_targets([sum(n for n, _ in by_source[s]) for s in names]), strict=True):
        assert abs(sum(n * k for n, k in by_source[s]) - target) <= max(0.02 * target, min(n for n, _ in by_source[s]))
    out = stages["token_output"](spark, mixed, DATA).collect()
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((d, *x) for (d, _), x in zip(rows, plain_tokens([t for _, t in rows]), strict=True))
