"""Operators on single documents, sharding, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

import corpus_pipeline
from tidemark.llm import licenses, mixing, queries
from tidemark.llm import token_output as token_output_module
from tidemark.llm.language_id import codewords, fit_language_model, held_out, predict_language
from tidemark.llm.quality import quality
from tidemark.llm.sharding import shard
from tidemark.llm.token_output import TextEncoder, pack, token_output, unpack, write_tokens

DATA = "/root/testdata/sf0.001"
ROWS = [(None, "no id at all"), (1, None), (2, ""), (3, "one\ntwo two.  <|endoftext|> it's ﬁne É́ Σς"), (3, "again"), (3, "again"), (7, "long " * 30_000)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


# tokens


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 5, 15, 16, 17])
def test_pack_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert (unpack(pack(ids, bits), bits, 0, 1003) == ids).all()
    assert (unpack(pack(ids, bits), bits, 13, 100) == ids[13:113]).all()
    assert len(pack(ids, bits)) == -(-1003 * bits // 8)


def test_text_encoder_equals_tokenizer():
    enc, rng = TextEncoder(tokenizer_path()), random.Random(1)
    bits = ["a", "B", "é", "é", "'s", "'", "İ", "Σ", "ς", " ", "\n", "\t", "　", "\x1c", "1", "²", "<|endoftext|>", "<|", "!", "ß", "ﬁ", "字", "😀", "_", "it's", "\xa0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for _ in range(2):
        ids, lens = enc.encode(pa.array([*texts, None]))
        assert [x.tolist() for x in np.split(ids, lens.cumsum())][:-1] == [e.ids for e in enc.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)]


def test_text_encoder_with_another_file(tmp_path):
    """A file that does not cut texts like the known one gets whole texts, so its ids are right too."""
    import public_tokenizers

    keeps_case = Tokenizer.from_file(tokenizer_path())
    keeps_case.normalizer = normalizers.NFC()
    keeps_case.save(str(tmp_path / "t.json"))
    texts = ["It's  ONE", "", "two\ntwo", "a <|endoftext|> b"]
    for path in (str(tmp_path / "t.json"), public_tokenizers.path("byte_bpe_50k.json")):
        enc = TextEncoder(path)
        ids, lens = enc.encode(pa.array(texts))
        assert not enc.by_parts and [x.tolist() for x in np.split(ids, lens.cumsum())][:-1] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_text_encoder_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(token_output_module, "STRINGS_KEPT", 8)
    enc = TextEncoder(tokenizer_path())
    for text in ["one two three four", "five one six", "seven eight nine ten one two"]:
        assert enc.encode(pa.array([text]))[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_output(spark):
    got = token_output(frame(spark, ROWS).withColumn("part", F.lit("mine")), tokenizer_path()).collect()
    t = TextEncoder(tokenizer_path()).tokenizer
    want = sorted((d is not None, d or 0, len(e) + 1, zlib.crc32(np.array([*e, 1], "<u4").tobytes())) for d, e in ((d, t.encode(x or "", add_special_tokens=False).ids) for d, x in ROWS))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in ROWS)
    assert token_output(frame(spark, []), tokenizer_path()).count() == 0


def test_written_blocks_hold_bits_of_the_vocabulary(spark, tmp_path):
    write_tokens(frame(spark, ROWS), str(tmp_path / "t"), tokenizer_path())
    for r in spark.read.parquet(str(tmp_path / "t")).collect():
        assert r["bits"] == 16 and len(r["payload"]) == 2 * r["n_ids"] == 2 * sum(r["lens"])


# languages


def test_codewords_are_apart():
    for k in range(2, 12):
        c = codewords(k)
        assert len({tuple(r) for r in c.tolist()}) == k and c.any(0).all() and not c.all(0).any()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id"))))
    got = predict_language(docs.filter(held_out(F.col("doc_id"))), model)
    n, right = got.agg(F.count("*"), F.count(F.when(F.col("lang_pred") == F.col("lang"), 1))).head()
    assert n > 100 and right / n > 0.97
    rows = predict_language(frame(spark, [*ROWS, (9, "12 34 $$")]).withColumn("score", F.lit("old")), model).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 9)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(ROWS) + 1


def test_language_without_or_with_one_label(spark):
    docs = frame(spark, ROWS)
    assert {r["lang_pred"] for r in predict_language(docs, fit_language_model(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert {r["lang_pred"] for r in predict_language(docs, fit_language_model(docs.withColumn("lang", F.lit("xx")))).collect()} == {"und", "xx"}
    assert {r["lang_pred"] for r in predict_language(docs, fit_language_model(docs.withColumn("lang", F.when(F.col("doc_id") == 7, "yy").otherwise("xx")))).filter("doc_id = 7").collect()} == {"yy"}


# shards


@pytest.mark.parametrize("rows", [ROWS, [], [(i, f"{i % 7} " * (i % 50 + 1)) for i in range(900)], [(i, "copy" * 20) for i in range(500)] + [(i, f"t{i}" * 20) for i in range(500, 900)]], ids=["edge", "none", "many", "hot"])
def test_shard(spark, rows):
    got = shard(frame(spark, rows).withColumn("slot", F.lit("old")), 8).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["law"] == "bytes" for r in got)
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    if len(rows) > 500:
        sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
        assert max(sizes) - min(sizes) < 0.15 * sum(sizes) / 8


def test_groups_stay_together(spark):
    rows = [(i, f"group {i // 3} " * 9) for i in range(900)]
    where = {}
    for r in shard(frame(spark, rows), 8).collect():
        where.setdefault(r["text"], set()).add(r["shard"])
    assert {len(s) for s in where.values()} == {1}


# mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    t = mixing.targets([1, 100, 100, 0], [5, 2, 1, 5])
    assert t[0] == 3 and t[3] == 0 and sum(t) == pytest.approx(201)


def test_split_tree():
    q = mixing.split_tree([5, 0, 90], 8, np.random.default_rng(1))
    assert q.sum(1).tolist() == [5, 0, 90] and max(q.sum(0)) - min(q.sum(0)) <= 1


def test_mix(spark):
    rows = [(i, "w " * (i * 7 % 90), ["a", "b", "c", None][i % 4]) for i in range(600)] + [(1, None, "a"), (1, None, "a"), (None, "x y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("target", F.lit("old"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(len(r["takes"]) <= 3 for r in got)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == s]
        taken = sum(len(r["takes"]) * r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= 90 and sum(r["size"] for r in own) == own[0]["source_size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.emitted(mixing.mix(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["shard"]) for r in out) == sorted((r["doc_id"] or 0, t["shard"]) for r in got for t in r["takes"])
    assert mixing.mix(docs.filter("false")).count() == 0


def test_mix_follows_the_tree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 20, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    before = {r["doc_id"]: [t["shard"] for t in r["takes"]] for r in mixing.mix(docs).collect()}
    assert {s for x in before.values() for s in x} == set(range(mixing.SHARDS))
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, rng: np.array([[n, *[0] * (shards - 1)] for n in quotas]))
    assert {s for r in mixing.mix(docs).collect() for s in [t["shard"] for t in r["takes"]]} == {0}


def test_mix_takes_part_of_a_block(spark, monkeypatch):
    """With one block a source, nearly all of a target is taken out of finer blocks and the last one's rows."""
    monkeypatch.setattr(mixing, "BLOCKS", 1)
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(len(r["takes"]) * r["size"] for r in own) - own[0]["target"]) <= 9


# licences and quality


def test_licenses(spark):
    known = licenses.known_digests(spark)
    rows = [(1, "Copyright (c) 2020 Someone\nreleased under THE mit licence"), (2, "text\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (3, None), (4, ""), (None, "nothing")]
    got = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in licenses.scan_licenses(frame(spark, rows).withColumn("license", F.lit(1)), known).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: (None, ["CC-BY-NC-4.0", "MIT"]), 3: (None, []), 4: (None, []), None: (None, [])}
    with pytest.raises(ValueError, match="more than"):
        licenses.scan_licenses(frame(spark, rows), known, bound=2)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""


def test_full_licence_texts_and_wrapped_notices(spark):
    rewrapped = MIT.replace("\n\n", "\n").replace("The above copyright", "The above\ncopyright")
    rows = [
        (1, f"MIT License\n\nCopyright (c) 2020 Someone\n\n{MIT}\n"),
        (2, f"some code\nCopyright 2020 Someone\n{MIT}\nmore code"),
        (3, f"some code\n{rewrapped}\nmore code"),
        (4, "# " + APACHE_HEADER.replace("\n", "\n# ") + "\nimport this"),
        (5, APACHE_HEADER.replace("License.", "License. More on this line")),
        (6, MIT.replace("free of charge", "for a fee")),
        (7, 'Licensed under the Apache License,\nCopyright 2020 Someone\nVersion 2.0 (the "License");\nyou may not use this file except\nin compliance with the License.\n' + MIT),
    ]
    got = {r["doc_id"]: (r["license"], r["line_licenses"]) for r in licenses.scan_licenses(frame(spark, rows), licenses.known_digests(spark)).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: (None, ["MIT"]), 3: (None, ["MIT"]), 4: (None, ["Apache-2.0"]), 5: (None, []), 6: (None, []), 7: (None, ["Apache-2.0", "MIT"])}


def test_licence_sql_knows_all_texts_and_runs(spark, tmp_path):
    """The registered SQL over every short text, whole, wrapped and inside other lines, and over the texts of the notices test."""
    import duckdb

    from tidemark.llm.license_texts import short_texts

    texts = [t for _, t in short_texts()][::5]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"Some code here\n(c) 2021 Someone\n{t}\nlast line") for i, t in enumerate(texts)]
    rows += [(2000, "a line\n" + APACHE_HEADER.replace("\n", "\nCopyright 2020 Someone\n")), (2001, None), (2002, ""), (2003, MIT.upper()), (2004, MIT.replace("license", "licence") + "\n" + APACHE_HEADER)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op9_license_scan(spark, str(tmp_path)).select("doc_id", "digest", "license", "line_licenses").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(queries.op9_sql()).fetchall()))
    assert all(r["license"] and r["license"] in r["line_licenses"] for r in got if r["doc_id"] < 1000) and all(r["line_licenses"] for r in got if 1000 <= r["doc_id"] < 2000)


def test_license_list_can_be_made_again(spark):
    import os

    from tidemark.llm.license_digests import FILES, FOLDER
    from tidemark.llm.make_license_digests import file_digests

    if not all(os.path.exists(f"{FOLDER}/{r[4]}") for r in FILES):
        pytest.skip("no licence texts here")
    assert sorted(map(tuple, file_digests(spark).collect())) == sorted(FILES)


def test_clauses_and_words_are_kept_apart(spark):
    """A clause numbered (c) is text, and a word that holds another one keeps its spelling."""
    pairs = [("use it\n(c) you must not sell", "use it\n(c) you may sell"), ("conversion of goods", "conv of goods"), ("(c) 2020 A\nuse it", "© 2021-2022 B\nuse it"), ("sub-licences, version 2", "Sublicenses V. 2")]
    docs = spark.createDataFrame([(i, side, p[side]) for i, p in enumerate(pairs) for side in (0, 1)], "doc_id int, side int, text string")
    got = {(r["doc_id"], r["side"]): r["digest"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert [got[i, 0] == got[i, 1] for i in range(len(pairs))] == [False, False, True, True]


def test_known_full_texts(spark):
    import os

    folder = "/usr/share/common-licenses"
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    files = [f for f in want if os.path.exists(f"{folder}/{f}")]
    if not files:
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(f, open(f"{folder}/{f}").read()) for f in files], "doc_id string, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()} == {f: want[f] for f in files}


def plain_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "é|", "#x", "word."]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += [(None, "x"), (901, None), (902, ""), (903, "a b c d e f g h " * 200), (904, "clean words make this line a sentence of more than ten words.\n" + "Home | News | About | Contact\nAccept cookies")]
    got = quality(frame(spark, rows).withColumn("n_words", F.lit("old"))).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_quality(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert next(r for r in got if r["doc_id"] == 904)["cleaned"] == "clean words make this line a sentence of more than ten words."
    assert quality(frame(spark, [])).count() == 0


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1"), "doc_id")
    bad = quality(docs).filter("NOT kept AND NOT base_failed").count()
    assert bad == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA).select(columns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, 0), (10**9, "12 34", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(odd).withColumn("size", F.lit("mine"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        seen[name] = docs = spark.read.parquet(path)
    assert seen["language_id"].filter(f"doc_id = {10**9}").count() == 0
    ids = {r[0] for r in seen["near_duplicates"].select("doc_id").collect()}
    comps = {r["component_id"] for r in queries.op8_ngram_join(spark, DATA).collect()}
    assert ids <= comps and len(ids) > 0.9 * len(comps)
    dirty = {r["doc_id"] for r in queries.op2_decontaminate(spark, DATA).filter("contaminated").collect()}
    assert {r[0] for r in seen["decontaminate"].select("doc_id").collect()} == ids - dirty
    assert {r[0] for r in seen["mixing"].select("size").distinct().collect()} == {"mine"}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert tokens.count() == docs.count()
    assert corpus_pipeline.run(spark, DATA).count() > 0
