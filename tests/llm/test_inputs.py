"""Every operator and stage on odd inputs: clashing names, repeated rows, empty tables, executors without this package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import licenses, mixing
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.language_id import fit_language_model, predict_language
from tidemark.llm.exact_dedup import dedup_exact, exact_groups
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import join_components, one_of_each
from tidemark.llm.periodic_runs import find_runs
from tidemark.llm.quality import quality
from tidemark.llm.sharding import shard
from tidemark.llm.spelling import counted_words, spelling_groups
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_output import token_output

DATA = "/root/testdata/sf0.001"
ROWS = [(1, "A line that three documents hold\nMore words than that, said the one to the other.", "en", "s1"), (2, "a line that three documents hold\nand another", "en", "s2"), (2, "a line that three documents hold\nand another", "en", "s2"), (None, None, None, None), (3, "", "de", None)]
#: Names of columns that operators make for themselves, or could, and results in another case.
CLASHING = ["_lines", "_doc", "_key", "_h", "_nth", "Size", "N_LINES", "N_Words", "number", "_number", "place", "Shard", "slot_", "takes_", "words", "key", "a.b", "Kept", "DIGEST", "license", "lang_PRED", "gone", "row", "rid"]


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bench(spark):
    return spark.createDataFrame([(1, "more words than that said the one to the other"), (None, None)], "item_id long, text string")


OPERATORS = {
    "token_output": lambda s, d: token_output(d, tokenizer_path()),
    "decontaminate": lambda s, d: decontaminate(d, bench(s)),
    "decontaminate_joined": lambda s, d: decontaminate(d, bench(s), block_bytes=1),
    "predict_language": lambda s, d: predict_language(d, fit_language_model(d)),
    "shard": lambda s, d: shard(d, 8),
    "remove_repeats": lambda s, d: remove_repeats(d),
    "dedup_lines": lambda s, d: dedup_lines(d),
    "mix": lambda s, d: mixing.mix(d),
    "emitted": lambda s, d: mixing.emitted(mixing.mix(d)),
    "join_components": lambda s, d: join_components(d),
    "one_of_each": lambda s, d: one_of_each(d),
    "scan_licenses": lambda s, d: licenses.scan_licenses(d, licenses.known_digests(s)),
    "quality": lambda s, d: quality(d),
    "find_runs": lambda s, d: find_runs(d),
    "exact_groups": lambda s, d: exact_groups(d),
    "dedup_exact": lambda s, d: dedup_exact(d),
}
#: Takes words, not documents.
SPELLING = lambda d: spelling_groups(counted_words(d.select("*", F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \n]")).alias("word"))))


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string, source string")


def clashing(docs):
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING])


def shown(out, columns):
    return sorted(str([str(r[c]) for c in columns]) for r in out.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing(spark, name):
    """Results are those without the further columns; these pass through, but for those named like a result in any case."""
    run, docs = OPERATORS[name], documents(spark)
    plain, both = run(spark, docs), run(spark, clashing(docs))
    results = [c for c in plain.columns if c not in docs.columns and c not in ("place", "slot", "rid", "part", "block", "takes")]
    same = [c for c in plain.columns if c in docs.columns] + results
    # shard numbers rows, so which of two equal rows is where may differ
    assert shown(both, same) == shown(plain, same) if name != "shard" else both.count() == plain.count()
    if name not in ("token_output", "remove_repeats", "join_components", "exact_groups"):
        passed = [c for c in CLASHING if c.lower() not in {x.lower() for x in plain.columns}]
        assert set(passed) <= set(both.columns) and len({c.lower() for c in both.columns}) == len(both.columns)
        for r in both.collect():
            assert all(r[c] == f"mine {c}" for c in passed)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).count() == 0


LONG = "\n".join(f"Line {k % 700} of a very long text, which says {k % 13} things in {k % 17} words and no more." for k in range(20_000))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_very_long_texts_and_repeated_rows(spark, name):
    """A text of 1.5 MB, twice, and rows repeated many times: each row gets an answer, equal rows the same one."""
    rows = [(1, LONG, "en", "s1"), (2, LONG, "en", "s2")] + [(3, "Some words that are repeated in many rows.", "en", "s1")] * 300 + [(None, None, None, None)] * 3
    out = OPERATORS[name](spark, documents(spark, rows).repartition(3)).collect()
    if name in ("emitted", "one_of_each", "dedup_exact"):
        assert len(out) == {"one_of_each": 5, "dedup_exact": 3}.get(name, len(out))
        return
    assert len(out) == len(rows)
    assert sum(r["doc_id"] is None for r in out) == 3
    own = [c for c in out[0].__fields__ if c not in ("kept", "number", "start", "part", "block", "shard", "slot", "takes", "rid", "row", "first")]
    assert len({str([r[c] for c in own]) for r in out if r["doc_id"] == 3}) == 1


def test_spelling_on_odd_inputs(spark):
    assert SPELLING(documents(spark, [])).count() == 0
    docs = documents(spark, [*ROWS, (9, f"{LONG}\n{LONG}", None, None), (9, "x" * 500_000, None, None)])
    assert sorted(map(str, SPELLING(clashing(docs)).collect())) == sorted(map(str, SPELLING(docs).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_inputs(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, documents(spark, []), DATA).count() == 0
    docs = clashing(documents(spark))
    out = stage(spark, docs, DATA)
    out.collect()
    if name != "token_output":
        assert out.columns == docs.columns
        assert all(r["Size"] == "mine Size" and r["Shard"] == "mine Shard" for r in out.collect())


def test_equal_rows_are_spread_over_shards(spark):
    got = shard(spark.createDataFrame([(7, "the same text")] * 4000, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("last")).collect()
    sizes = [r["n"] for r in got]
    assert len(got) == 8 and max(sizes) - min(sizes) < 0.15 * sum(sizes) / 8 and all(r["k"] == r["last"] + 1 for r in got)


def test_equal_rows_leave_the_sample_bounded(spark):
    from tidemark.llm.language_id import drawn

    docs = spark.createDataFrame([(None, "some words here", "en")] * 3000 + [(1, "andere Wörter", "de")] * 50, "doc_id long, text string, lang string")
    got = {r["lang"]: r["count"] for r in drawn(docs.select("text", "lang"), 300).groupBy("lang").count().collect()}
    assert 200 < got["en"] < 400 and got["de"] == 50


@pytest.mark.parametrize(("master", "fine"), [("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_no_shared_folder_is_an_error_on_a_cluster(master, fine):
    from types import SimpleNamespace

    from tidemark.llm.common import shared_dir

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    if fine:
        assert shared_dir(session, "x") != shared_dir(session, "x")
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session, "x")


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", {top!r} + "/wh").config("spark.checkpoint.dir", {top!r} + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import importlib.util
assert spark.range(1).mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict(dict(n=[int(importlib.util.find_spec("tidemark") is not None)])) for b in bs), "n long").collect()[0][0] == 0
from tidemark.llm.queries import QUERIES
for name, query in QUERIES.items():
    print(name, query(spark, {data!r}).count(), flush=True)
"""


def test_executors_without_the_package(tmp_path):
    """All queries with Python workers that cannot import tidemark: only the driver's path holds it."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", FOREIGN.format(repo=repo, top=str(tmp_path), data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(x.split() for x in done.stdout.splitlines() if x.startswith("op"))
    assert len(counts) == 13 and {n for name, n in counts.items() if name != "op11_spelling_groups"} == {"200"} and int(counts["op11_spelling_groups"]) > 0
