"""Exact dedup by content sort, against a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import dedup_exact, exact_groups


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def norm(text):
    return (text or "").encode().lower()


def order(i):
    return (i is not None, i or 0)


def plain(rows):
    held = {}
    for i, t in rows:
        held.setdefault(norm(t), []).append(i)
    return sorted(str((i, max(held[norm(t)], key=order), len(held[norm(t)]), hashlib.sha256(norm(t)).digest())) for i, t in rows)


def shown(out):
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]))) for r in out)


EDGE = [(None, None), (None, None), (1, ""), (2, None), (3, "Same Text"), (4, "same text"), (4, "SAME TEXT"), (5, "Ünï"), (6, "ünï"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "x" * 199_999), (None, "no id")]
ALIKE = [(i, "a beginning that all these texts share, to the letter " + str(i % 40)) for i in range(200)]
HOT = [(i, "the one text of a third of all rows" if i % 3 else f"text {i % 500}") for i in range(4000)]


@pytest.mark.parametrize("rows", [EDGE, ALIKE, HOT, []], ids=["edge", "alike", "hot", "none"])
def test_exact_groups(spark, rows):
    out = exact_groups(frame(spark, rows)).collect()
    assert shown(out) == plain(rows)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({norm(t) for _, t in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_group_over_many_partitions(spark):
    """Copies that no batch holds twice, so that nothing is folded, fill several partitions, none with much more than its share."""
    rows = [(i, "one text") for i in range(3000)] + [(10_000 + i, f"other {i}") for i in range(3000)]
    session = spark.newSession()
    for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1"), ("spark.sql.shuffle.partitions", "12"), ("spark.sql.adaptive.enabled", "false")):
        session.conf.set(k, v)
    out = exact_groups(session.createDataFrame(rows, "doc_id long, text string"))
    assert shown(out.collect()) == plain(rows)
    assert [r["doc_id"] for r in out.filter("kept AND group_size > 1").collect()] == [2999]


def test_rows_with_the_same_id(spark):
    """Exactly one of the rows that share the largest id is kept, wherever they lie."""
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    out = exact_groups(session.createDataFrame([(7, "t")] * 900 + [(None, "t")] * 900, "doc_id long, text string")).collect()
    assert sum(r["kept"] for r in out) == 1 and {(r["keep_id"], r["group_size"]) for r in out} == {(7, 1800)}


def test_dedup_exact_passes_columns_through(spark):
    docs = frame(spark, EDGE).withColumns({"Group_Size": F.lit("mine"), "number": F.lit("n"), "a.b": F.lit("c"), "digest": F.lit("d")})
    out = dedup_exact(docs)
    assert out.columns == ["doc_id", "text", "number", "a.b", "digest", "group_size"]
    got = out.collect()
    assert len(got) == len({norm(t) for _, t in EDGE}) and all((r["number"], r["a.b"], r["digest"]) == ("n", "c", "d") for r in got)
    assert {r["doc_id"] for r in got} == {None, 2, 4, 5, 6, 8, 9}
