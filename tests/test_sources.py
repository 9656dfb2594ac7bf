"""JSON sources and sinks, and record parsing."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import parse as P
from tidemark.sources import json_files as J


def test_json_round_trip_is_stable(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "x"), (2, "é", "")], "b int, a string, c string")
    J.write_json(rows, str(tmp_path / "one"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "one")).collect()) == ['{"a":"é","b":2,"c":""}', '{"a":null,"b":1,"c":"x"}']
    assert sorted(map(tuple, J.read_json(spark, str(tmp_path / "one"), "b int, a string, c string").collect())) == [(1, None, "x"), (2, "é", "")]


def test_optional_input(spark, tmp_path):
    assert J.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"a": [}')
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        J.read_optional(spark, str(tmp_path / "bad"), "a int").collect()


def test_expressions(spark):
    rest, words = P.bracketed(F.array(F.lit("（本）"), F.lit("a b"), F.lit("（a b）")))
    short, places = P.trim_offsets(F.lit("  ab "), F.array(F.lit(0), F.lit(2), F.lit(9)))
    r = spark.range(1).select(rest.alias("rest"), words.alias("words"), short.alias("s"), places.alias("p"), J.decode_hex(F.lit("414")).alias("hex"), P.numbered_items(F.lit("2) b 10) c 1) a")).alias("n")).head()
    assert (r["rest"], r["words"], r["s"], r["p"], r["hex"]) == (["a b", "（a b）"], ["本"], "ab", [0], "A@")
    assert [x["no"] for x in r["n"]] == [1, 2, 10]
