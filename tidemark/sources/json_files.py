"""JSON in and out: canonical documents with sorted keys, readers with a declared schema, inputs that may be absent."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(columns: list[str]) -> Column:
    """A row as JSON with its keys in order, so that equal rows give equal bytes; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(canonical(rows.columns).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a record that does not fit; the schema is never inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like read_json, but without rows where there is no such path. Bad JSON still fails."""
    try:
        return read_json(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def decode_hex(digits: Column, charset: str = "UTF-8") -> Column:
    """Text of hexadecimal digits; an odd number of them is padded with 0."""
    even = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.decode(F.unhex(even), charset)
