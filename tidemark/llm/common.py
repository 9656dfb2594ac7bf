"""Helpers that several operators share: shared folders, tables written there, word patterns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(name: str) -> None:
    """Send a module's functions to Python workers by value, so that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def kept_in_worker(name: str) -> dict:
    """A dict that lives as long as the Python worker process, across its tasks."""
    holder = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    return holder.__dict__.setdefault(name, {})


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see. Where that is unset, local mode, where tests run, has
    one of its own; a cluster has none, which is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = kept_in_worker("local-mode").setdefault("folder", "") or tempfile.mkdtemp(prefix="tidemark-")
        kept_in_worker("local-mode")["folder"] = top
    return f"{top.rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"


def quoted(name: str) -> Column:
    """The column of that name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, results: Iterable[str]) -> list[str]:
    """df's columns but those named like a result, in any case."""
    gone = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in gone]


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ, in any case, from all of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def by_place(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: mapInArrow cannot name columns whose names hold dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def numbered(df: DataFrame, number: str) -> DataFrame:
    """df as a stored table with a number for each row, so that equal rows, and rows without an id, can be told apart when it is read again."""
    return stored(df.withColumn(number, F.monotonically_increasing_id()), "numbered")


def stored(df: DataFrame, what: str, *, sort: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, what)
    (df.sortWithinPartitions(sort) if sort else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete what stored() wrote, or a table that was saved under a name, once nothing reads it any more."""
    jvm = spark._jvm
    for t in tables:
        if name := getattr(t, "stored_as", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


ship(__name__)
