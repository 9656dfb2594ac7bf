"""Live state over the event stream, equal to the batch queries whatever the order of arrival.

Lateness is unbounded, as in a log that devices sync late: "the newest ten by (t, n, d)" is mergeable, so a late event is exact.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.operators.log import HISTORY, answers_only

STATE = "hits array<boolean>, t array<bigint>, n array<bigint>, d array<string>, reps bigint"


def dedup(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each (d, n) once. Exact for ever without a delay (state grows with the keys); with one, within the watermark on column at."""
    return events.dropDuplicates(["d", "n"]) if delay is None else events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["d", "n"])


def item_state(events: DataFrame) -> DataFrame:
    return answers_only(events).groupBy("i").agg(F.max("t").alias("last_sec"), F.count("*").alias("reps"))


def flags(events: DataFrame) -> DataFrame:
    return events.filter("m = 'flag'").groupBy("i").agg(F.max("t").alias("flagged_at"))


class _Newest(StatefulProcessor):
    """Per concept the newest ten attempts by (t, n, d), newest last, and how many there have been."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: TimerValues) -> Iterator[Row]:  # noqa: N802  (Spark's name)
        held = self.newest.get()
        hits, t, n, d, reps = held if held else ([], [], [], [], 0)
        own = list(zip(t, n, d, hits, strict=True))
        for r in rows:
            own.append((r["t"], r["n"], r["d"], r["hit"]))
            reps += 1
            if len(own) > 8 * HISTORY:
                own = sorted(own)[-HISTORY:]
        own = sorted(own)[-HISTORY:]
        self.newest.update(([r[3] for r in own], [r[0] for r in own], [r[1] for r in own], [r[2] for r in own], reps))
        yield Row(concept=key[0], a=sum(r[3] for r in own) / len(own), reps=reps)

    def close(self) -> None:
        pass


def mastery(attempts: DataFrame) -> DataFrame:
    """Share of hits in the newest ten attempts of each concept. attempts: concept, t, n, d, hit, none null; each once (see dedup).

    State is ten rows a key, on disk: the stream's session must have RocksDB as its state store (see `on_disk`).
    """
    rows = attempts.select("concept", "t", "n", "d", "hit")
    return rows.groupBy("concept").transformWithState(_Newest(), "concept string, a double, reps bigint", "Update", "None")


def on_disk(spark: SparkSession) -> SparkSession:
    """A session of the same cluster whose streams keep their state in RocksDB; the one given stays as it is."""
    session = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(k, spark.conf.get(k))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def tumbling(events: DataFrame, keys: list[str], size: str, delay: str, at: str = "at") -> DataFrame:
    """keys, start, end, n: events in each window of this size, once the watermark, `delay` behind the newest event, has passed its end."""
    return sliding(events, keys, size, size, delay, at)


def sliding(events: DataFrame, keys: list[str], size: str, step: str, delay: str, at: str = "at") -> DataFrame:
    """keys, start, end, n: events in each window of this size, one begun at each step. State: a count for each key of each open window."""
    counted = events.withWatermark(at, delay).groupBy(F.window(at, size, step), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, keys: list[str], gap: str, delay: str, at: str = "at") -> DataFrame:
    """keys, start, end, n: stretches of a key's events without a pause longer than the gap; end is the last event and the gap.

    A row that comes late, but before the watermark has passed, joins the sessions on both of its sides into one.
    """
    counted = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class LateRows:
    """Parts a stream into rows in time and rows behind the watermark; both go to tables, so that no row vanishes.

    A row is late if it is more than `delay` older than the newest row of the micro-batches before its own. Each micro-batch writes its
    newest time beside its rows; one that is run again reads those of the batches before it alone, and replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, delay: str, at: str = "at") -> None:
        self.spark, self.path, self.schema, self.delay, self.at = spark, path, schema, delay, at
        spark.createDataFrame([], schema).write.parquet(f"{path}/rows/batch=-1/late=false")
        spark.createDataFrame([], f"newest {schema[at].dataType.simpleString()}").write.parquet(f"{path}/newest/batch=-1")

    def put(self, rows: DataFrame, batch: int) -> None:
        newest = self.spark.read.parquet(f"{self.path}/newest").filter(F.col("batch") < batch).agg((F.max("newest") - F.expr(f"INTERVAL {self.delay}")).alias("mark"))
        late = F.coalesce(F.col(self.at) < newest.scalar(), F.lit(False))
        rows = rows.withColumn("late", late).persist()
        try:
            rows.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/batch={batch}")
            rows.agg(F.max(self.at).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/newest/batch={batch}")
        finally:
            rows.unpersist()

    def sink(self, events: DataFrame) -> DataStreamWriter:
        return events.writeStream.foreachBatch(self.put)

    def read(self) -> DataFrame:
        """All rows, with `late`."""
        schema = StructType([*self.schema.fields, StructField("late", BooleanType()), StructField("batch", LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").drop("batch")


def dashboard(events: DataFrame, show: Callable[[DataFrame, int], None]):
    """After each micro-batch, `show` gets the batch's rows and its number, to run any batch query."""
    return events.writeStream.foreachBatch(show)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that executors need not have this package installed
