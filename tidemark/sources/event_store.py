"""A stored table of events, keyed, that appends change in place: a base, deltas, and a log that says which of them count.

An append writes its rows as a delta, then publishes the next version of the log: a file that names the base and all deltas in their
order. What no version names does not exist for readers, so an append that fails half-way leaves nothing but a folder that `vacuum`
deletes. A version's file appears whole or not at all, and never replaces another, so of two appends at once one fails and can try again.
Each writer numbers its batches, and the log keeps the last number of each: a batch that comes again changes nothing. Reading joins the
base with the keys of the deltas, which are few, and takes the newest row of each key; compaction writes that as the next base.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


class EventStore:
    """The table at a path that the driver and all executors see."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...] = ("d", "n"), order: tuple[str, ...] = ("t", "i"), most_deltas: int = 8) -> None:
        """keys: one row each, null is a key like others. order: of rows of one batch with the same key the last in it stays.
        most_deltas: so many are compacted."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.most_deltas = list(keys), list(order), most_deltas
        self.conf, self.hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs

    def _files(self, folder: str) -> list[str]:
        at = self.hadoop.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def state(self) -> dict:
        """The last version: version, base (a folder or none), deltas (folders, oldest first), writers (the last batch of each)."""
        versions = [f for f in self._files("log") if f.endswith(".json") and not f.startswith(".")]
        if not versions:
            return {"version": 0, "base": None, "deltas": [], "writers": {}}
        at = self.hadoop.Path(f"{self.path}/log/{versions[-1]}")
        stream = at.getFileSystem(self.conf).open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """Write the next version beside its place, then move it there; fails if that version is there already."""
        part = self.hadoop.Path(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = part.getFileSystem(self.conf).create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)
        self.hadoop.FileContext.getFileContext(part.toUri(), self.conf).rename(part, self.hadoop.Path(f"{self.path}/log/{state['version']:012d}.json"), never)

    def _write(self, rows: DataFrame, what: str) -> str:
        folder = f"{what}/{uuid.uuid4().hex}"
        rows.select(self.schema.names).write.parquet(f"{self.path}/{folder}")
        return folder

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def _newest(self, rows: DataFrame, order: list) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(W.partitionBy(*self.keys).orderBy(*order))).filter("_k = 1").drop("_k")

    def append(self, events: DataFrame, writer: str, batch: int) -> bool:
        """Put the events into the table, replacing rows of their keys. A batch that the writer has put in before changes nothing: false."""
        state = self.state()
        if state["writers"].get(writer, -1) >= batch:
            return False
        delta = self._write(self._newest(events, [F.col(c).desc() for c in self.order]), "delta")
        state |= {"version": state["version"] + 1, "deltas": [*state["deltas"], delta], "writers": state["writers"] | {writer: batch}}
        self._publish(state)
        if len(state["deltas"]) >= self.most_deltas:
            self.compact()
        return True

    def _read(self, state: dict) -> DataFrame:
        none = self.spark.createDataFrame([], self.schema)
        base = self._rows(state["base"]) if state["base"] else none
        if not state["deltas"]:
            return base
        deltas = reduce(DataFrame.unionByName, [self._rows(d).withColumn("_nth", F.lit(i)) for i, d in enumerate(state["deltas"])])
        newest = self._newest(deltas, [F.col("_nth").desc()]).drop("_nth")
        if not state["base"]:
            return newest
        same = reduce(lambda a, b: a & b, [base[k].eqNullSafe(F.col(f"_{k}")) for k in self.keys])
        return base.join(newest.select(*[F.col(k).alias(f"_{k}") for k in self.keys]), same, "left_anti").unionByName(newest)

    def read(self) -> DataFrame:
        """The rows as of now; later appends do not change what has been read."""
        return self._read(self.state())

    def compact(self) -> None:
        """Make base and deltas one new base."""
        state = self.state()
        if state["deltas"]:
            base = self._write(self._read(state), "base")
            self._publish(state | {"version": state["version"] + 1, "base": base, "deltas": []})

    def vacuum(self) -> int:
        """Delete folders and files that the last version does not name; how many. Not while others read older versions or append."""
        state, gone = self.state(), 0
        named = {state["base"], *state["deltas"], f"log/{state['version']:012d}.json"}
        for folder in ("base", "delta", "log"):
            for name in self._files(folder):
                if f"{folder}/{name}" not in named:
                    at = self.hadoop.Path(f"{self.path}/{folder}/{name}")
                    gone += at.getFileSystem(self.conf).delete(at, True)
        return gone

    def sink(self, events: DataFrame, writer: str) -> DataStreamWriter:
        """A stream that puts each micro-batch into the table once, however often it is run."""
        return events.writeStream.foreachBatch(lambda rows, number: self.append(rows, writer, number) and None)
