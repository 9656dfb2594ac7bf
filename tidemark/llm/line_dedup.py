"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed by (k1, k2), the 128-bit hash of a line's key, and sorted within buckets: n the documents that hold the key,
last the largest doc_id of them. Batches come in descending order of doc_id. Each is counted and merge-anti-joined with the runs, one
after another: a key that they already hold in enough documents goes, since a smaller doc_id cannot change it. The rest becomes a run of
level 0. Two runs of a level are merged into one of the next, by a full outer merge join of their buckets. As all runs have the same
buckets, no run is shuffled again. (Runs are never united and grouped: Spark 4.1 takes a union of bucketed tables for bucketed, and
sums nothing.)

Texts are read twice: for their lines' hashes, which are stored with number and place of the line, and to drop the lines found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CHARS, ascii_lower, discard, kept_columns, numbered, private, quoted, shared_dir, stored

BATCHES = 9
LEAST_LENGTH, LEAST_DOCS = 20, 3
#: Repeated keys are broadcast up to so many (24 bytes each); more are joined by shuffle, where Spark splits keys with very many lines.
BROADCAST_KEYS = 1 << 18


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def lines_of(text: Column) -> Column:
    """Null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(number, doc_id, text) to (number, doc_id, at, k1, k2): each line whose key has at least so many code points, its place and its key's hash."""
    keys = docs.select("number", "doc_id", F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("at", "key"))
    return keys.filter(F.char_length("key") >= least_length).select("number", "doc_id", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), "key").alias("k2"))


class LineRuns:
    """The levelled runs of one table of lines: level i holds none or one run, made of 2**i batches."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS) -> None:
        self.spark, self.least_docs = spark, least_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def _write(self, counted: DataFrame) -> DataFrame:
        """counted comes from a grouping by the hash or a join of runs, so each task writes whole buckets and a bucket is one sorted file."""
        name, path = f"tidemark_run_{uuid.uuid4().hex}", shared_dir(self.spark, "line-run")
        counted.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        run.stored_at, run.stored_as = path, name
        return run

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Both runs as one; they are deleted."""
        a, b = one.toDF("k1", "k2", "n", "last"), other.toDF("k1", "k2", "n_", "last_")
        both = a.join(b.hint("merge"), ["k1", "k2"], "full").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), F.greatest("last", "last_").alias("last"))
        out = self._write(both)
        discard(self.spark, [one, other])
        return out

    def runs(self) -> list[DataFrame]:
        return [r for r in self.levels if r is not None]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of long_lines() all of whose doc_ids are at most those of earlier batches."""
        each = lines.groupBy("number", "k1", "k2").agg(F.max("doc_id").alias("doc_id"))
        counted = each.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        held = F.lit(0)
        for i, run in enumerate(self.runs()):
            counted = counted.join(run.select("k1", "k2", F.col("n").alias(f"n{i}")).hint("merge"), ["k1", "k2"], "left")
            held = held + F.coalesce(f"n{i}", F.lit(0))
        new, level = self._write(counted.filter(held < self.least_docs).select("k1", "k2", "n", "last")), 0
        while level < len(self.levels) and self.levels[level] is not None:
            new, self.levels[level], level = self._merged(self.levels[level], new), None, level + 1
        self.levels[level : level + 1] = [new]

    def repeated(self) -> DataFrame | None:
        """Keys found in enough documents, with the largest doc_id that holds each; the runs are merged into one for it."""
        while len(own := self.runs()) > 1:
            self.levels = [self._merged(own[0], own[1]), *own[2:]]
        return own[0].filter(F.col("n") >= self.least_docs).select("k1", "k2", "last") if own else None

    def discard(self) -> None:
        discard(self.spark, self.runs())
        self.levels = []


def batches_of(lines: DataFrame, batches: int) -> list[DataFrame]:
    """lines in parts of about equal size, in descending order of doc_id; null ids, below all others, come last."""
    cuts = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
    out, high = [], F.lit(True)
    for cut in cuts:
        out.append(lines.filter(high & (F.col("doc_id") >= cut)))
        high = F.col("doc_id") < cut
    return [*out, lines.filter(high | F.col("doc_id").isNull())]


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_length: int = LEAST_LENGTH, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text; more columns pass through) with n_lines, n_dropped and text without the dropped lines.

    A line is dropped if its key (white space stripped, A-Z lower-cased) has at least least_length code points, at least least_docs
    documents hold it, and the document's doc_id is not the largest of them. Null or empty text is one empty line. Rows with equal
    doc_id count as a document each and stay or go together; null doc_id is below all others. No rows give none. Long texts cost
    in proportion to their lines. A column named n_lines or n_dropped, in any case, is replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in kept_columns(docs, ["n_lines", "n_dropped"]) if c.lower() != "text"]
    number, gone, all_, kept = private(docs, "number", "gone", "all_lines", "kept_lines")
    rows = numbered(docs.select(*map(quoted, keep), quoted("text")), number)
    lines = stored(long_lines(rows.select(F.col(number).alias("number"), F.col("doc_id").cast("bigint"), "text"), least_length), "lines")
    runs = LineRuns(spark, least_docs)
    for part in batches_of(lines, batches):
        runs.add(part)
    repeated = stored(runs.repeated(), "repeated")
    runs.discard()
    below = F.coalesce("doc_id", F.lit(-(1 << 63))) < F.coalesce("last", F.lit(-(1 << 63)))
    found = lines.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated.hint("merge"), ["k1", "k2"]).filter(below)
    doomed = found.groupBy(F.col("number").alias(number)).agg(F.collect_list("at").alias(gone))
    out = rows.join(doomed, number, "left").withColumn(all_, lines_of(F.col("text")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(gone)), lambda i: F.get(all_, i))
    out = out.withColumn(kept, F.when(F.col(gone).isNull(), F.col(all_)).otherwise(left))
    return out.select(*map(quoted, keep), F.array_join(kept, "\n").alias("text"), F.size(all_).cast("bigint").alias("n_lines"), (F.size(all_) - F.size(kept)).cast("bigint").alias("n_dropped"))
