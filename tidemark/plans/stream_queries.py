"""Streams over the events table, run to the end of what is there: their final rows equal the batch queries' rows, which SQL gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import log
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import EVENT_LOG_SQL, epoch
from tidemark.streaming import live

QUERIES = {}
ORACLE_SQL = {}


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, in the log's columns."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")


def as_log(e: DataFrame) -> DataFrame:
    return e.select(
        F.concat(F.lit("dev"), (F.col("user_id") % 4).cast("string")).alias("d"),
        F.col("event_id").alias("n"),
        F.concat(F.lit("item"), F.col("user_id").cast("string")).alias("i"),
        epoch("ts").alias("t"),
        F.when(F.col("event_type") == "signup", "flag").otherwise("text").alias("m"),
        (F.col("event_type") != "error").alias("hit"),
    )


def drained(out: DataFrame, mode: str, home: SparkSession | None = None) -> DataFrame:
    """Run a stream over what is there and return the table that its executors wrote: the last result in complete mode, else the rows of all micro-batches.

    The table and the stream's state are in the shared folder; no row goes through the driver. A micro-batch that is run again replaces its rows.
    home: the session that reads the table, if the stream runs in one of its own.
    """
    spark, path = out.sparkSession, shared_folder(out.sparkSession, "stream")
    home = home or spark

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    spark.createDataFrame([], out.schema).write.parquet(f"{path}/batch=-1")  # so that a stream without a micro-batch has a table too
    q = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return home.read.parquet(path).select(*out.columns)


PIECES, DELAY, JITTER = 4, "2 DAYS", 40
#: An event arrives up to JITTER hours after it happened; arrivals are cut into PIECES of equal time.
ARRIVAL_SQL = f"""e AS (SELECT event_id, ts, user_id, event_type, event_id * 7919 % {JITTER} * 3600 + CAST(floor(epoch(ts)) AS BIGINT) AS arrival FROM events),
b AS (SELECT *, least((arrival - (SELECT min(arrival) FROM e)) * {PIECES} // greatest((SELECT max(arrival) - min(arrival) FROM e), 1), {PIECES - 1}) AS piece FROM e)"""


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the order in which they arrive: event_id, at, user_id, event_type, piece."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select("event_id", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))).alias("at"), "user_id", "event_type", (F.col("event_id") * 7919 % JITTER * 3600 + epoch("ts")).alias("arrival"))
    ends = e.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi"))
    e = e.withColumn("ends", ends.select(F.struct("lo", "hi")).scalar())
    piece = F.least(F.floor((F.col("arrival") - F.col("ends.lo")) * PIECES / F.greatest(F.col("ends.hi") - F.col("ends.lo"), F.lit(1))), F.lit(PIECES - 1))
    return e.withColumn("piece", piece.cast("bigint")).drop("arrival", "ends")


def in_pieces(spark: SparkSession, sf_dir: str, start) -> None:
    """Run a stream piece by piece: each is written to the folder that the stream reads, then a new run of it, from the same state, takes
    what is new. start: from the stream's rows and the folder of its state to a writer."""
    rows, folder, state = arriving(spark, sf_dir).drop("piece"), shared_folder(spark, "arrived"), shared_folder(spark, "state")
    for piece in range(PIECES):
        arriving(spark, sf_dir).filter(F.col("piece") == piece).drop("piece").write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def closed(spark: SparkSession, sf_dir: str, windows) -> DataFrame:
    """The windows that a stream over the pieces has given; each micro-batch's rows replace those that it wrote before."""
    path = shared_folder(spark, "windows")
    shape = windows(arriving(spark, sf_dir).drop("piece"))
    spark.createDataFrame([], shape.schema).write.parquet(f"{path}/batch=-1")
    keep = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    in_pieces(spark, sf_dir, lambda rows: windows(rows).writeStream.outputMode("append").foreachBatch(keep))
    return spark.read.schema(shape.schema).parquet(path)


def extra(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def seconds(c: str):
    return F.unix_seconds(c).alias(c + "_")


@extra("""WITH w AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 21600 * 21600 AS start_ FROM events) SELECT event_type, start_, start_ + 21600 AS end_, count(*) AS n FROM w
WHERE start_ + 21600 <= (SELECT epoch(max(ts)) - 2 * 86400 FROM events) GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    """Events by kind in windows of six hours, from pieces that arrive out of order; windows that the last watermark has passed."""
    return closed(spark, sf_dir, lambda e: live.tumbling(e, ["event_type"], "6 hours", DELAY)).select("event_type", seconds("start"), seconds("end"), "n")


@extra("""WITH w AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 21600 * 21600 - k * 21600 AS start_ FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT event_type, start_, start_ + 86400 AS end_, count(*) AS n FROM w
WHERE start_ + 86400 <= (SELECT epoch(max(ts)) - 2 * 86400 FROM events) GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    """Events by kind in windows of a day, one begun every six hours."""
    return closed(spark, sf_dir, lambda e: live.sliding(e, ["event_type"], "1 day", "6 hours", DELAY)).select("event_type", seconds("start"), seconds("end"), "n")


@extra("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o), s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 4 HOURS AS b, count(*) AS n FROM g GROUP BY user_id, g)
SELECT user_id, CAST(floor(epoch(a)) AS BIGINT) AS start_, CAST(floor(epoch(b)) AS BIGINT) AS end_, n FROM s WHERE b <= (SELECT max(ts) - INTERVAL 2 DAYS FROM events)""")
def stream_sessions(spark, sf_dir):
    """Each user's sessions, parted by pauses of more than four hours, from pieces that arrive out of order."""
    return closed(spark, sf_dir, lambda e: live.sessions(e, ["user_id"], "4 hours", DELAY)).select("user_id", seconds("start"), seconds("end"), "n")


@extra(f"""WITH {ARRIVAL_SQL}, m AS (SELECT piece, max(max(ts)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b GROUP BY piece)
SELECT event_id, coalesce(ts < newest - INTERVAL 12 HOURS, false) AS late FROM b JOIN m ON b.piece = m.piece""")
def stream_late(spark, sf_dir):
    """Every event once: those within twelve hours of the newest that came before their piece, and the late ones."""
    path = shared_folder(spark, "late")
    both = live.LateRows(spark, path, arriving(spark, sf_dir).drop("piece").schema, "12 HOURS")
    in_pieces(spark, sf_dir, both.sink)
    return both.read().select("event_id", "late")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {EVENT_LOG_SQL} {sql}"
        return f

    return add


@query("SELECT DISTINCT d, n FROM ev")
def stream_dedup(spark, sf_dir):
    rows = as_log(stream(spark, sf_dir))
    return drained(live.dedup(rows.union(rows)).select("d", "n"), "append")


@extra("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup_bounded(spark, sf_dir):
    """Each event once, though every one arrives twice; keys are forgotten once the watermark has passed them."""
    path = shared_folder(spark, "dedup")
    spark.createDataFrame([], "event_id bigint, user_id bigint").write.parquet(f"{path}/batch=-1")
    keep = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    once = lambda e: live.dedup(e.union(e).withColumnsRenamed({"user_id": "d", "event_id": "n"}), DELAY).select(F.col("n").alias("event_id"), F.col("d").alias("user_id"))
    in_pieces(spark, sf_dir, lambda rows: once(rows).writeStream.foreachBatch(keep))
    return spark.read.parquet(path).select("event_id", "user_id")


@query("SELECT i, max(t) AS last_sec, count(*) AS reps FROM ev WHERE m <> 'flag' GROUP BY i")
def stream_item_state(spark, sf_dir):
    return drained(live.item_state(as_log(stream(spark, sf_dir))), "complete")


@query("SELECT i, max(t) AS flagged_at FROM ev WHERE m = 'flag' GROUP BY i")
def stream_flags(spark, sf_dir):
    return drained(live.flags(as_log(stream(spark, sf_dir))), "complete")


@query("""SELECT i AS concept, sum(CASE WHEN k <= 10 AND g >= 2 THEN 1 ELSE 0 END)::DOUBLE / least(count(*), 10) AS a, count(*) AS reps FROM
 (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t DESC, n DESC, d DESC) AS k FROM ev WHERE m <> 'flag') GROUP BY i""")
def stream_mastery(spark, sf_dir):
    rows = log.answers_only(as_log(stream(live.on_disk(spark), sf_dir))).withColumnRenamed("i", "concept")
    out = drained(live.mastery(rows.select("concept", "t", "n", "d", "hit")), "update", spark)
    return out.groupBy("concept").agg(F.max_by("a", "reps").alias("a"), F.max("reps").alias("reps"))


@query("SELECT i, count(*) AS n FROM ev WHERE m <> 'flag' GROUP BY i")
def stream_dashboard(spark, sf_dir):
    """Each micro-batch adds its counts to a table in the shared folder; the query reads the sums."""
    path = shared_folder(spark, "dashboard")

    def show(rows: DataFrame, number: int) -> None:
        log.answers_only(rows).groupBy("i").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    live.dashboard(as_log(stream(spark, sf_dir)), show).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("i").agg(F.sum("n").alias("n"))
