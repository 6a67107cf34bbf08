"""Streaming queries over events: the table is read as a stream to its end, and the result is what the sink has then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from ..streaming import positions as P
from ..streaming import windows as W
from .registry import query


def stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source needs a folder or a glob; a table may be a file or a folder of part files.
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    running = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


END = "(SELECT max(ts) FROM events)"


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = drained(W.fixed(stream(spark, sf_dir), ["event_type"], "ts", "value", "1 hour", "2 hours"), "complete")
    return out.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800000000 THEN 1 ELSE 0 END AS f FROM e),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(t) AS start, max(t) + 1800000000 AS "end", count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, i""")
def stream_sessions(spark, sf_dir):
    out = drained(W.sessions(stream(spark, sf_dir), ["user_id"], "ts", "value", "30 minutes", "2 hours"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, epoch_us(ts) AS t, value, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS median FROM events""")
def stream_last50_median(spark, sf_dir):
    out = drained(W.last_rows_median(stream(spark, sf_dir), "user_id", "ts", "value", 50, "2 hours"), "append")
    return out.select("user_id", F.unix_micros("ts").alias("t"), "value", F.round("median", 6).alias("median"))


@query("""WITH p AS (SELECT event_type AS contig, epoch_us(ts) // 60000000 AS position, value FROM events), m AS (SELECT contig, max(position) AS furthest FROM p GROUP BY 1) SELECT contig, position, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total, false AS late FROM p JOIN m USING (contig) WHERE position <= furthest - 1001 GROUP BY ALL""")
def stream_positions(spark, sf_dir):
    """Minutes stand for positions; what lies within 1000 of the furthest is still held when the stream ends."""
    own = P.with_map_state(spark)
    rows = stream(own, sf_dir).select(F.col("event_type").alias("contig"), F.floor(F.unix_micros("ts") / 60_000_000).alias("position"), "value")
    return drained(P.released(rows, "contig", "position", "value", 1000), "append").withColumn("total", F.round("total", 4))
