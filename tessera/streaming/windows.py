"""Structured Streaming over the events source: event-time windows, sessions, de-duplication, keyed state.

Each runs to the end of what is there (availableNow) and writes its last complete result to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path, ship


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; ts becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    """What the stream gives: complete mode keeps the last batch's table, the others all batches."""
    spark, out = df.sparkSession, shared_path(df.sparkSession, name)

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/last" if mode == "complete" else f"{out}/batch={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    schema = df.schema
    return spark.read.schema(schema).parquet(f"{out}/last") if mode == "complete" else spark.read.schema(schema).parquet(out).select(*df.columns)


def counts(spark: SparkSession, sf_dir: str, size: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    df = source(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(df, "window", "complete").select("event_type", F.expr("unix_micros(w.start)").alias("start_us"), "n")


def sessions(spark: SparkSession, sf_dir: str, gap: str) -> DataFrame:
    df = source(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(df, "session", "complete").select("user_id", F.expr("unix_micros(w.start)").alias("start_us"), "n")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(source(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "dedup", "append")


def baseline(spark: SparkSession, sf_dir: str, last: int = 1000) -> DataFrame:
    """Mean and population deviation of the last values of each key, kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(dict(zip(("event_id", "value"), state.get, strict=True))) if state.exists else pd.DataFrame({"event_id": [], "value": []})
        kept = pd.concat([kept, *[f[["event_id", "value"]] for f in frames]]).astype({"event_id": "int64", "value": "float64"}).sort_values("event_id").tail(last)
        state.update((kept["event_id"].tolist(), kept["value"].tolist()))
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(kept)], "mean": [kept["value"].mean()], "sd": [kept["value"].std(ddof=0)]})

    ship(spark)
    df = source(spark, sf_dir).select("event_type", "event_id", "value").groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, mean double, sd double", "ids array<long>, vals array<double>", "update", "NoTimeout")
    out = drained(df, "baseline", "update")
    return out.groupBy("event_type").agg(F.max_by(F.struct("n", "mean", "sd"), "n").alias("s")).select("event_type", "s.n", F.round("s.mean", 6).alias("mean"), F.round("s.sd", 6).alias("sd"))


def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type where late events are dropped.

    The stream is the events, then a batch that closes their windows, then copies of all events a day behind the watermark,
    which no window takes any more. Windows of a day; what the closing batch adds is left out.
    """
    out = shared_path(spark, "late-source")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = e.agg(F.max("ts")).first()[0]
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("closing").alias("event_type"), (F.lit(end) + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    counted = shared_path(spark, "late-counts")
    for batch in (e, closing, closing, e):  # the second closing batch lets the watermark of the first take effect
        batch.coalesce(1).write.mode("append").parquet(f"{out}/here")
        s = spark.readStream.schema(e.schema).parquet(f"{out}/here")
        w = s.withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        q = w.writeStream.outputMode("append").format("parquet").option("path", counted).option("checkpointLocation", f"{counted}-checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(counted).where("event_type <> 'closing'")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"))


def cooldown(spark: SparkSession, sf_dir: str, pause: int) -> DataFrame:
    """event_id of error events that fire: the last that fired for the user is at least `pause` microseconds before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        fired = []
        for t, i in sorted((t, i) for f in frames for t, i in zip(f["us"], f["event_id"], strict=True)):
            if last is None or t - last >= pause:
                last = int(t)
                fired.append(i)
        state.update((last,))
        yield pd.DataFrame({"event_id": fired}, dtype="int64")

    ship(spark)
    e = source(spark, sf_dir).where("event_type = 'error'").select("user_id", "event_id", F.expr("unix_micros(ts)").alias("us"))
    return drained(e.groupBy("user_id").applyInPandasWithState(step, "event_id long", "last long", "append", "NoTimeout"), "cooldown", "append")
