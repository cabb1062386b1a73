"""Structured Streaming: duplicates at ingest, a log that refuses repeats, telemetry windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import norm1


def decisions(batch: DataFrame, store: DataFrame, similarity: Callable[[DataFrame, DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame] | None = None, cut: float = 0.92) -> DataFrame:
    """id, match, p, duplicate of new records against the store: the best candidate's probability, or its cosine at ``cut``
    where no model is given (it fails open)."""
    pairs = similarity(batch, store)
    scored = score(pairs) if score else pairs.withColumn("p", (F.col("similarity") >= cut).cast("double"))
    w = Window.partitionBy("id").orderBy(F.col("p").desc(), F.col("similarity").desc(), "match")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "match", "p")
    return batch.select("id").join(best, "id", "left").withColumn("duplicate", F.coalesce(F.col("p") >= 0.5, F.lit(False)))


def watch(stream: DataFrame, store: DataFrame, similarity, out_path: str, checkpoint: str, **options):
    """Starts the query that writes the decisions on each micro-batch; a batch that comes again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        decisions(batch, store, similarity, **options).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def same_text(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Candidates with equal normal form, as a stream-static equi-join: id, match, similarity."""
    return batch.withColumn("_k", norm1(F.col("body"))).join(store.select(F.col("id").alias("match"), norm1(F.col("body")).alias("_k")), "_k").where("id <> match").select("id", "match", F.lit(1.0).alias("similarity"))


def unique_log(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def telemetry(stream: DataFrame, width: str = "2 hours", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Windows of events: count, mean and errors by type, late rows up to the watermark."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def in_segments(stream: DataFrame, segments: DataFrame) -> DataFrame:
    """Stream-static range join on revision intervals [start, stop)."""
    return stream.join(segments, (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("stop")))
