"""Streams of history log lines: parsed, deduplicated within the watermark, counted by window and outcome, and cut into gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.drift import parse_log


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.readStream.text(path)).filter("NOT malformed AND ts IS NOT NULL")


def outcome_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Actions per window, command and outcome; rows later than the watermark are dropped."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["value"])
    return once.groupBy(F.window("ts", window).alias("w"), "command", "outcome").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "command", "outcome", "n")


def gap_sessions(stream: DataFrame, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("actions")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), by, "actions")
