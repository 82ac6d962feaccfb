"""The detectors' aggregates over streams, with event-time windows and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as lk
from ..functions import numeric as num


def _timed(rows: DataFrame) -> DataFrame:
    """Event times with a time zone, which watermarks need."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def digit_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, n_05, prefers_05): last digits of (ts, event_type, value) by window; rows later than `late` are dropped."""
    d = _timed(events).withWatermark("ts", late).withColumn("d", num.last_digit(F.col("value"))).where("d is not null")
    out = d.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("d").isin(0, 5)).alias("n_05"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "n_05", ((F.col("n") >= 5) & (F.col("n_05") > 0.5 * F.col("n"))).alias("prefers_05"))


def repeated_values(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, user_id, n, n_distinct): exact repeats of a user's values in a window."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "user_id")
    out = w.agg(F.count("value").alias("n"), F.approx_count_distinct("value", 0.01).alias("n_distinct"))
    return out.select(F.col("w.start").alias("start"), "user_id", "n", "n_distinct")


def shared_addresses(papers: DataFrame, late: str = "30 days") -> DataFrame:
    """(email, first_paper, last_paper, n) as papers (ts, paper, text) arrive: addresses in more than one paper. Repeated papers within the watermark count once."""
    once = _timed(papers).withWatermark("ts", late).dropDuplicatesWithinWatermark(["paper"])
    edges = once.select("paper", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(lk.EMAIL), F.lit(0)))).alias("email"))
    out = edges.groupBy("email").agg(F.min("paper").alias("first_paper"), F.max("paper").alias("last_paper"), F.count("*").alias("n"))
    return out.where("first_paper <> last_paper")
