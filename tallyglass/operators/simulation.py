"""Monte-Carlo control: made-up trial tables without fabrication, and how often each detector still fires."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, mean, deviation, least and greatest value of the made-up variables.
VARIABLES = (
    ("Age", 78.5, 5.2, 70.0, 95.0),
    ("BMI", 28.3, 4.8, 18.0, 45.0),
    ("SPPB", 8.2, 1.5, 3.0, 12.0),
    ("GaitSpeed", 0.85, 0.18, 0.4, 1.3),
    ("CRP", 3.5, 2.8, 0.3, 20.0),
    ("Hb", 12.8, 1.5, 9.0, 17.0),
    ("SBP", 135.0, 18.0, 100.0, 180.0),
    ("Creatinine", 0.95, 0.25, 0.4, 1.8),
)


def normal(key: Column) -> Column:
    """A standard normal number drawn from a text by its MD5 (Box and Muller), the same wherever it is computed."""
    digits = F.md5(key.cast("binary"))
    part = lambda k: (F.conv(F.substring(digits, k, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.sqrt(-2 * F.ln(part(1))) * F.cos(F.lit(2 * math.pi) * part(9))


def trial_rows(spark: SparkSession, trials: int = 1000, rows: int = 60, groups: int = 4, variables: int = 8, seed: int = 7) -> DataFrame:
    """(source, idx, G1_V1, ...): one wide table for all trials, each a source of its own, from a seed.

    Values are normal, cut to the variable's range and rounded: to 2 places for deviations below 0.5, else to 1.
    """
    cols = []
    for g in range(groups):
        for v in range(variables):
            _, mean, sd, low, high = VARIABLES[v % len(VARIABLES)]
            drawn = normal(F.concat_ws(":", F.lit(str(seed)), F.lit(f"G{g + 1}_V{v + 1}"), F.col("id").cast("string")))
            x = F.least(F.greatest(drawn * sd + mean, F.lit(low)), F.lit(high))
            cols.append(F.round(x, 2 if sd < 0.5 else 1).alias(f"G{g + 1}_V{v + 1}"))
    base = spark.range(0, trials * rows, numPartitions=max(1, trials * rows // 20_000))
    return base.select(F.concat(F.lit("trial"), F.floor(F.col("id") / rows).cast("string")).alias("source"), (F.col("id") % rows).alias("idx"), *cols)


def false_positive_rates(findings: DataFrame, trials: int) -> DataFrame:
    """(detector, findings, trials_hit, rate, trial_rate): findings a trial (can exceed 1), and the share of trials with one."""
    out = findings.groupBy("detector").agg(F.count("*").alias("findings"), F.count_distinct("source").alias("trials_hit"))
    return out.withColumn("rate", F.col("findings") / trials).withColumn("trial_rate", F.col("trials_hit") / trials)
