"""Time-series regularity over (label, t, y): one row of measurements a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10


def series_measures(points: DataFrame) -> DataFrame:
    """All detectors in two passes over the points.

    (label, n, monotonic, direction, growth_cv, constant_growth, spacing_cv, spacing, second_cv, constant_second,
    r2_linear, overfit_linear, r2_exponential, overfit_exponential); a measure that isn't defined is null. A constant
    series counts as monotonic, as no difference speaks against it.
    """
    w = Window.partitionBy("label").orderBy("t")
    d = F.col("y") - F.lag("y").over(w)
    steps = points.withColumn("d", d).withColumn("d2", F.col("d") - F.lag("d").over(w)).withColumn("g", F.try_divide(F.col("d"), F.lag("y").over(w)))
    moved = F.abs("d") > TINY
    once = steps.groupBy("label").agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_and(F.when(moved, F.col("d") > 0)), F.lit(True)).alias("up"),
        F.coalesce(F.bool_and(F.when(moved, F.col("d") < 0)), F.lit(True)).alias("down"),
        F.min("y").alias("low"),
        F.avg("g").alias("mg"), F.stddev_pop("g").alias("sg"),
        F.avg("d").alias("md"), F.stddev_pop("d").alias("sd"),
        F.avg("d2").alias("m2"), F.stddev_pop("d2").alias("s2"),
        F.regr_r2("y", "t").alias("r2"), F.regr_syy("y", "t").alias("syy"),
        F.regr_slope(F.when(F.col("y") > 0, F.ln("y")), "t").alias("b"), F.regr_intercept(F.when(F.col("y") > 0, F.ln("y")), "t").alias("a"),
    )
    cv = lambda m, s: F.when(F.abs(m) > TINY, F.col(s) / F.abs(m))
    fit = once.where("low > 0 and n >= 4").select("label", "a", "b", "syy")
    residual = points.join(fit, "label").groupBy("label", "syy").agg(F.sum(F.pow(F.col("y") - F.exp(F.col("a") + F.col("b") * F.col("t")), 2)).alias("rss"))
    curved = residual.select("label", F.when(F.col("syy") > TINY, 1 - F.col("rss") / F.col("syy")).alias("r2_exponential"))
    growth = F.when((F.col("low") > 0) & (F.col("n") >= 3), cv("mg", "sg"))
    spacing, second = F.when(F.col("n") >= 3, cv("md", "sd")), F.when(F.col("n") >= 4, cv("m2", "s2"))
    linear = F.when((F.col("n") >= 4) & (F.col("syy") > TINY), F.col("r2"))
    no = F.lit(False)
    return once.join(curved, "label", "left").select(
        "label", "n",
        ((F.col("n") >= 3) & (F.col("up") | F.col("down"))).alias("monotonic"), F.when(F.col("up"), "increasing").when(F.col("down"), "decreasing").alias("direction"),
        growth.alias("growth_cv"), F.coalesce(growth < 1e-4, no).alias("constant_growth"),
        spacing.alias("spacing_cv"), F.when(spacing < 1e-4, "HIGH").when(spacing < 1e-3, "MEDIUM").alias("spacing"),
        second.alias("second_cv"), F.coalesce(second < 1e-6, no).alias("constant_second"),
        linear.alias("r2_linear"), F.coalesce(linear > 0.999, no).alias("overfit_linear"),
        "r2_exponential", F.coalesce(F.col("r2_exponential") > 0.999, no).alias("overfit_exponential"),
    )


def severity_counts(measures: DataFrame) -> DataFrame:
    """(label, n_high, n_medium) of the findings."""
    one = lambda c: F.when(c, 1).otherwise(0)
    high = one(F.col("constant_growth")) + one(F.col("spacing") == "HIGH") + one(F.col("constant_second"))
    medium = one(F.col("monotonic")) + one(F.col("spacing") == "MEDIUM") + one(F.col("overfit_linear")) + one(F.col("overfit_exponential"))
    return measures.select("label", high.alias("n_high"), medium.alias("n_medium"))
