"""Recalculation of reported statistics from summary values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import special

#: Usual range and least possible coefficient of variation (percent) by type of data.
CV_LIMITS = {
    "mtt_od": (5.0, 20.0, 1.0),
    "cell_count": (5.0, 15.0, 1.0),
    "wb_gray": (10.0, 30.0, 2.0),
    "flow_apoptosis": (5.0, 20.0, 1.5),
    "clinical_age": (15.0, 40.0, 1.0),
    "clinical_lab": (5.0, 30.0, 1.0),
    "migration": (5.0, 25.0, 1.0),
    "general": (5.0, 30.0, 1.0),
}


def cv_limit(data_type: Column, which: int) -> Column:
    """0: low, 1: high, 2: least possible; an unknown type counts as general."""
    table = F.create_map(*[F.lit(x) for k, v in CV_LIMITS.items() for x in (k, v[which])])
    return F.coalesce(F.try_element_at(table, data_type), F.lit(CV_LIMITS["general"][which]))


def cv_check(groups: DataFrame) -> DataFrame:
    """groups (mean, sd, data_type) with cv (percent) and verdict; a mean up to 0 or a negative deviation isn't judged."""
    cv = F.abs(F.col("sd") / F.col("mean")) * 100
    low, least = cv_limit(F.col("data_type"), 0), cv_limit(F.col("data_type"), 2)
    verdict = F.when((cv == 0) | (cv < least), "CRITICAL").when(cv < 0.5 * low, "SUSPICIOUS").otherwise("NORMAL")
    known = (F.col("mean") > 0) & (F.col("sd") >= 0)
    return groups.withColumn("cv", F.when(known, cv)).withColumn("verdict", F.when(known, verdict))


def t_recalculation(rows: DataFrame) -> DataFrame:
    """rows (m1, sd1, n1, m2, sd2, n2) with the pooled t, df, p (normal approximation), Cohen's d, its size, and extreme (d > 5); a deviation up to 0 gives nulls."""
    ok = (F.col("sd1") > 0) & (F.col("sd2") > 0) & (F.col("n1") + F.col("n2") > 2)
    sp = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("sd1") * F.col("sd1") + (F.col("n2") - 1) * F.col("sd2") * F.col("sd2"), F.col("n1") + F.col("n2") - 2))
    se = sp * F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))
    diff = F.col("m1") - F.col("m2")
    out = rows.withColumn("t", F.when(ok, F.when(se > 1e-10, diff / se).otherwise(F.lit(float("inf"))))).withColumn("df", F.when(ok, (F.col("n1") + F.col("n2") - 2).cast("double")))
    d = F.when(ok, F.abs(diff) / sp)
    size = F.when(d < 0.2, "tiny").when(d < 0.5, "small").when(d < 0.8, "medium").when(d < 2.0, "large").when(d >= 2.0, "huge")
    return out.withColumn("p", num.p_from_t(F.col("t"), F.col("df"))).withColumn("cohens_d", d).withColumn("effect", size).withColumn("extreme", d > 5.0)


def _anova(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of squares of (mean, sd, n) rows in two aggregations that combine before the shuffle."""
    sums = groups.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("mean") * F.col("n")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"),
        F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd")).alias("ss_within"), F.bool_or(F.col("n") <= 3).alias("n_too_small"),
    )
    mean = sums.select(*keys, (F.col("s") / F.col("N")).alias("gm"))
    between = groups.join(mean, keys).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("mean") - F.col("gm")) * (F.col("mean") - F.col("gm"))).alias("ss_between"))
    return sums.drop("s", "q").join(between, keys)


def anova_recalculation(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: F from (mean, sd, n), p (two-sided approximation), eta squared; F is 0 without variation within or with one group."""
    a = _anova(groups, keys)
    usable = (F.col("ss_within") > 0) & (F.col("k") > 1)
    f = F.when(usable, F.try_divide(F.try_divide(F.col("ss_between"), F.col("k") - 1), F.try_divide(F.col("ss_within"), F.col("N") - F.col("k")))).otherwise(0.0)
    out = a.withColumn("f", f)
    p = F.when(F.col("f") > 0, num.p_from_f(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("N") - F.col("k")).cast("double"))).otherwise(1.0)
    return out.select(*keys, "k", F.col("N").alias("n"), "f", p.alias("p"), F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta_sq"), "n_too_small")


def anova_exact(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The same with the exact upper tail; without variation within groups F is infinite and p is 0."""
    a = _anova(groups, keys)
    f = F.when(F.col("ss_within") > 0, F.try_divide(F.try_divide(F.col("ss_between"), F.col("k") - 1), F.try_divide(F.col("ss_within"), F.col("N") - F.col("k")))).otherwise(F.lit(float("inf")))
    out = a.withColumn("f", f)
    return out.select(*keys, "k", F.col("N").alias("n"), "f", special.f_sf("f", (F.col("k") - 1).cast("double"), (F.col("N") - F.col("k")).cast("double")).alias("p"))


def t_exact(rows: DataFrame) -> DataFrame:
    """rows (m1, sd1, n1, m2, sd2, n2) with the pooled t and its exact two-sided p; t is 0 for a standard error of 0."""
    sp2 = F.try_divide((F.col("n1") - 1) * F.col("sd1") * F.col("sd1") + (F.col("n2") - 1) * F.col("sd2") * F.col("sd2"), F.col("n1") + F.col("n2") - 2)
    se = F.sqrt(sp2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = rows.withColumn("t", F.when(se > 0, (F.col("m1") - F.col("m2")) / se).otherwise(0.0)).withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    return out.withColumn("p", special.t_two_sided("t", "df"))


def chi2_2x2(rows: DataFrame) -> DataFrame:
    """rows (x1, n1, x2, n2), x as counts or as rates between 0 and 1, with Yates' chi-square and p; skipped (needs_fisher) where an expected count is below 5."""
    count = lambda x, n: F.when((F.col(x) > 0) & (F.col(x) < 1), F.round(F.col(x) * F.col(n))).otherwise(F.col(x)).cast("double")
    a, c = count("x1", "n1"), count("x2", "n2")
    b, d = F.col("n1") - a, F.col("n2") - c
    n = (F.col("n1") + F.col("n2")).cast("double")
    least = F.least(*[F.col(r) * s / n for r in ("n1", "n2") for s in (a + c, b + d)])
    off = F.abs(a * d - b * c) - n / 2
    chi = F.when(least >= 5, n * off * off / (F.col("n1") * F.col("n2") * (a + c) * (b + d)))
    out = rows.withColumn("min_expected", least).withColumn("needs_fisher", F.col("min_expected") < 5).withColumn("chi2", chi)
    return out.withColumn("p", num.p_from_chi2(F.col("chi2"), F.lit(1.0)))


def chi2_table(counts: DataFrame, keys: list[str], row: str, col: str, n: str) -> DataFrame:
    """Pearson's chi-square of each key's r x c table of (row, col, n), absent cells as 0, with the exact p."""
    by_row = counts.groupBy(*keys, row).agg(F.sum(n).alias("_r"))
    by_col = counts.groupBy(*keys, col).agg(F.sum(n).alias("_c"))
    total = counts.groupBy(*keys).agg(F.sum(n).alias("_n"))
    grid = by_row.join(by_col, keys).join(total, keys).join(counts.groupBy(*keys, row, col).agg(F.sum(n).alias("_o")), [*keys, row, col], "left")
    e = F.col("_r") * F.col("_c") / F.col("_n")
    off = F.coalesce("_o", F.lit(0)) - e
    out = grid.groupBy(*keys).agg(F.sum(off * off / e).alias("chi2"), F.min(e).alias("min_expected"), ((F.count_distinct(row) - 1) * (F.count_distinct(col) - 1)).cast("double").alias("df"))
    return out.select(*keys, "chi2", "df", "min_expected", (F.col("min_expected") < 5).alias("needs_fisher"), special.chi2_sf("chi2", "df").alias("p"))


def p_distribution(values: DataFrame, keys: list[str]) -> DataFrame:
    """Reported p values of each key: how many of those in (0, 0.2) lie in (0.04, 0.06), and the commonest value to 2 places among all; of 5 or more."""
    v = values.withColumn("_p", F.col("p").cast("double"))
    small, near = (F.col("_p") > 0) & (F.col("_p") < 0.2), (F.col("_p") > 0.04) & (F.col("_p") < 0.06)
    one = v.groupBy(*keys, F.round("_p", 2).alias("_v")).agg(F.count("*").alias("_c"), F.count_if(small).alias("_s"), F.count_if(small & near).alias("_t"))
    out = one.groupBy(*keys).agg(F.sum("_s").alias("total"), F.sum("_t").alias("p_near_005"), F.max(F.struct(F.col("_c"), -F.col("_v"))).alias("_b"))
    return out.where("total >= 5").select(
        *keys, "total", "p_near_005", (F.col("p_near_005") / F.col("total")).alias("ratio_005"), (-F.col("_b")["col2"]).alias("dominant_value"), (F.col("_b")["_c"] / F.col("total") > 0.5).alias("single_dominant")
    )


def paper_verdict(critical: Column, exact_zero: Column, dominant: Column, extreme: Column) -> Column:
    """FAKE from a score of 3, SUSPECT from 1, else CLEAN: 3 for each critical CV and each deviation below 0.001, 2 for a dominant p value and for an extreme effect."""
    score = critical * 3 + exact_zero * 3 + F.when(dominant, 2).otherwise(0) + F.when(extreme, 2).otherwise(0)
    return F.struct(score.alias("score"), F.when(score >= 3, "FAKE").when(score >= 1, "SUSPECT").otherwise("CLEAN").alias("verdict"))


def reported_against_recalculated(reported: Column, recalculated: Column) -> Column:
    """HIGH where a result was reported below 0.05 that recalculates above it."""
    return F.when((recalculated > 0.05) & (reported < 0.05), "HIGH")


def risk(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (severity) to RED (3 HIGH), ORANGE (1 HIGH or 5 MEDIUM), YELLOW (1 MEDIUM), else GREEN."""
    out = findings.groupBy(*keys).agg(F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("severity") == "MEDIUM").alias("medium"), F.count("*").alias("n"))
    h, m = F.col("high"), F.col("medium")
    return out.withColumn("risk", F.when(h >= 3, "RED").when((h >= 1) | (m >= 5), "ORANGE").when(m >= 1, "YELLOW").otherwise("GREEN"))


def cross_table_consistency(groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs of tables (table_id, group_name, mean, sd) that report one group: z of the difference, t with 3 a group, p with 4 degrees of freedom.

    HIGH for z > 3 and p < 0.01, MEDIUM for z > 2 and p < 0.05; two deviations of 0 give p = 1.
    """
    keys = keys or []
    on = [*keys, "group_name"]
    a = groups.select(*on, F.col("table_id").alias("table_a"), F.col("mean").alias("mean_a"), F.col("sd").alias("sd_a"))
    b = groups.select(*on, F.col("table_id").alias("table_b"), F.col("mean").alias("mean_b"), F.col("sd").alias("sd_b"))
    pairs = a.join(b, on).where("table_a < table_b")
    var = F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b")
    diff = F.abs(F.col("mean_a") - F.col("mean_b"))
    z, se = diff / F.greatest(F.sqrt(var / 2), F.lit(1e-10)), F.sqrt(var / 3)
    p = F.when(se > 0, num.t4_two_sided(diff / se)).otherwise(1.0)
    out = pairs.withColumn("z", z).withColumn("p", p)
    return out.withColumn("severity", F.when((F.col("z") > 3) & (F.col("p") < 0.01), "HIGH").when((F.col("z") > 2) & (F.col("p") < 0.05), "MEDIUM"))
