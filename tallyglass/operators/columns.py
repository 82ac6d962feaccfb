"""Single-column pattern detectors over the cell model.

Each returns measurements for every column, with a `flagged` column; findings are the flagged rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions.relational import chunked, mode, value_steps

KEYS = ["source", "col"]
#: Values that one task sorts at most, where neighbours in value order are looked for.
ROWS_A_RANGE = 1 << 22


def arithmetic_sequence(cells: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """One difference between neighbours in row order in 80 % of the places or more (3 at least), not 0; of 4 values or more.

    Neighbours are found within chunks of places, so that a long column isn't one task.
    """
    w = Window.partitionBy("source", "col_pos", "chunk").orderBy("idx")
    steps = chunked(cells, 1, chunk).select(*KEYS, "idx", "home", "chunk", F.round(F.lead("value").over(w) - F.col("value"), 10).alias("d")).where("d is not null and home = chunk")
    m = mode(steps, KEYS, "d", "idx")
    z = num.binomial_z(F.col("freq"), F.col("n"), 0.1)
    flagged = (F.col("n") >= 3) & (F.col("freq") >= 0.8 * F.col("n")) & (F.col("freq") >= 3) & (F.col("mode") != 0)
    return m.select(*KEYS, (F.col("n") + 1).alias("n"), F.col("mode").alias("step"), "freq", z.alias("z"), num.binomial_p(F.col("freq"), F.col("n"), 0.1).alias("p"), num.severity(z).alias("severity"), flagged.alias("flagged"))


def last_digits(cells: DataFrame) -> DataFrame:
    """Last significant digits: the share of 0 and 5 (over half: preference), and of the commonest one (80 % or more: all the same); of 5 values or more."""
    d = cells.select(*KEYS, num.last_digit(F.col("value")).alias("d")).where("d is not null")
    counts = d.groupBy(*KEYS, "d").count()
    five = F.sum(F.when(F.col("d").isin(0, 5), F.col("count")).otherwise(0))
    best = F.max(F.struct("count", -F.col("d")))
    out = counts.groupBy(*KEYS).agg(F.sum("count").alias("n"), five.alias("n_05"), best.alias("b"))
    z05, zsame = num.binomial_z(F.col("n_05"), F.col("n"), 0.2), num.binomial_z(F.col("b")["count"], F.col("n"), 0.1)
    return out.select(
        *KEYS, "n", "n_05", (-F.col("b")["col2"]).alias("digit"), F.col("b")["count"].alias("freq"), z05.alias("z_05"), zsame.alias("z_same"),
        ((F.col("n") >= 5) & (F.col("n_05") > 0.5 * F.col("n"))).alias("prefers_05"), ((F.col("n") >= 5) & (F.col("b")["count"] >= 0.8 * F.col("n"))).alias("all_same"),
    )


def decimal_precision(cells: DataFrame) -> DataFrame:
    """Values with one decimal more than most whose last digit is mostly the same: 70 % or more of 3 or more; of 5 values or more."""
    f = cells.select(*KEYS, num.fraction_digits(F.col("value")).alias("f"), "idx").withColumn("len", F.length("f"))
    by = f.groupBy(*KEYS, "len", F.right("f", F.lit(1)).alias("digit")).agg(F.count("*").alias("c"), F.min("idx").alias("first"))
    lengths = by.groupBy(*KEYS, "len").agg(F.sum("c").alias("c"), F.min("first").alias("first"))
    most = lengths.groupBy(*KEYS).agg(F.sum("c").alias("n"), F.max(F.struct("c", -F.coalesce("first", F.lit(0)), F.col("len"))).alias("b")).select(*KEYS, "n", F.col("b")["len"].alias("usual"))
    longer = by.join(most, KEYS).where(F.col("len") == F.col("usual") + 1)
    top = longer.groupBy(*KEYS, "n", "usual").agg(F.sum("c").alias("m"), F.max(F.struct("c", -F.coalesce("first", F.lit(0)), F.col("digit"))).alias("b"))
    freq, z = F.col("b")["c"], num.binomial_z(F.col("b")["c"], F.col("m"), 0.18)
    flagged = (F.col("n") >= 5) & (F.col("usual") > 0) & (F.col("m") >= 3) & (freq >= 3) & (freq >= 0.7 * F.col("m"))
    return top.select(*KEYS, "n", "usual", "m", F.col("b")["digit"].alias("digit"), freq.alias("freq"), z.alias("z"), flagged.alias("flagged"))


def decimal_prefix(cells: DataFrame, places: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Repeated first decimals: over 5 repeated groups, one of 3 or more, or over 15 % of the values in repeated groups; of 10 values and prefixes or more."""
    f = cells.select(*KEYS, num.fraction_digits(F.col("value")).alias("f"))
    p = f.select(*KEYS, F.explode(F.array(*map(F.lit, places))).alias("places"), "f").where(F.length("f") >= F.col("places"))
    by = p.groupBy(*KEYS, "places", F.substring(F.col("f"), F.lit(1), F.col("places")).alias("prefix")).agg(F.count("*").alias("c"))
    again = F.col("c") >= 2
    m = by.groupBy(*KEYS, "places").agg(
        F.sum("c").alias("m"), F.count_if(again).alias("groups"), F.max("c").alias("max_count"), F.sum(F.when(again, F.col("c")).otherwise(0)).alias("items")
    )
    flagged = (F.col("m") >= 10) & ((F.col("groups") > 5) | (F.col("max_count") >= 3) | (F.col("items") > 0.15 * F.col("m")))
    chance = F.pow(F.lit(0.1), F.col("places"))
    z = (F.col("items") - F.col("m") * chance) / F.sqrt(F.col("m") * chance * (1 - chance))
    return m.select(*KEYS, "places", "m", "groups", "max_count", "items", z.alias("z"), flagged.alias("flagged"))


def arithmetic_grid(cells: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Distinct values that lie on a grid: one gap in half or more of over 10 distinct values that are over half of all, and not a usual step."""
    n = cells.groupBy("source", "col_pos", *KEYS[1:]).count()
    u = cells.select("source", "col_pos", "col", "value").distinct()
    m = mode(value_steps(u, ["source", "col_pos", "col"], rows_a_range), KEYS, "step", "place")
    out = m.join(n.select(*KEYS, F.col("count").alias("n_values")), KEYS).withColumn("u", F.col("n") + 1)
    usual = F.col("mode").isin(0.1, 0.5, 1.0, 0.01, 0.05)
    flagged = (
        (F.col("n_values") >= 5) & (F.col("u") > 10) & (F.col("freq") >= F.greatest(F.lit(3.0), 0.5 * F.col("u"))) & (F.col("mode") > 0) & (F.col("u") / F.col("n_values") > 0.5) & ~usual
    )
    z = num.binomial_z(F.col("freq"), F.col("n"), 0.1)
    return out.select(*KEYS, "n_values", F.col("u").alias("n_distinct"), F.col("mode").alias("gap"), "freq", z.alias("z"), flagged.alias("flagged"))


def quality_filter(cells: DataFrame) -> DataFrame:
    """Whether a column can be judged: 4 values, 3 distinct ones, none over 60 %."""
    m = mode(cells.withColumn("v", F.col("value")), KEYS, "v", "idx")
    return m.select(*KEYS, "n", "n_distinct", F.col("mode").alias("commonest"), "freq", ((F.col("n") >= 4) & (F.col("n_distinct") >= 3) & (F.col("freq") <= 0.6 * F.col("n"))).alias("usable"))


def value_sequence(cells: DataFrame, min_pairs: int = 3, p_threshold: float = 0.01, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """One difference between neighbours in value order, by its chance among the u different ones: (1 / (u - 1)) ** (m - 1) * C(n, m + 1).

    A perfect progression (u = 1) isn't flagged here; arithmetic_sequence has it.
    """
    steps = value_steps(cells.select("source", "col_pos", "col", "value"), ["source", "col_pos", "col"], rows_a_range)
    m = mode(steps, KEYS, "step", "place").select(*KEYS, (F.col("n") + 1).alias("n"), F.col("n_distinct").alias("u"), F.col("mode").alias("step"), F.col("freq").alias("m"))
    k = F.least(F.col("m") + 1, F.col("n") - F.col("m") - 1)
    log_choose = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.ln((F.col("n") - k + i) / i))
    log_p = log_choose - (F.col("m") - 1) * F.ln((F.col("u") - 1).cast("double"))
    p = F.when(F.col("u") <= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_p)))
    flagged = (F.col("m") >= min_pairs) & ((F.col("m") + 1) / F.col("n") >= 0.5) & (F.col("u") > 1) & (p < p_threshold)
    return m.select(*KEYS, "n", "u", "step", "m", p.alias("p"), flagged.alias("flagged"))


def scan_sequences(cells: DataFrame, **options) -> DataFrame:
    """The flagged columns of value_sequence among those that pass quality_filter, least probable first."""
    usable = quality_filter(cells).where("usable").select(*KEYS)
    return value_sequence(cells, **options).where("flagged").join(usable, KEYS, "left_semi").orderBy("p", *KEYS)
