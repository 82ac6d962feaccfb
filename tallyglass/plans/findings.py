"""One findings schema, the detector registry, roll-ups and report text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions.relational import column_pairs, wide_pairs
from ..functions.storage import written
from ..operators import columns, pairs, rows

SCHEMA = "source string, detector string, severity string, subject array<string>, metrics map<string,double>, p double, description string"

#: Detectors of one column, of column pairs and of rows: name -> (function of the measurements, subject columns, flag).
COLUMN_DETECTORS = {
    "ARITHMETIC_SEQUENCE": (columns.arithmetic_sequence, "flagged"),
    "DIGIT_PREFERENCE": (columns.last_digits, "prefers_05"),
    "ALL_SAME_LAST_DIGIT": (columns.last_digits, "all_same"),
    "DECIMAL_PRECISION_ANOMALY": (columns.decimal_precision, "flagged"),
    "DECIMAL_PREFIX_REPEAT": (columns.decimal_prefix, "flagged"),
    "ARITHMETIC_GRID": (columns.arithmetic_grid, "flagged"),
    "VALUE_SEQUENCE": (columns.value_sequence, "flagged"),
}
PAIR_DETECTORS = {
    "FIXED_DIFFERENCE": (pairs.fixed_difference, "flagged"),
    "FIXED_RATIO": (pairs.fixed_ratio, "flagged"),
    "LINEAR_RELATION": (pairs.linear_relation, "flagged"),
    "NOISE_CORRELATION": (pairs.noise_correlation, "flagged"),
    "BYTE_IDENTICAL_COLUMNS": (pairs.identical_columns, "identical"),
    "BYTE_IDENTICAL_NEAR_COLUMNS": (pairs.identical_columns, "near_identical"),
    "CONSTANT_SHIFT": (pairs.constant_shift, "flagged"),
    "CROSS_GROUP_ROW_DUPLICATION": (pairs.shared_prefix, "flagged"),
}
ROW_DETECTORS = {
    "BLOCK_DUPLICATION": (rows.block_duplication, "flagged"),
    "BYTE_IDENTICAL_ROWS": (rows.identical_rows, "flagged"),
    "BYTE_IDENTICAL_BLOCK": (rows.identical_blocks, "flagged"),
}
_Z = {"DIGIT_PREFERENCE": "z_05", "ALL_SAME_LAST_DIGIT": "z_same"}


def to_findings(measured: DataFrame, detector: str, flag: str = "flagged") -> DataFrame:
    """The flagged measurements in the findings schema: severity by the tail of z, or as measured, or HIGH."""
    names = dict(measured.dtypes)
    subject = [c for c in ("a", "b", "col", "label", "key") if c in names]
    numbers = [c for c, t in names.items() if t in ("double", "bigint", "int") and c != "p"]
    z = F.col(_Z.get(detector, "z")) if _Z.get(detector, "z") in names else None
    severity = F.col("severity") if "severity" in names else num.severity(z) if z is not None else F.lit("HIGH")
    p = F.col("p") if "p" in names else num.norm_sf(z) if z is not None else F.lit(0.0)
    metrics = F.map_filter(F.create_map(*[x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))]), lambda k, v: v.isNotNull())
    text = F.concat_ws(" ", F.lit(detector), F.array_join(F.array(*subject), " / ") if subject else F.lit(""), F.concat(F.lit("("), num.p_text(p), F.lit(")")))
    return measured.where(flag).select(
        F.col("source"), F.lit(detector).alias("detector"), severity.alias("severity"), (F.array(*subject) if subject else F.array().cast("array<string>")).alias("subject"),
        metrics.alias("metrics"), p.alias("p"), text.alias("description"),
    )


def detect_tables(wide: DataFrame, names: list[str], cells: DataFrame | None = None) -> DataFrame:
    """All tabular detectors over (source, idx, columns): one DataFrame of findings for all sources at once.

    The wide path builds cells and pairs from the rows without a join; give `cells` for columns with gaps, which then
    pair by self-join. The rows are written once, as every detector reads them.
    """
    wide = written(wide)
    long = cells
    if long is None:
        parts = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)])
        long = wide.select("source", "idx", F.inline(parts)).select("source", "col_pos", "col", "idx", "value").where("value is not null")
    out = [to_findings(f(long), name, flag) for name, (f, flag) in COLUMN_DETECTORS.items()]
    if len(names) >= 2:
        two = wide_pairs(wide, names, F.col("source"), F.col("idx")) if cells is None else column_pairs(cells)
        out += [to_findings(f(two), name, flag) for name, (f, flag) in PAIR_DETECTORS.items()]
        out += [to_findings(f(wide, names), name, flag) for name, (f, flag) in ROW_DETECTORS.items()]
    return reduce(DataFrame.unionByName, out)


def summary(findings: DataFrame) -> DataFrame:
    """(detector, severity, n)."""
    return findings.groupBy("detector", "severity").agg(F.count("*").alias("n"))


def source_risk(findings: DataFrame) -> DataFrame:
    """(source, n, critical, high, medium, grade): RED from one CRITICAL or three HIGH, ORANGE from one HIGH or five MEDIUM, YELLOW from one finding."""
    s = F.col("severity")
    out = findings.groupBy("source").agg(F.count("*").alias("n"), F.count_if(s == "CRITICAL").alias("critical"), F.count_if(s == "HIGH").alias("high"), F.count_if(s == "MEDIUM").alias("medium"))
    grade = F.when((F.col("critical") >= 1) | (F.col("high") >= 3), "RED").when((F.col("high") >= 1) | (F.col("medium") >= 5), "ORANGE").otherwise("YELLOW")
    return out.withColumn("grade", grade)


def markdown(findings: DataFrame, most: int = 10) -> DataFrame:
    """(source, report): a Markdown section for each source, its findings by probability; `most` is a report's limit."""
    order = Window.partitionBy("source").orderBy("p", "detector", F.array_join("subject", ","))
    ranked = findings.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    line = F.concat(F.lit("- **"), "severity", F.lit("** "), "description")
    lines = ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return lines.select("source", F.concat(F.lit("## "), "source", F.lit("\n\n"), body, F.lit("\n")).alias("report"))


def as_json(findings: DataFrame) -> DataFrame:
    """(value): one JSON document for each finding."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def detect_cells(cells: DataFrame) -> DataFrame:
    """Column and pair detectors over the cell model of any number of tables with gaps."""
    long = cells.select("source", "col_pos", "col", "idx", "value")
    two = column_pairs(long)
    out = [to_findings(f(long), name, flag) for name, (f, flag) in COLUMN_DETECTORS.items()]
    out += [to_findings(f(two), name, flag) for name, (f, flag) in PAIR_DETECTORS.items()]
    return reduce(DataFrame.unionByName, out)
