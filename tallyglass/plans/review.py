"""The review of papers: all text detectors over (doc_id, text) as findings of one schema, and the verdict of each paper.

No detector reads another's findings, so a review is a union of independent plans over one scan of the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import crossdoc, series, stats, text
from .findings import SCHEMA


def _finding(rows: DataFrame, detector: Column | str, severity: Column, description: Column, subject: list[str] | None = None, **metrics: Column) -> DataFrame:
    name = F.lit(detector) if isinstance(detector, str) else detector
    numbers = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]) if metrics else F.create_map().cast("map<string,double>")
    return rows.select(
        F.col("doc_id").cast("string").alias("source"), name.alias("detector"), severity.alias("severity"),
        (F.array(*[F.col(c).cast("string") for c in subject]) if subject else F.array().cast("array<string>")).alias("subject"),
        F.map_filter(numbers, lambda k, v: v.isNotNull()).alias("metrics"), F.lit(None).cast("double").alias("p"), description.alias("description"),
    ).where("severity is not null")


def review(docs: DataFrame) -> DataFrame:
    """Findings of every text detector; INFO rows are statements to check, not suspicions."""
    c = F.col
    premises, pvalues = text.premises(docs), text.p_value_format(docs)
    declared = text.declarations(docs).where("kind like 'method%'").join(premises.select("doc_id", "data_type"), "doc_id")
    tables = text.table_groups(docs).select("doc_id", "table_id", "group_name", "mean", "sd")
    points = text.table_series(docs).withColumn("label", F.concat_ws("\n", c("doc_id").cast("string"), "label"))
    regular = series.series_measures(points).withColumn("doc_id", F.substring_index("label", "\n", 1)).withColumn("label", F.substring_index("label", "\n", -1))
    papers = docs.select(c("doc_id").alias("paper"), "text")
    edges = crossdoc.emails(papers)
    mails = lambda df: df.withColumnRenamed("paper", "doc_id")
    level = lambda col: F.when(c(col) != "CLEAN", c(col))
    parts = [
        _finding(text.decimal_tails(docs), "DECIMAL_TAILS", level("signal"), F.concat(F.lit("commonest tail "), "tail"), ["tail"], total=c("total"), freq=c("freq")),
        _finding(text.duplicate_numbers(docs), "DUPLICATE_NUMBERS", level("signal"), F.lit("numbers repeat"), None, n=c("n"), repeated=c("repeated")),
        _finding(pvalues, "P_VALUE_FORMAT", F.when(c("level") == "L2", "MEDIUM").when(c("level") == "L1", "LOW"), F.lit("p values as printed by default or as thresholds only"), None, exact_zero=c("exact_zero"), below_zero=c("below_zero"), thresholds=c("thresholds")),
        _finding(text.tortured_phrases(docs), "TORTURED_PHRASE", F.upper("confidence"), F.concat_ws(" ", "abnormal", F.lit("for"), "usual"), ["abnormal"], start=c("start")),
        _finding(text.conclusions(docs), F.upper(F.concat(F.lit("CONCLUSION_"), c("kind"))), c("severity"), F.substring("text", 1, 100)),
        _finding(premises, "MISSING_NORMALITY_CHECK", c("normality"), F.lit("t test without a test of normality")),
        _finding(premises, "MISSING_HOMOSCEDASTICITY_CHECK", c("homoscedasticity"), F.lit("analysis of variance without a test of equal variances")),
        _finding(premises, "TOO_FEW_FOR_T_TEST", c("too_few"), F.lit("groups of fewer than 3")),
        _finding(premises, "SMALL_GROUPS", F.when(c("small_n").isNotNull(), "MEDIUM"), F.lit("groups of fewer than 5"), None, n=c("small_n")),
        _finding(text.method_suitability(declared.select("doc_id", "line", "data_type", "method")), "UNSUITABLE_METHOD", c("severity"), F.concat_ws(" ", "method", F.lit("for"), "data_type"), ["method"], line=c("line")),
        _finding(stats.cross_table_consistency(tables, ["doc_id"]), "CROSS_TABLE", c("severity"), F.concat_ws(" ", "group_name", F.lit("in"), "table_a", F.lit("and"), "table_b"), ["group_name"], z=c("z")),
        _finding(regular, "SERIES_MONOTONIC", F.when(c("monotonic"), "MEDIUM"), c("label"), ["label"]),
        _finding(regular, "SERIES_SPACING", c("spacing"), c("label"), ["label"], cv=c("spacing_cv")),
        _finding(regular, "SERIES_GROWTH", F.when(c("constant_growth"), "HIGH"), c("label"), ["label"], cv=c("growth_cv")),
        _finding(regular, "SERIES_SECOND_DIFFERENCE", F.when(c("constant_second"), "HIGH"), c("label"), ["label"], cv=c("second_cv")),
        _finding(regular, "SERIES_FIT", F.when(c("overfit_linear") | c("overfit_exponential"), "MEDIUM"), c("label"), ["label"], r2=c("r2_linear")),
        _finding(mails(crossdoc.patterned_names(edges)), "PATTERNED_NAMING", c("signal"), F.lit("addresses of a name and a number"), None, n=c("n_patterned")),
        _finding(mails(crossdoc.cross_paper_signals(edges)), "CROSS_PAPER_EMAIL", F.lit("MEDIUM"), c("email"), ["email"], n=c("n_papers")),
        _finding(mails(crossdoc.domain_profile(crossdoc.emails(papers, distinct=False))), "EMAIL_DOMAINS", level("signal"), F.lit("addresses outside institutions"), None, suspicious=c("suspicious"), total=c("total")),
        _finding(mails(crossdoc.institution_rules(papers)), "INSTITUTION", F.when(c("mismatch"), "HIGH").when(c("institutions") != "", "MEDIUM"), c("institutions")),
        _finding(mails(crossdoc.without_doi(papers)), "NO_DOI", c("signal"), F.lit("no DOI")),
    ]
    assert parts[0].columns == [f.split()[0] for f in SCHEMA.split(", ")]
    return reduce(DataFrame.unionByName, parts)


def verdicts(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(source, data_type, n, high, medium, risk, layer1..layer5) of every paper, also those without findings."""
    risk = stats.risk(findings.where("severity <> 'INFO'"), ["source"])
    kinds = text.data_type(docs).select(F.col("doc_id").cast("string").alias("source"), "data_type", *[f"layer{i}" for i in range(1, 6)])
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return kinds.join(risk, "source", "left").select("source", "data_type", zero("n"), zero("high"), zero("medium"), F.coalesce("risk", F.lit("GREEN")).alias("risk"), *[f"layer{i}" for i in range(1, 6)])
