"""Sources with nested or marked-up content: trial registry JSON, HTML links, numeric density of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_number

_GROUP = "array<struct<id:string,title:string>>"
_COUNT = "array<struct<groupId:string,value:string>>"
_MEASURE = "array<struct<groupId:string,value:string,spread:string>>"
TRIAL = (
    f"id string, outcomes array<struct<title:string,type:string,paramType:string,unit:string,groups:{_GROUP},"
    f"classes:array<struct<categories:array<struct<title:string,measurements:{_MEASURE}>>>>,"
    "analyses:array<struct<pValue:string,statisticalMethod:string,paramValue:string,ciLower:string,ciUpper:string>>,"
    f"denoms:array<struct<units:string,counts:{_COUNT}>>>>"
)
#: Columns of an analysis that become rows.
ANALYSIS_FIELDS = (("p_value", "pValue"), ("param_value", "paramValue"), ("ci_lower", "ciLower"), ("ci_upper", "ciUpper"))


def parse_trials(lines: DataFrame) -> DataFrame:
    """Trials of (value): one JSON document a row."""
    return lines.select(F.from_json("value", TRIAL).alias("t")).select("t.*")


def flatten_trials(trials: DataFrame) -> DataFrame:
    """(nct, outcome, type, param_type, group, category, value, spread, units, source): measurements (null values too), analyses and denominators (values only). Titles are cut to 120, groups and categories to 50 characters."""
    o = trials.select(F.col("id").alias("nct"), F.explode("outcomes").alias("o")).select(
        "nct", F.substring("o.title", 1, 120).alias("outcome"), F.col("o.type").alias("type"), F.col("o.paramType").alias("param_type"), F.col("o.unit").alias("unit"),
        F.map_from_entries(F.transform(F.coalesce("o.groups", F.array().cast(_GROUP)), lambda g: F.struct(g["id"], F.substring(g["title"], 1, 50)))).alias("names"), "o.classes", "o.analyses", "o.denoms",
    )
    name = lambda g: F.coalesce(F.try_element_at("names", F.col(g)), F.col(g), F.lit(""))
    keep = ["nct", "outcome", "type"]
    measured = o.select("*", F.explode("classes").alias("c")).select("*", F.explode("c.categories").alias("k")).select("*", F.explode("k.measurements").alias("m"))
    measured = measured.select(
        *keep, "param_type", name("m.groupId").alias("group"), F.substring(F.coalesce("k.title", F.lit("")), 1, 50).alias("category"), parse_number(F.col("m.value")).alias("value"),
        F.coalesce("m.spread", F.lit("")).alias("spread"), F.coalesce("unit", F.lit("")).alias("units"), F.lit("measurement").alias("source"),
    )
    fields = F.array(*[F.struct(F.lit(n).alias("param_type"), F.col(f"a.{f}").alias("v")) for n, f in ANALYSIS_FIELDS])
    empty = lambda c: F.lit("").alias(c)
    analysed = o.select(*keep, F.explode("analyses").alias("a")).select(*keep, F.inline(fields)).select(
        *keep, "param_type", empty("group"), empty("category"), parse_number(F.col("v")).alias("value"), empty("spread"), empty("units"), F.lit("analysis").alias("source")
    ).where("value is not null")
    counted = o.select(*keep, "names", F.explode("denoms").alias("d")).select(*keep, "names", "d.units", F.explode("d.counts").alias("n")).select(
        *keep, F.lit("COUNT").alias("param_type"), name("n.groupId").alias("group"), F.coalesce("units", F.lit("")).alias("category"), parse_number(F.col("n.value")).alias("value"), empty("spread"), F.coalesce("units", F.lit("")).alias("units"), F.lit("denominator").alias("source")
    ).where("value is not null")
    return measured.unionByName(analysed).unionByName(counted)


STUDY = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:long>>,"
    "conditionsModule:struct<conditions:array<string>>>, hasResults boolean"
)


def trial_metadata(studies: DataFrame) -> DataFrame:
    """(nct, title, status, start, sponsor, study_type, phases, enrollment, conditions, has_results) of (value): one registry study's JSON a row."""
    p = studies.select(F.from_json("value", STUDY).alias("s")).select("s.protocolSection.*", "s.hasResults")
    return p.select(
        F.col("identificationModule.nctId").alias("nct"), F.col("identificationModule.briefTitle").alias("title"), F.col("statusModule.overallStatus").alias("status"),
        F.col("statusModule.startDateStruct.date").alias("start"), F.col("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"), F.col("designModule.studyType").alias("study_type"),
        F.array_join("designModule.phases", "|").alias("phases"), F.col("designModule.enrollmentInfo.count").alias("enrollment"), F.array_join("conditionsModule.conditions", "|").alias("conditions"), F.col("hasResults").alias("has_results"),
    )


def trial_stats(rows: DataFrame) -> DataFrame:
    """(source, param_type, n, n_values)."""
    return rows.groupBy("source", "param_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, is_data): the distinct links of each page, and whether they end in .xlsx, .xls or .csv."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    return links.withColumn("is_data", F.lower("href").rlike(r"\.(xlsx|xls|csv)$"))


def numeric_density(cells: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """(keys, density, keep): the share of cells (text) that are numbers, and whether it is above `least`."""
    share = F.avg(F.when(parse_number(F.col("cell")).isNotNull(), 1.0).otherwise(0.0))
    return cells.groupBy(*keys).agg(share.alias("density")).withColumn("keep", F.col("density") > least)
