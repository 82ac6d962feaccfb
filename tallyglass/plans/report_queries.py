"""Queries of the detector registry, the simulation, sources and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import simulation
from ..sources import nested
from . import findings as fi
from .catalog import query
from .tabular_queries import LINE, line_rows
from .text_queries import sql_text

TRIALS = 1000


@query("all_findings")
def _(read):
    found = fi.detect_tables(line_rows(read), LINE)
    return found.select("source", "detector", "severity", F.array_join("subject", ",").alias("subject"), "p", "description")


@query("findings_risk")
def _(read):
    return fi.source_risk(fi.detect_tables(line_rows(read), LINE))


@query("findings_report")
def _(read):
    return fi.markdown(fi.detect_tables(line_rows(read), LINE))


@query("monte_carlo_fpr")
def _(read):
    wide = simulation.trial_rows(read("region").sparkSession, TRIALS)
    names = [c for c in wide.columns if c not in ("source", "idx")]
    return simulation.false_positive_rates(fi.detect_tables(wide, names), TRIALS)


def _drawn(name: str, mean: float, sd: float, low: float, high: float) -> str:
    """The SQL of simulation.trial_rows' value."""
    part = lambda k: f"((('0x' || substr(md5('7:{name}:' || id), {k}, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)"
    return f"round(least(greatest(sqrt(-2 * ln({part(1)})) * cos(2 * pi() * {part(9)}) * {sd} + {mean}, {low}), {high}), {2 if sd < 0.5 else 1}) AS {name}"


@query(
    "trial_table",
    "SELECT 'trial' || (id // 60) AS source, id % 60 AS idx, " + ", ".join(_drawn(f"G{g}_V{v + 1}", *simulation.VARIABLES[v][1:]) for g in range(1, 5) for v in range(8)) + f" FROM (SELECT unnest(range(0, {TRIALS * 60})) AS id)",
)
def _(read):
    return simulation.trial_rows(read("region").sparkSession, TRIALS)


_EVENT_FINDINGS = "SELECT 'u' || user_id AS source, event_type AS detector, CASE WHEN value > 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'value ' || event_id AS description, value / 1000 AS p FROM events WHERE value > 50"


def event_findings(read):
    """Findings made of large events, in the columns that reports read."""
    e = read("events").where("value > 50")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("detector"), F.when(F.col("value") > 90, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.array(F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("subject"), (F.col("value") / 1000).alias("p"), F.concat(F.lit("value "), "event_id").alias("description"),
    )


@query("false_positive_rates", f"SELECT detector, count(*) AS findings, count(DISTINCT source) AS trials_hit, round(count(*) / 150.0, 6) AS rate, round(count(DISTINCT source) / 150.0, 6) AS trial_rate FROM ({_EVENT_FINDINGS}) GROUP BY detector")
def _(read):
    return simulation.false_positive_rates(event_findings(read), 150)


@query(
    "report_markdown",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, detector, lpad(substr(description, 7), 12, '0')) AS r FROM ({_EVENT_FINDINGS})) "
    "SELECT source, '## ' || source || chr(10) || chr(10) || string_agg('- **' || severity || '** ' || description, chr(10) ORDER BY r) || chr(10) AS report FROM r WHERE r <= 10 GROUP BY source",
)
def _(read):
    return fi.markdown(event_findings(read))


_LINKS = "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT DISTINCT page_id, href, regexp_matches(lower(href), '\\.(xlsx|xls|csv)$') AS is_data FROM l"


@query("page_links", _LINKS)
def _(read):
    return nested.page_links(read("pages"))


TRIALS_JSON = '{"id":"N1","outcomes":[{"title":"O1","type":"P","paramType":"MEAN","unit":"kg","groups":[{"id":"G1","title":"A"},{"id":"G2","title":"B"}],"classes":[{"categories":[{"title":"c","measurements":[{"groupId":"G1","value":"1.5","spread":"0.5"},{"groupId":"G2","value":"x","spread":""}]}]}],"analyses":[{"pValue":"0.03","statisticalMethod":"t","paramValue":"2","ciLower":null}],"denoms":[{"units":"P","counts":[{"groupId":"G1","value":"10"},{"groupId":"G2","value":null}]}]}]}'


@query(
    "trial_flatten",
    "SELECT * FROM (VALUES ('N1', 'O1', 'P', 'MEAN', 'A', 'c', 1.5, '0.5', 'kg', 'measurement'), ('N1', 'O1', 'P', 'MEAN', 'B', 'c', NULL, '', 'kg', 'measurement'), ('N1', 'O1', 'P', 'p_value', '', '', 0.03, '', '', 'analysis'), ('N1', 'O1', 'P', 'param_value', '', '', 2.0, '', '', 'analysis'), ('N1', 'O1', 'P', 'COUNT', 'A', 'P', 10.0, '', 'P', 'denominator')) v(nct, outcome, type, param_type, \"group\", category, value, spread, units, source)",
)
def _(read):
    spark = read("region").sparkSession
    return nested.flatten_trials(nested.parse_trials(spark.createDataFrame([(TRIALS_JSON,)], "value string")))


@query("trial_stats", "WITH v(source, param_type, value) AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END FROM lineitem) SELECT source, param_type, count(*) AS n, count(value) AS n_values FROM v GROUP BY ALL")
def _(read):
    rows = read("lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("param_type"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("value"))
    return nested.trial_stats(rows)


_CELLS = ["1.5", " 2 ", "50%", "1,234.5", "abc", "", "nan", "inf", "1e3", "5d", "1_000", "-.5", "+7", "0x10", "1e400"]


@query("parse_number", "SELECT * FROM (VALUES " + ", ".join(f"({sql_text(c)}, {v})" for c, v in zip(_CELLS, ["1.5", "2.0", "50.0", "1234.5", "NULL", "NULL", "NULL", "NULL", "1000.0", "NULL", "NULL", "-0.5", "7.0", "NULL", "NULL"], strict=True)) + ") v(cell, value)")
def _(read):
    from ..functions.numeric import parse_number

    return read("region").sparkSession.createDataFrame([(c,) for c in _CELLS], "cell string").select("cell", parse_number(F.col("cell")).cast("double").alias("value"))


@query("numeric_density", "SELECT source, round(avg(CASE WHEN doc_id % 3 = 0 OR n_chars > 3000 THEN 1.0 ELSE 0.0 END), 6) AS density, avg(CASE WHEN doc_id % 3 = 0 OR n_chars > 3000 THEN 1.0 ELSE 0.0 END) > 0.3 AS keep FROM documents GROUP BY source")
def _(read):
    cell = F.when((F.col("doc_id") % 3 == 0) | (F.col("n_chars") > 3000), F.col("n_chars").cast("string")).otherwise(F.lit("text"))
    return nested.numeric_density(read("documents").select("source", cell.alias("cell")), ["source"])
