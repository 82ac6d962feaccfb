"""Queries of the readers and sinks, over files written from the driver's tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import relational as rel
from ..functions.storage import new_path
from ..operators import columns, text
from ..sources import nested, readers, sinks
from . import findings as fi
from .catalog import query
from .tabular_queries import _V7, _mode
from .text_queries import _EDGES, TORTURED_SQL, named, papers, sql_text

SUPPLIER = ["s_suppkey", "s_nationkey", "s_acctbal"]


def _cells_sql(names: list[str], sheet: str = "''", source: str = "'supplier'", prefix: str = "", by: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {source} AS source, {sheet} AS sheet, {i} AS col_pos, '{prefix}{c}' AS col, row_number() OVER ({by} ORDER BY s_suppkey) - 1 AS idx, CAST({c} AS DOUBLE) AS value FROM supplier"
        for i, c in enumerate(names)
    )


def _write_csv(read, path: str) -> str:
    read("supplier").select(*SUPPLIER).coalesce(1).sortWithinPartitions("s_suppkey").write.csv(f"{path}/supplier.csv", header=True)
    return f"{path}/supplier.csv"


def _write_json(read, path: str) -> str:
    """One document: a list of objects."""
    rows = F.sort_array(F.collect_list(F.struct(*SUPPLIER)))
    read("supplier").agg(F.to_json(rows).alias("value")).coalesce(1).write.text(f"{path}/supplier.json")
    return f"{path}/supplier.json"


@query("read_csv", _cells_sql(SUPPLIER))
def _(read):
    spark = read("supplier").sparkSession
    return readers.table_cells(spark, _write_csv(read, new_path(spark, "csv")))


@query("read_json", _cells_sql(sorted(SUPPLIER)))
def _(read):
    spark = read("supplier").sparkSession
    return readers.table_cells(spark, _write_json(read, new_path(spark, "json")))


@query("read_columnar", _cells_sql(SUPPLIER))
def _(read):
    spark = read("supplier").sparkSession
    path = f"{new_path(spark, 'columnar')}/supplier.parquet"
    read("supplier").select(*SUPPLIER).write.parquet(path)
    return readers.table_cells(spark, path, order=["s_suppkey"])


@query("read_several", f"SELECT * FROM ({_cells_sql(SUPPLIER)}) UNION ALL SELECT * FROM ({_cells_sql(sorted(SUPPLIER))})")
def _(read):
    spark = read("supplier").sparkSession
    path = new_path(spark, "several")
    return readers.tables_cells(spark, [_write_csv(read, path), _write_json(read, path)])


@query(
    "read_xlsx",
    "SELECT source, sheet, col_pos, col, idx, value FROM (SELECT *, count(*) OVER (PARTITION BY source, col_pos) AS n FROM ("
    + _cells_sql(SUPPLIER, "'S 1'", "'n' || s_nationkey", "S 1/", "PARTITION BY s_nationkey")
    + ")) WHERE n >= 3",
)
def _(read):
    def book(rows):
        import pandas as pd

        rows = rows.sort_values("s_suppkey")
        body = [[int(a), int(b), float(c)] for a, b, c in zip(rows["s_suppkey"], rows["s_nationkey"], rows["s_acctbal"], strict=True)]
        return pd.DataFrame({"path": [f"/x/n{rows['s_nationkey'].iloc[0]}.xlsx"], "content": [sinks.workbook({"S 1": [SUPPLIER, *body], "notes": [["none"]]})]})

    return readers.workbook_cells(read("supplier").select(*SUPPLIER).groupBy("s_nationkey").applyInPandas(book, "path string, content binary"))


@query("read_texts", "SELECT r_regionkey AS key, r_name || chr(10) AS text FROM region")
def _(read):
    spark = read("region").sparkSession
    path = new_path(spark, "texts")
    read("region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    return readers.text_documents(spark, path).select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("key"), "text")


@query("email_database", _EDGES + " SELECT * FROM edges")
def _(read):
    from ..operators import crossdoc

    spark = read("documents").sparkSession
    edges = crossdoc.emails(named(read)).groupBy("paper").agg(F.array_sort(F.collect_list("email")).alias("emails"))
    inner = F.map_from_entries(F.collect_list(F.struct("paper", F.struct("emails"))))
    path = new_path(spark, "emails")
    edges.agg(F.to_json(F.struct(inner.alias("papers"))).alias("value")).coalesce(1).write.text(path)
    return readers.email_database(spark, path)


_HTML = (
    (-1, "https://j.org/a/b.html?q", '<a href="/d/t.CSV">data</a><A class="x" href="s.html">Supplementary <b>Data</b></a><a href="old.xls">x</a>'),
    (-2, "https://j.org/c", '<a href="https://o.org/z.xlsx">z</a> <a href="//cdn.org/y.csv">y</a><a href="q.html">Source\n data</a>'),
    (-3, "https://j.org/e/f", "<p>no links</p>"),
)


@query(
    "supplementary_links",
    "WITH p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(u)}, {sql_text(h)})" for i, u, h in _HTML) + ") v(page_id, url, html)), "
    "t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)(<a[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)', 1)) AS a FROM p), "
    "h AS (SELECT page_id, url, regexp_extract(a, '(?i)href=\"([^\"]*)\"', 1) AS href, lower(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM t), "
    "l AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-zA-Z]+:') || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-zA-Z]+://[^/]*') || href "
    "ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/]*(?:/[^?#]*/)?'), '([^/])$', '\\1/') || href END AS link FROM h WHERE contains(body, 'source data') OR contains(body, 'supplementary data') OR contains(body, 'supplementary information') OR regexp_matches(lower(href), '\\.(xlsx|csv)$')) "
    "SELECT * FROM l UNION ALL SELECT page_id, url AS link FROM p WHERE page_id NOT IN (SELECT page_id FROM l)",
)
def _(read):
    made = read("pages").sparkSession.createDataFrame(list(_HTML), "page_id long, url string, html string")
    return readers.supplementary_links(read("pages").select("page_id", "url", "html").unionByName(made))


@query("distinct_studies", "SELECT condition, position, id FROM (SELECT o_orderpriority AS condition, o_orderkey AS position, o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(read):
    return readers.distinct_studies(read("orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("id")))


@query(
    "trial_metadata",
    "SELECT 'P' || p_partkey AS nct, p_name AS title, p_type AS status, CASE WHEN p_size > 10 THEN '2024-01' END AS start, p_brand AS sponsor, 'INTERVENTIONAL' AS study_type, p_brand || '|' || p_type AS phases, CAST(p_size AS BIGINT) AS enrollment, p_name AS conditions, p_size % 2 = 0 AS has_results FROM part",
)
def _(read):
    s = F.struct
    one = s(
        s(
            s(F.concat(F.lit("P"), "p_partkey").alias("nctId"), F.col("p_name").alias("briefTitle")).alias("identificationModule"),
            s(F.col("p_type").alias("overallStatus"), F.when(F.col("p_size") > 10, s(F.lit("2024-01").alias("date"))).alias("startDateStruct")).alias("statusModule"),
            s(s(F.col("p_brand").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
            s(F.lit("INTERVENTIONAL").alias("studyType"), F.array("p_brand", "p_type").alias("phases"), s(F.col("p_size").alias("count")).alias("enrollmentInfo")).alias("designModule"),
            s(F.array("p_name").alias("conditions")).alias("conditionsModule"),
        ).alias("protocolSection"),
        (F.col("p_size") % 2 == 0).alias("hasResults"),
    )
    return nested.trial_metadata(read("part").select(F.to_json(one).alias("value")))


@query(
    "trial_flatten_all",
    "SELECT 'N' || s_nationkey AS nct, 'Balance' AS outcome, 'P' AS type, 'MEAN' AS param_type, s_name AS \"group\", 'all' AS category, s_acctbal AS value, '' AS spread, 'usd' AS units, 'measurement' AS source FROM supplier "
    "UNION ALL SELECT 'N' || s_nationkey, 'Balance', 'P', 'p_value', '', '', count(*) / 50.0, '', '', 'analysis' FROM supplier GROUP BY s_nationkey "
    "UNION ALL SELECT 'N' || s_nationkey, 'Balance', 'P', 'COUNT', s_name, 'suppliers', CAST(s_suppkey AS DOUBLE), '', 'suppliers', 'denominator' FROM supplier",
)
def _(read):
    """A trial for each nation, its suppliers as groups."""
    s, text_of, all_of = F.struct, lambda c: F.col(c).cast("string"), lambda x: F.collect_list(F.struct(*x))
    group = F.concat(F.lit("G"), "s_suppkey")
    one = read("supplier").groupBy("s_nationkey").agg(
        all_of([group.alias("id"), F.col("s_name").alias("title")]).alias("groups"),
        all_of([group.alias("groupId"), text_of("s_acctbal").alias("value"), F.lit("").alias("spread")]).alias("measurements"),
        all_of([group.alias("groupId"), text_of("s_suppkey").alias("value")]).alias("counts"),
        (F.count("*") / 50).cast("string").alias("pValue"),
    )
    outcome = s(
        F.lit("Balance").alias("title"), F.lit("P").alias("type"), F.lit("MEAN").alias("paramType"), F.lit("usd").alias("unit"), "groups",
        F.array(s(F.array(s(F.lit("all").alias("title"), "measurements")).alias("categories"))).alias("classes"), F.array(s("pValue")).alias("analyses"), F.array(s(F.lit("suppliers").alias("units"), "counts")).alias("denoms"),
    )
    made = one.select(F.to_json(s(F.concat(F.lit("N"), "s_nationkey").alias("id"), F.array(outcome).alias("outcomes"))).alias("value"))
    return nested.flatten_trials(nested.parse_trials(made))


@query("checkpointed_sink", "SELECT o_orderkey, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) GROUP BY o_orderkey")
def _(read):
    """Finished orders first, as if the run broke off there, then all of them."""
    rows = read("orders").select("o_orderkey", "o_custkey").distinct()
    path = new_path(rows.sparkSession, "checkpointed")
    done = read("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").distinct()
    sinks.write_checkpointed(done, path, ["o_orderkey", "o_custkey"])
    sinks.write_checkpointed(rows, path, ["o_orderkey", "o_custkey"])
    return rows.sparkSession.read.parquet(path).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("json_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(read):
    spark = read("nation").sparkSession
    path = new_path(spark, "json-sink")
    sinks.write_json(read("nation"), path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("id_sink", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders")
def _(read):
    spark = read("orders").sparkSession
    path = new_path(spark, "ids")
    sinks.write_ids(read("orders"), "o_custkey", path)
    return spark.read.text(path)


_GRADE = "CASE WHEN value > 90 THEN 'HIGH' WHEN value > 50 THEN 'MEDIUM' ELSE 'LOW' END"


@query("findings_summary", f"SELECT event_type AS detector, {_GRADE} AS severity, count(*) AS n FROM events GROUP BY ALL")
def _(read):
    return fi.summary(read("events").select(F.col("event_type").alias("detector"), F.expr(_GRADE).alias("severity")))


@query("source_risk", f"SELECT 'u' || user_id AS source, count(*) AS n, 0::BIGINT AS critical, count(*) FILTER (WHERE value > 90) AS high, count(*) FILTER (WHERE value > 50 AND value <= 90) AS medium, CASE WHEN count(*) FILTER (WHERE value > 90) >= 3 THEN 'RED' WHEN count(*) FILTER (WHERE value > 90) >= 1 OR count(*) FILTER (WHERE value > 50 AND value <= 90) >= 5 THEN 'ORANGE' ELSE 'YELLOW' END AS grade FROM events GROUP BY user_id")
def _(read):
    return fi.source_risk(read("events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.expr(_GRADE).alias("severity")))


_STEPS = "CASE WHEN s_suppkey % 20 < 19 THEN s_suppkey * 2.5 ELSE s_acctbal END"
_MADE = f"WITH cells AS (SELECT 'n' || s_suppkey % 4 AS source, 'value' AS col, CAST({_STEPS} AS DOUBLE) AS value, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1 AS idx FROM supplier)"


@query(
    "v7_scan",
    "WITH v AS (" + _MADE + _V7 + "), u AS (" + _MADE + ", " + _mode("cells", "source, col", "value") + " SELECT source, col FROM m_ WHERE r = 1 AND n >= 4 AND n_distinct >= 3 AND c <= 0.6 * n) SELECT v.* FROM v JOIN u USING (source, col) WHERE flagged",
)
def _(read):
    """Account numbers in steps, with balances among them."""
    rows = read("supplier").withColumn("value", F.expr(_STEPS).cast("double"))
    return columns.scan_sequences(rel.cells(rows, ["value"], F.concat(F.lit("n"), F.col("s_suppkey") % 4), ["s_suppkey"]))


@query("tortured_risk", TORTURED_SQL + " SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE confidence = 'high') AS n_high, CASE WHEN count(*) FILTER (WHERE confidence = 'high') >= 5 THEN 'HIGH' WHEN count(*) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM kept GROUP BY doc_id")
def _(read):
    return text.tortured_risk(text.tortured_phrases(papers(read)))


@query("p_text", "SELECT p_partkey, CASE WHEN p <= 1e-300 THEN '≈ 0' WHEN p < 1e-18 THEN 'p < 10^-18' WHEN p < 1e-3 THEN printf('%.2e', p) ELSE printf('%.4f', p) END AS printed FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.0 WHEN 1 THEN p_size / 64.0 WHEN 2 THEN p_size * 1e-6 ELSE p_size * 1e-30 END AS p FROM part)")
def _(read):
    size = F.col("p_size")
    p = F.when(size % 4 == 0, 0.0).when(size % 4 == 1, size / 64.0).when(size % 4 == 2, size * 1e-6).otherwise(size * 1e-30)
    return read("part").select("p_partkey", num.p_text(p).alias("printed"))
