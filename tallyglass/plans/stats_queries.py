"""Queries of the recalculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from .catalog import query
from .tabular_queries import sql_sf

_TYPES = list(stats.CV_LIMITS)


def flag_groups(read):
    """Mean, deviation and size of lineitem's columns by flag (the group) and status (the table)."""
    line = read("lineitem").select("l_returnflag", "l_linestatus", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])))
    return line.groupBy("measure", F.col("l_returnflag").alias("group_name"), F.col("l_linestatus").alias("table_id")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))


_FLAGS = "WITH l AS (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem) ON l_quantity, l_discount, l_tax, l_extendedprice INTO NAME measure VALUE v), g AS (SELECT measure, l_returnflag AS group_name, l_linestatus AS table_id, avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n FROM l GROUP BY ALL)"


def cv_groups(read):
    """Each customer's orders, and each part's constant price as a control without variation."""
    orders = read("orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), (F.col("o_custkey") % 8).cast("int").alias("t")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("sd"))
    types = F.array(*map(F.lit, _TYPES))
    return orders.select("key", "mean", "sd", F.get(types, F.col("t")).alias("data_type"))


_CV = (
    "WITH o AS (SELECT 'c' || o_custkey AS key, (o_custkey % 8)::INT AS t, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY ALL), "
    "lim(t, data_type, low, high, least_) AS (VALUES " + ", ".join(f"({i}, '{k}', {a}, {b}, {c})" for i, (k, (a, b, c)) in enumerate(stats.CV_LIMITS.items())) + "), "
    "q AS (SELECT key, mean, sd, data_type, low, least_, CASE WHEN mean > 0 AND sd >= 0 THEN abs(sd / mean) * 100 END AS cv FROM o JOIN lim USING (t)) "
)


@query(
    "cv_check",
    _CV + "SELECT key, round(mean, 6) AS mean, round(sd, 6) AS sd, data_type, round(cv, 6) AS cv, CASE WHEN cv IS NULL THEN NULL WHEN cv = 0 OR cv < least_ THEN 'CRITICAL' WHEN cv < 0.5 * low THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS verdict FROM q",
)
def _(read):
    return stats.cv_check(cv_groups(read))


def flag_pairs(read):
    g = flag_groups(read).where("table_id = 'F'")
    a = g.select("measure", F.col("group_name").alias("g1"), F.col("mean").alias("m1"), F.col("sd").alias("sd1"), F.col("n").alias("n1"))
    b = g.select("measure", F.col("group_name").alias("g2"), F.col("mean").alias("m2"), F.col("sd").alias("sd2"), F.col("n").alias("n2"))
    return a.join(b, "measure").where("g1 < g2")


_TPAIRS = _FLAGS + ", p AS (SELECT a.measure, a.group_name AS g1, b.group_name AS g2, a.mean AS m1, a.sd AS sd1, a.n AS n1, b.mean AS m2, b.sd AS sd2, b.n AS n2 FROM g a JOIN g b ON a.measure = b.measure AND a.group_name < b.group_name AND a.table_id = 'F' AND b.table_id = 'F'), "
_TPAIRS += "q AS (SELECT *, sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) AS sp, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM p), r AS (SELECT *, (m1 - m2) / (sp * sqrt(1 / n1 + 1 / n2)) AS t, abs(m1 - m2) / sp AS d FROM q)"


@query(
    "t_recalc",
    _TPAIRS + f", s AS (SELECT *, abs(t * (1 - 1 / (4 * df)) / sqrt(1 + t * t / (2 * df))) AS z FROM r) SELECT measure, g1, g2, round(t, 6) AS t, df, round(2 * ({sql_sf('z')}), 6) AS p, round(d, 6) AS cohens_d, "
    "CASE WHEN d < 0.2 THEN 'tiny' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' WHEN d < 2.0 THEN 'large' ELSE 'huge' END AS effect, d > 5.0 AS extreme FROM s",
)
def _(read):
    return stats.t_recalculation(flag_pairs(read)).select("measure", "g1", "g2", "t", "df", "p", "cohens_d", "effect", "extreme")


@query("t_exact", _TPAIRS + " SELECT measure, g1, g2, round(t, 6) AS t, df FROM r")
def _(read):
    return stats.t_exact(flag_pairs(read)).select("measure", "g1", "g2", "t", "df")


def _simpson(f: str, upper: str, steps: int = 20_000) -> str:
    """The integral of f(x) from 0 to upper."""
    return (
        f"(({upper}) / {3 * steps} * list_sum(list_transform(list_transform(range(0, {steps + 1}), lambda i: [i, i * ({upper}) / {steps}]), "
        f"lambda v: (CASE WHEN v[1] = 0 OR v[1] = {steps} THEN 1 WHEN v[1] % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('x_', 'v[2]')}))))"
    )


def sql_beta_inc(a: str, b: str, x: str) -> str:
    """The regularized incomplete beta function for a, b >= 1/2, by its trigonometric integral."""
    return f"(2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {_simpson(f'pow(sin(x_), 2 * ({a}) - 1) * pow(cos(x_), 2 * ({b}) - 1)', f'asin(sqrt({x}))')})"


def sql_gamma_sf(a: str, x: str) -> str:
    """The upper regularized incomplete gamma function for a >= 1/2."""
    return f"(1 - 2 / gamma({a}) * {_simpson(f'pow(x_, 2 * ({a}) - 1) * exp(-x_ * x_)', f'sqrt({x})')})"


@query("t_exact_p", _TPAIRS + f" SELECT measure, g1, g2, round(t, 6) AS t, df, round({sql_beta_inc('df / 2', '0.5', 'df / (df + t * t)')}, 6) AS p FROM r")
def _(read):
    return stats.t_exact(flag_pairs(read)).select("measure", "g1", "g2", "t", "df", "p")


_ANOVA = _FLAGS + ", s AS (SELECT measure, table_id, count(*) AS k, sum(n) AS nn, sum(mean * n) / sum(n) AS gm, sum((n - 1) * sd * sd) AS ssw, bool_or(n <= 3) AS small FROM g GROUP BY ALL), b AS (SELECT g.measure, g.table_id, sum(n * (mean - gm) * (mean - gm)) AS ssb FROM g JOIN s USING (measure, table_id) GROUP BY ALL), "
_ANOVA += "q AS (SELECT measure, table_id, k, nn, small, ssb, ssw, CASE WHEN ssw > 0 AND k > 1 THEN (ssb / nullif(k - 1, 0)) / (ssw / nullif(nn - k, 0)) ELSE 0.0 END AS f, CAST(k - 1 AS DOUBLE) AS d1, CAST(nn - k AS DOUBLE) AS d2 FROM s JOIN b USING (measure, table_id)) "


@query(
    "anova_recalc",
    _ANOVA + ", z AS (SELECT *, CASE WHEN f > 0 THEN abs(((1 - 2 / (9 * d2)) * cbrt(f) - (1 - 2 / (9 * d1))) / sqrt(2 / (9 * d2) * cbrt(f) * cbrt(f) + 2 / (9 * d1))) END AS z FROM q) "
    f"SELECT measure, table_id, k, nn::BIGINT AS n, round(f, 6) AS f, round(CASE WHEN f > 0 THEN 2 * ({sql_sf('z')}) ELSE 1.0 END, 6) AS p, round(ssb / (ssb + ssw), 6) AS eta_sq, small AS n_too_small FROM z",
)
def _(read):
    return stats.anova_recalculation(flag_groups(read), ["measure", "table_id"])


@query("anova_exact", _ANOVA.replace("ELSE 0.0 END AS f", "ELSE 0.0 END AS f") + "SELECT measure, table_id, k, nn::BIGINT AS n, round(f, 6) AS f FROM q WHERE k > 1")
def _(read):
    return stats.anova_exact(flag_groups(read), ["measure", "table_id"]).where("k > 1").drop("p")


@query("anova_exact_p", _ANOVA + f"SELECT measure, table_id, k, nn::BIGINT AS n, round(f, 6) AS f, round({sql_beta_inc('d2 / 2', 'd1 / 2', 'd2 / (d2 + d1 * f)')}, 6) AS p FROM q WHERE k > 1")
def _(read):
    return stats.anova_exact(flag_groups(read), ["measure", "table_id"]).where("k > 1")


def rates(read):
    """By supplier nation: late flags among cheap and among dear lines, as counts; as rates for every third nation."""
    s = read("supplier").select("s_suppkey", "s_nationkey")
    line = read("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    hit = F.col("l_returnflag") == "R"
    dear = F.col("l_quantity") > 25
    g = line.groupBy("s_nationkey").agg(F.count_if(hit & ~dear).alias("x1"), F.count_if(~dear).alias("n1"), F.count_if(hit & dear).alias("x2"), F.count_if(dear).alias("n2"))
    as_rate = lambda x, n: F.when(F.col("s_nationkey") % 3 == 0, F.col(x) / F.col(n)).otherwise(F.col(x).cast("double"))
    return g.select("s_nationkey", as_rate("x1", "n1").alias("x1"), "n1", as_rate("x2", "n2").alias("x2"), "n2")


@query(
    "chi2_recalc",
    "WITH j AS (SELECT s_nationkey, l_returnflag = 'R' AS hit, l_quantity > 25 AS dear FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), g AS (SELECT s_nationkey, count(*) FILTER (WHERE hit AND NOT dear)::DOUBLE AS a, count(*) FILTER (WHERE NOT dear) AS n1, count(*) FILTER (WHERE hit AND dear)::DOUBLE AS c, count(*) FILTER (WHERE dear) AS n2 FROM j GROUP BY 1), "
    "e AS (SELECT *, CASE WHEN s_nationkey % 3 = 0 THEN a / n1 ELSE a END AS x1, CASE WHEN s_nationkey % 3 = 0 THEN c / n2 ELSE c END AS x2, (n1 + n2)::DOUBLE AS n FROM g), f AS (SELECT *, least(n1 * (a + c) / n, n1 * (n - a - c) / n, n2 * (a + c) / n, n2 * (n - a - c) / n) AS min_expected FROM e), "
    "h AS (SELECT *, CASE WHEN min_expected >= 5 THEN n * pow(abs(a * (n2 - c) - (n1 - a) * c) - n / 2, 2) / (n1::DOUBLE * n2 * (a + c) * (n - a - c)) END AS chi2 FROM f), z AS (SELECT *, (cbrt(chi2) - (1 - 2 / 9.0)) / sqrt(2 / 9.0) AS z FROM h) "
    f"SELECT s_nationkey, round(x1, 6) AS x1, n1, round(x2, 6) AS x2, n2, round(min_expected, 6) AS min_expected, min_expected < 5 AS needs_fisher, round(chi2, 6) AS chi2, round(CASE WHEN chi2 <= 0 THEN 1.0 WHEN chi2 IS NOT NULL THEN {sql_sf('z')} END, 6) AS p FROM z",
)
def _(read):
    return stats.chi2_2x2(rates(read))


def priority_status(read):
    return read("orders").groupBy((F.col("o_custkey") % 5).alias("key"), "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


_CHI2 = (
    "WITH c AS (SELECT o_custkey % 5 AS key, o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT key, r, sum(n) AS rn FROM c GROUP BY ALL), k AS (SELECT key, c, sum(n) AS cn FROM c GROUP BY ALL), t AS (SELECT key, sum(n) AS n FROM c GROUP BY ALL), "
    "g AS (SELECT key, r.r, k.c, rn * cn / t.n AS e, coalesce(c.n, 0) AS o FROM r JOIN k USING (key) JOIN t USING (key) LEFT JOIN c USING (key, r, c)), "
    "x AS (SELECT key, sum((o - e) * (o - e) / e) AS chi2, ((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1))::DOUBLE AS df, min(e) AS least FROM g GROUP BY key) "
    "SELECT key, round(chi2, 6) AS chi2, df, round(least, 6) AS min_expected, least < 5 AS needs_fisher"
)


@query("chi2_table", _CHI2 + " FROM x")
def _(read):
    return stats.chi2_table(priority_status(read), ["key"], "o_orderpriority", "o_orderstatus", "n").drop("p")


@query("chi2_table_p", _CHI2 + f", round({sql_gamma_sf('df / 2', 'chi2 / 2')}, 6) AS p FROM x")
def _(read):
    return stats.chi2_table(priority_status(read), ["key"], "o_orderpriority", "o_orderstatus", "n")


@query(
    "p_distribution",
    "WITH v AS (SELECT l_suppkey AS key, l_discount * l_tax * 20 AS p FROM lineitem), o AS (SELECT key, round(p, 2) AS v, count(*) AS c, count(*) FILTER (WHERE p > 0 AND p < 0.2) AS s, count(*) FILTER (WHERE p > 0.04 AND p < 0.06) AS t FROM v GROUP BY ALL), "
    "r AS (SELECT key, sum(s) OVER w AS total, sum(t) OVER w AS near, v, c, row_number() OVER (PARTITION BY key ORDER BY c DESC, v) AS r FROM o WINDOW w AS (PARTITION BY key)) "
    "SELECT key, total::BIGINT AS total, near::BIGINT AS p_near_005, round(near / total, 6) AS ratio_005, round(v, 6) AS dominant_value, c / total > 0.5 AS single_dominant FROM r WHERE r = 1 AND total >= 5",
)
def _(read):
    return stats.p_distribution(read("lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_discount") * F.col("l_tax") * 20).alias("p")), ["key"])


@query(
    "paper_verdict",
    "WITH q AS (SELECT l_suppkey AS key, count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0 AND l_quantity = 50) AS critical, count(*) FILTER (WHERE l_discount = 0.1 AND l_tax = 0.08 AND l_quantity = 1) AS zero, avg(l_quantity) > 25.5 AS dominant, max(l_extendedprice) > 104000 AS extreme FROM lineitem GROUP BY 1), s AS (SELECT key, 3 * critical + 3 * zero + CASE WHEN dominant THEN 2 ELSE 0 END + CASE WHEN extreme THEN 2 ELSE 0 END AS score FROM q) "
    "SELECT key, score, CASE WHEN score >= 3 THEN 'FAKE' WHEN score >= 1 THEN 'SUSPECT' ELSE 'CLEAN' END AS verdict FROM s",
)
def _(read):
    g = read("lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(
        F.count_if((F.col("l_discount") == 0) & (F.col("l_tax") == 0) & (F.col("l_quantity") == 50)).alias("critical"),
        F.count_if((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08) & (F.col("l_quantity") == 1)).alias("zero"),
        (F.avg("l_quantity") > 25.5).alias("dominant"), (F.max("l_extendedprice") > 104000).alias("extreme"),
    )
    return g.select("key", stats.paper_verdict(F.col("critical"), F.col("zero"), F.col("dominant"), F.col("extreme")).alias("v")).select("key", "v.score", "v.verdict")


@query("reported_recalculated", _TPAIRS + f", s AS (SELECT *, abs(t * (1 - 1 / (4 * df)) / sqrt(1 + t * t / (2 * df))) AS z FROM r), u AS (SELECT measure, g1, g2, 0.01 AS reported, 2 * ({sql_sf('z')}) AS p FROM s) SELECT measure, g1, g2, reported, round(p, 6) AS p, CASE WHEN p > 0.05 AND reported < 0.05 THEN 'HIGH' END AS severity FROM u")
def _(read):
    t = stats.t_recalculation(flag_pairs(read)).select("measure", "g1", "g2", F.lit(0.01).alias("reported"), "p")
    return t.withColumn("severity", stats.reported_against_recalculated(F.col("reported"), F.col("p")))


_T4 = "2 * (1 - (0.5 + 0.375 * t / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))))"


@query(
    "cross_table_consistency",
    _FLAGS.replace("stddev_samp(v) AS sd", "stddev_samp(v) / sqrt(count(*)) AS sd")
    + ", p AS (SELECT a.measure, a.group_name, a.table_id AS table_a, b.table_id AS table_b, a.mean AS mean_a, a.sd AS sd_a, b.mean AS mean_b, b.sd AS sd_b, a.sd * a.sd + b.sd * b.sd AS var FROM g a JOIN g b ON a.measure = b.measure AND a.group_name = b.group_name AND a.table_id < b.table_id), "
    "q AS (SELECT *, abs(mean_a - mean_b) / greatest(sqrt(var / 2), 1e-10) AS z, abs(mean_a - mean_b) / sqrt(var / 3) AS t FROM p), "
    f"r AS (SELECT *, CASE WHEN var > 0 THEN {_T4} ELSE 1.0 END AS p FROM q) SELECT measure, group_name, table_a, table_b, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN z > 3 AND p < 0.01 THEN 'HIGH' WHEN z > 2 AND p < 0.05 THEN 'MEDIUM' END AS severity FROM r",
)
def _(read):
    groups = flag_groups(read).withColumn("sd", F.col("sd") / F.sqrt("n"))
    return stats.cross_table_consistency(groups, ["measure"]).select("measure", "group_name", "table_a", "table_b", "z", "p", "severity")


@query(
    "audit_risk",
    "WITH f AS (SELECT o_custkey AS key, CASE WHEN o_orderpriority LIKE '1%' THEN 'HIGH' WHEN o_orderpriority LIKE '2%' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM orders), q AS (SELECT key, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) AS n FROM f GROUP BY key) "
    "SELECT *, CASE WHEN high >= 3 THEN 'RED' WHEN high >= 1 OR medium >= 5 THEN 'ORANGE' WHEN medium >= 1 THEN 'YELLOW' ELSE 'GREEN' END AS risk FROM q",
)
def _(read):
    p = F.col("o_orderpriority")
    return stats.risk(read("orders").select(F.col("o_custkey").alias("key"), F.when(p.startswith("1"), "HIGH").when(p.startswith("2"), "MEDIUM").otherwise("LOW").alias("severity")), ["key"])
