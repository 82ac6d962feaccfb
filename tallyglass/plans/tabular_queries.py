"""Queries of the tabular and series detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import relational as rel
from ..operators import columns, pairs, rows, series
from .catalog import query

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", *LINE]
TABLES = {"lineitem": LINE, "orders": ["o_totalprice"], "part": ["p_retailprice", "p_size"], "customer": ["c_acctbal"], "events": ["value"]}


def supplier():
    return F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))


def line_cells(read):
    return rel.cells(read("lineitem"), LINE, supplier(), ORDER)


def line_rows(read):
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)) - 1
    return read("lineitem").select(supplier().alias("source"), place.cast("long").alias("idx"), *LINE)


def line_pairs(read):
    return rel.wide_pairs(line_rows(read), LINE, F.col("source"), F.col("idx"))


def part_pairs(read):
    return rel.wide_pairs(read("part"), ["p_partkey", "p_size", "p_retailprice"], F.lit("part"), F.col("p_partkey"))


def all_cells(read):
    out = None
    for table, cols in TABLES.items():
        one = rel.table_cells(read(table), cols, table)
        out = one if out is None else out.unionByName(one)
    return out


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_ORDER = ", ".join(ORDER)
_ROWS = f"rows_ AS (SELECT 's' || l_suppkey AS source, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS idx, {', '.join(LINE)} FROM lineitem)"
_CELLS = f"WITH {_ROWS}, cells AS ({_union([f'SELECT source, idx, {c!r} AS col, {c} AS value FROM rows_' for c in LINE])})"
_ALL = "WITH cells AS (" + _union([f"SELECT {t!r} AS source, {c!r} AS col, CAST({c} AS DOUBLE) AS value FROM {t}" for t, cs in TABLES.items() for c in cs]) + ")"
_PAIRS = f"WITH {_ROWS}, pairs AS (" + _union([f"SELECT source, idx, {a!r} AS a, {b!r} AS b, {a} AS va, {b} AS vb FROM rows_" for i, a in enumerate(LINE) for b in LINE[i + 1 :]]) + ")"
_PART = ["p_partkey", "p_size", "p_retailprice"]
_PPAIRS = "WITH pairs AS (" + _union([f"SELECT 'part' AS source, p_partkey AS idx, {a!r} AS a, {b!r} AS b, CAST({a} AS DOUBLE) AS va, CAST({b} AS DOUBLE) AS vb FROM part" for i, a in enumerate(_PART) for b in _PART[i + 1 :]]) + ")"
_SEV = "CASE WHEN z > 6.3613409024 THEN 'CRITICAL' WHEN z > 4.2648907939 THEN 'HIGH' ELSE 'MEDIUM' END"


def _z(k: str, n: str, p: float) -> str:
    return f"({k} - {n} * {p}) / sqrt({n} * ({p} * (1 - {p})))"


def _erfc(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * ({x})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"({poly}) * exp(-({x}) * ({x}))"


def sql_sf(z: str) -> str:
    tail = f"0.5 * {_erfc(f'abs({z}) / sqrt(2.0)')}"
    return f"CASE WHEN ({z}) >= 0 THEN {tail} ELSE 1 - {tail} END"


def _binomial(k: str, n: str) -> str:
    return f"CASE WHEN {k} = 0 OR {n} = 0 THEN 1.0 WHEN z > 20 THEN 0.0 WHEN z < 0 THEN 1.0 ELSE {sql_sf('z')} END"


def _mode(source: str, keys: str, value: str, place: str | None = "idx") -> str:
    """CTEs c_ and m_ with the mode, its frequency, n and n_distinct."""
    first = f"min({place})" if place else "0"
    return (
        f"c_ AS (SELECT {keys}, {value} AS v, count(*) AS c, {first} AS f FROM {source} GROUP BY {keys}, {value}), "
        f"m_ AS (SELECT *, sum(c) OVER (PARTITION BY {keys})::BIGINT AS n, count(*) OVER (PARTITION BY {keys}) AS n_distinct, "
        f"row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, f, v) AS r FROM c_)"
    )


_ARITH = (
    ", steps AS (SELECT source, col, idx, round(lead(value) OVER (PARTITION BY source, col ORDER BY idx) - value, 10) AS d FROM cells), "
    "known AS (SELECT * FROM steps WHERE d IS NOT NULL), "
    + _mode("known", "source, col", "d")
    + f", q AS (SELECT source, col, n + 1 AS n, v AS step, c AS freq, n AS steps, {_z('c', 'n', 0.1)} AS z FROM m_ WHERE r = 1) "
    f"SELECT source, col, n, round(step, 6) AS step, freq, round(z, 6) AS z, round({_binomial('freq', 'steps')}, 6) AS p, {_SEV} AS severity, "
    "steps >= 3 AND freq >= 0.8 * steps AND freq >= 3 AND step <> 0 AS flagged FROM q"
)
_PARTCELLS = "WITH cells AS (" + _union([f"SELECT 'part' AS source, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, {c!r} AS col, CAST({c} AS DOUBLE) AS value FROM part" for c in ("p_retailprice", "p_size")]) + ")"


def part_cells(read):
    return rel.cells(read("part"), ["p_retailprice", "p_size"], F.lit("part"), ["p_partkey"])


@query("arith_seq_part", _PARTCELLS + _ARITH)
def _(read):
    return columns.arithmetic_sequence(part_cells(read))


@query("arith_seq_lineitem", _CELLS + _ARITH)
def _(read):
    return columns.arithmetic_sequence(line_cells(read))


_DIGIT = "regexp_replace(regexp_replace(printf('%.10g', abs(value)), '0+$', ''), '\\.$', '')"


@query(
    "last_digit_profile",
    _ALL + f", d AS (SELECT source, col, {_DIGIT} AS bare FROM cells), e AS (SELECT source, col, CASE WHEN bare = '' THEN 0 WHEN regexp_matches(bare, '[0-9]$') THEN right(bare, 1)::INT END AS d FROM d), "
    "k AS (SELECT * FROM e WHERE d IS NOT NULL), "
    + _mode("k", "source, col", "d", None)
    + ", q AS (SELECT source, col, n, v, c, (SELECT count(*) FROM k WHERE k.source = m_.source AND k.col = m_.col AND d IN (0, 5)) AS n05 FROM m_ WHERE r = 1) "
    f"SELECT source, col, n, n05 AS n_05, v AS digit, c AS freq, round({_z('n05', 'n', 0.2)}, 6) AS z_05, round({_z('c', 'n', 0.1)}, 6) AS z_same, n >= 5 AND n05 > 0.5 * n AS prefers_05, n >= 5 AND c >= 0.8 * n AS all_same FROM q",
)
def _(read):
    return columns.last_digits(all_cells(read))


_FRACTION = "regexp_extract(regexp_replace(printf('%.10g', abs(value)), 'e.*$', ''), '\\.(\\d+)$', 1)"


@query(
    "decimal_precision",
    _ALL + f", f AS (SELECT source, col, {_FRACTION} AS f FROM cells), b AS (SELECT source, col, length(f) AS len, right(f, 1) AS digit, count(*) AS c FROM f GROUP BY ALL), "
    "l AS (SELECT source, col, len, sum(c)::BIGINT AS c FROM b GROUP BY ALL), "
    "u AS (SELECT source, col, sum(c) OVER (PARTITION BY source, col)::BIGINT AS n, len AS usual, row_number() OVER (PARTITION BY source, col ORDER BY c DESC, len DESC) AS r FROM l), "
    "t AS (SELECT b.*, n, usual, sum(c) OVER (PARTITION BY source, col)::BIGINT AS m, row_number() OVER (PARTITION BY source, col ORDER BY c DESC, digit DESC) AS r2 FROM b JOIN (SELECT * FROM u WHERE r = 1) u USING (source, col) WHERE len = usual + 1) "
    f"SELECT source, col, n, usual, m, digit, c AS freq, round({_z('c', 'm', 0.18)}, 6) AS z, n >= 5 AND usual > 0 AND m >= 3 AND c >= 3 AND c >= 0.7 * m AS flagged FROM t WHERE r2 = 1",
)
def _(read):
    return columns.decimal_precision(all_cells(read))


@query(
    "decimal_prefix",
    _ALL + f", f AS (SELECT source, col, {_FRACTION} AS f FROM cells), p AS (SELECT source, col, places, left(f, places) AS prefix, count(*) AS c FROM f, (VALUES (2), (3)) v(places) WHERE length(f) >= places GROUP BY ALL), "
    "m AS (SELECT source, col, places, sum(c)::BIGINT AS m, count(*) FILTER (WHERE c >= 2) AS groups, max(c) AS max_count, coalesce(sum(c) FILTER (WHERE c >= 2), 0)::BIGINT AS items FROM p GROUP BY ALL) "
    "SELECT source, col, places, m, groups, max_count, items, round((items - m * pow(0.1, places)) / sqrt(m * pow(0.1, places) * (1 - pow(0.1, places))), 6) AS z, m >= 10 AND (groups > 5 OR max_count >= 3 OR items > 0.15 * m) AS flagged FROM m",
)
def _(read):
    return columns.decimal_prefix(all_cells(read))


_GRID = (
    ", u AS (SELECT DISTINCT source, col, value FROM cells), g AS (SELECT source, col, round(lead(value) OVER w - value, 10) AS gap, row_number() OVER w AS place FROM u WINDOW w AS (PARTITION BY source, col ORDER BY value)), "
    "k AS (SELECT * FROM g WHERE gap IS NOT NULL), "
    + _mode("k", "source, col", "gap", "place")
    + ", t AS (SELECT source, col, count(*) AS n_values FROM cells GROUP BY ALL), q AS (SELECT source, col, n_values, n + 1 AS u, v AS gap, c AS freq, n FROM m_ JOIN t USING (source, col) WHERE r = 1) "
    f"SELECT source, col, n_values, u AS n_distinct, round(gap, 6) AS gap, freq, round({_z('freq', 'n', 0.1)}, 6) AS z, "
    "n_values >= 5 AND u > 10 AND freq >= greatest(3.0, 0.5 * u) AND gap > 0 AND u / n_values > 0.5 AND gap NOT IN (0.1, 0.5, 1.0, 0.01, 0.05) AS flagged FROM q"
)


@query("arith_grid", _ALL + _GRID)
def _(read):
    return columns.arithmetic_grid(all_cells(read))


@query("arith_grid_supplier", _CELLS + _GRID)
def _(read):
    return columns.arithmetic_grid(line_cells(read))


@query("v7_quality_filter", _CELLS + ", " + _mode("cells", "source, col", "value") + " SELECT source, col, n, n_distinct, round(v, 6) AS commonest, c AS freq, n >= 4 AND n_distinct >= 3 AND c <= 0.6 * n AS usable FROM m_ WHERE r = 1")
def _(read):
    return columns.quality_filter(line_cells(read))


_EVENTS = "WITH cells AS (SELECT 'u' || user_id || '|' || event_type AS source, 'value' AS col, value FROM events WHERE value IS NOT NULL)"
_V7 = (
    ", g AS (SELECT source, col, round(lead(value) OVER w - value, 10) AS d, row_number() OVER w AS place FROM cells WINDOW w AS (PARTITION BY source, col ORDER BY value)), k AS (SELECT * FROM g WHERE d IS NOT NULL), "
    + _mode("k", "source, col", "d", "place")
    + ", q AS (SELECT source, col, n + 1 AS n, n_distinct AS u, v AS step, c AS m FROM m_ WHERE r = 1), "
    "l AS (SELECT *, least(m + 1, n - m - 1) AS k_ FROM q), "
    "p AS (SELECT *, CASE WHEN u <= 1 THEN 1.0 ELSE least(1.0, exp(coalesce(list_sum(list_transform(range(1, k_ + 1), lambda i: ln((n - k_ + i) / i))), 0) - (m - 1) * ln(u - 1.0))) END AS p FROM l) "
    "SELECT source, col, n, u, round(step, 6) AS step, m, round(p, 6) AS p, m >= 3 AND (m + 1) / n >= 0.5 AND u > 1 AND p < 0.01 AS flagged FROM p"
)


def event_cells(read):
    return rel.cells(read("events"), ["value"], F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("|"), F.col("event_type")), ["ts", "event_id"])


@query("v7_sequence_lineitem", _CELLS + _V7)
def _(read):
    return columns.value_sequence(line_cells(read))


@query("v7_sequence_grouped", _EVENTS + _V7)
def _(read):
    return columns.value_sequence(event_cells(read))


_FIXED = ", " + _mode("pairs", "source, a, b", "round(vb - va, 10)") + f", q AS (SELECT *, {_z('c', 'n', 0.1)} AS z FROM m_ WHERE r = 1) "
_FIXED += f"SELECT source, a, b, n, n_distinct, round(v, 6) AS difference, c AS freq, round(z, 6) AS z, round({_binomial('c', 'n')}, 6) AS p, {_SEV} AS severity, n >= 3 AND c >= 0.5 * n AND c >= 3 AND v <> 0 AS flagged FROM q"


@query("pair_fixed_difference", _PAIRS + _FIXED)
def _(read):
    return pairs.fixed_difference(line_pairs(read))


@query("pair_fixed_difference_part", _PPAIRS + _FIXED)
def _(read):
    return pairs.fixed_difference(part_pairs(read))


@query(
    "pair_fixed_ratio",
    _PAIRS + ", big AS (SELECT * FROM pairs WHERE abs(va) > 1e-10), t AS (SELECT source, a, b, count(*) AS n_rows FROM pairs GROUP BY ALL), "
    + _mode("big", "source, a, b", "round(vb / va, 6)")
    + f" SELECT source, a, b, n_rows, n AS n_used, round(v, 6) AS ratio, c AS freq, round({_z('c', 'n_rows', 0.1)}, 6) AS z, n_rows >= 3 AND c >= 0.5 * n_rows AND c >= 3 AND abs(v - 1) > 1e-6 AS flagged FROM m_ JOIN t USING (source, a, b) WHERE r = 1",
)
def _(read):
    return pairs.fixed_ratio(line_pairs(read))


_LINEAR = (
    ", ms AS (SELECT m, s FROM (VALUES (-5), (-2), (-1), (1), (2), (5)) x(m), (VALUES (-10), (-5), (-2), (-1), (0), (1), (2), (5), (10)) y(s)), "
    "k AS (SELECT source, a, b, m AS multiple, s AS shift, count(*) AS n, count(*) FILTER (WHERE abs(round(m * va + s, 8) - round(vb, 8)) < 1e-6) AS matches FROM pairs, ms GROUP BY ALL) "
    f"SELECT source, a, b, n, multiple, shift, matches, round({_z('matches', 'n', 0.05)}, 6) AS z, n >= 4 AND matches >= 0.8 * n AND matches >= 4 AS flagged FROM k"
)


@query("pair_linear", _PAIRS + _LINEAR)
def _(read):
    return pairs.linear_relation(line_pairs(read))


@query("pair_linear_part", _PPAIRS + _LINEAR)
def _(read):
    return pairs.linear_relation(part_pairs(read))


@query("pair_corr", _PAIRS + " SELECT source, a, b, count(*) AS n, round(corr(va, vb), 6) AS r, count(*) >= 8 AND corr(va, vb) >= 0.92 AND corr(va, vb) < 0.999 AS flagged FROM pairs GROUP BY source, a, b")
def _(read):
    return pairs.noise_correlation(line_pairs(read))


def copied_pairs(read):
    """Discounts against a copy that differs in some rows: all equal, one different, or different after a prefix, by supplier."""
    wide = line_rows(read).select(
        "source", "idx", "l_discount",
        F.when((F.col("idx") == 3) & F.col("source").endswith("1"), F.col("l_discount") + 1).when((F.col("idx") >= 200) & F.col("source").endswith("2"), F.col("l_tax")).otherwise(F.col("l_discount")).alias("copy"),
    )
    return rel.wide_pairs(wide, ["l_discount", "copy"], F.col("source"), F.col("idx"))


_COPIES = f"WITH {_ROWS}, pairs AS (SELECT source, idx, 'l_discount' AS a, 'copy' AS b, l_discount AS va, CASE WHEN idx = 3 AND source LIKE '%1' THEN l_discount + 1 WHEN idx >= 200 AND source LIKE '%2' THEN l_tax ELSE l_discount END AS vb FROM rows_)"


@query(
    "pair_identical",
    _COPIES + ", d AS (SELECT *, printf('%.10g', va) <> printf('%.10g', vb) AS x FROM pairs), q AS (SELECT source, a, b, count(*) AS n, count(*) FILTER (WHERE x) AS n_diff, min(idx) FILTER (WHERE x) AS first_diff FROM d GROUP BY ALL) "
    "SELECT *, n >= 3 AND n_diff = 0 AS identical, (n >= 4 AND n_diff = 1) OR (n >= 8 AND n_diff = 2 AND (n - 2) / n >= 0.75) AS near_identical FROM q",
)
def _(read):
    return pairs.identical_columns(copied_pairs(read))


@query(
    "pair_prefix_copy",
    _COPIES + ", q AS (SELECT source, a, b, count(*) AS n, min(idx) FILTER (WHERE abs(va - vb) > 1e-8) AS k FROM pairs GROUP BY ALL) "
    f"SELECT source, a, b, n, k, round({_z('k', 'n', 0.1)}, 6) AS z, coalesce(n >= 4 AND k >= 5 AND k / n >= 0.15, false) AS flagged FROM q",
)
def _(read):
    return pairs.shared_prefix(copied_pairs(read))


@query("pair_shift", _PPAIRS + ", d AS (SELECT source, a, b, round(vb - va, 10) AS d FROM pairs) SELECT source, a, b, count(*) AS n, round(min(d), 6) AS low, round(max(d), 6) AS high, count(*) >= 3 AND min(d) = max(d) AND min(d) <> 0 AS flagged FROM d GROUP BY source, a, b")
def _(read):
    return pairs.constant_shift(part_pairs(read))


@query(
    "cross_source_difference",
    _CELLS + ", few AS (SELECT * FROM cells WHERE col IN ('l_discount', 'l_tax')), pairs AS (SELECT x.source || '|' || y.source AS source, x.idx, x.col AS a, y.col AS b, x.value AS va, y.value AS vb FROM few x JOIN few y ON x.idx = y.idx AND (x.source < y.source OR (x.source = y.source AND x.col < y.col))), "
    + _mode("pairs", "source, a, b", "round(vb - va, 10)")
    + " SELECT source, a, b, n, n_distinct, round(v, 6) AS difference, c AS freq, (n >= 3 AND n_distinct = 1 AND v <> 0) OR (n >= 5 AND c >= 0.8 * n AND c >= 4) AS flagged FROM m_ WHERE r = 1",
)
def _(read):
    return pairs.cross_source_columns(rel.cells(read("lineitem"), ["l_discount", "l_tax"], supplier(), ORDER))


@query("cross_source_difference_all")
def _(read):
    """All columns; the query above has those of its SQL."""
    return pairs.cross_source_columns(line_cells(read))


_TRIPLE = ["l_quantity", "l_discount", "l_tax"]
_KEY = " || '|' || ".join(f"printf('%.10g', {c})" for c in _TRIPLE)


@query(
    "row_dup",
    f"WITH {_ROWS}, b AS (SELECT source, count(*) AS c FROM rows_ GROUP BY source, round(l_quantity, 6), round(l_discount, 6), round(l_tax, 6)), q AS (SELECT source, sum(c)::BIGINT AS n, count(*) AS n_unique FROM b GROUP BY source) "
    f"SELECT source, n, n_unique, n - n_unique AS dups, round({_z('n_unique', 'n', 0.5)}, 6) AS z, n >= 4 AND n - n_unique >= 3 AND n - n_unique > 0.3 * n AS flagged FROM q",
)
def _(read):
    return rows.block_duplication(line_rows(read), _TRIPLE)


@query(
    "row_identical",
    f"WITH {_ROWS}, b AS (SELECT source, {_KEY} AS key, count(*) AS c FROM rows_ GROUP BY ALL), q AS (SELECT source, sum(c)::BIGINT AS n, sum(c - 1)::BIGINT AS dups, max(c) AS largest, count(*) FILTER (WHERE c >= 2) AS groups FROM b GROUP BY source) "
    f"SELECT source, n, dups, largest, groups, round({_z('dups', 'n', 0.01)}, 6) AS z, dups >= 3 AND largest >= 3 AS flagged FROM q",
)
def _(read):
    return rows.identical_rows(line_rows(read), _TRIPLE)


@query("row_identical_groups", f"WITH {_ROWS} SELECT source, {_KEY} AS key, count(*) AS c, min(idx) AS first, max(idx) AS last FROM rows_ GROUP BY 1, 2 HAVING count(*) >= 2")
def _(read):
    return rows.identical_row_groups(line_rows(read), _TRIPLE)


_ONE = "printf('%.10g', l_tax)"


@query(
    "block_identical",
    f"WITH {_ROWS}, k AS (SELECT source, idx, {_ONE} AS key FROM rows_), "
    "w AS (SELECT source, 3 AS k, concat_ws(' ', key, lead(key, 1) OVER o, lead(key, 2) OVER o) AS block, lead(key, 2) OVER o AS last FROM k WINDOW o AS (PARTITION BY source ORDER BY idx) "
    "UNION ALL SELECT source, 4, concat_ws(' ', key, lead(key, 1) OVER o, lead(key, 2) OVER o, lead(key, 3) OVER o), lead(key, 3) OVER o FROM k WINDOW o AS (PARTITION BY source ORDER BY idx) "
    "UNION ALL SELECT source, 5, concat_ws(' ', key, lead(key, 1) OVER o, lead(key, 2) OVER o, lead(key, 3) OVER o, lead(key, 4) OVER o), lead(key, 4) OVER o FROM k WINDOW o AS (PARTITION BY source ORDER BY idx)), "
    "b AS (SELECT source, k, block, count(*) AS c FROM w WHERE last IS NOT NULL GROUP BY ALL), n AS (SELECT source, count(*) AS n FROM rows_ GROUP BY source) "
    "SELECT source, k, n, count(*) FILTER (WHERE c >= 2) AS blocks, coalesce(sum(c) FILTER (WHERE c >= 2), 0)::BIGINT AS occurrences, max(c) AS max_occurrences, n >= 2 * k AND count(*) FILTER (WHERE c >= 2) > 0 AS flagged FROM b JOIN n USING (source) GROUP BY source, k, n",
)
def _(read):
    return rows.identical_blocks(line_rows(read), ["l_tax"], chunk=64)


def event_points(read):
    """Each user's values by time, each user's running totals, and made-up regular series as positive controls."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = read("events").where("value is not null").select(F.col("user_id"), (F.row_number().over(w) - 1).cast("double").alias("t"), "value", F.sum("value").over(w).alias("total"))
    label = lambda x: F.concat(F.lit(x), F.col("user_id").cast("string"))
    made = F.array(
        F.struct(label("raw").alias("label"), F.col("t"), F.col("value").alias("y")),
        F.struct(label("total").alias("label"), F.col("t"), F.col("total").alias("y")),
        F.struct(label("line").alias("label"), F.col("t"), (F.col("t") * 2 + F.col("user_id")).alias("y")),
        F.struct(label("power").alias("label"), F.col("t"), F.pow(F.lit(1.5), F.least(F.col("t"), F.lit(20.0))).alias("y")),
        F.struct(label("square").alias("label"), F.col("t"), (F.col("t") * F.col("t")).alias("y")),
        F.struct(label("flat").alias("label"), F.col("t"), F.lit(5.0).alias("y")),
    )
    return base.select(F.inline(made))


_POINTS = (
    "WITH base AS (SELECT user_id, CAST(row_number() OVER w - 1 AS DOUBLE) AS t, value, sum(value) OVER w AS total FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), points AS ("
    + _union([f"SELECT '{n}' || user_id AS label, t, {e} AS y FROM base" for n, e in (("raw", "value"), ("total", "total"), ("line", "t * 2 + user_id"), ("power", "pow(1.5, least(t, 20.0))"), ("square", "t * t"), ("flat", "5.0"))])
    + "), s1 AS (SELECT *, y - lag(y) OVER w AS d, lag(y) OVER w AS py FROM points WINDOW w AS (PARTITION BY label ORDER BY t)), s2 AS (SELECT *, d - lag(d) OVER (PARTITION BY label ORDER BY t) AS d2, CASE WHEN py <> 0 THEN d / py END AS g FROM s1), "
    "o AS (SELECT label, count(*) AS n, coalesce(bool_and(d > 0) FILTER (WHERE abs(d) > 1e-10), true) AS up, coalesce(bool_and(d < 0) FILTER (WHERE abs(d) > 1e-10), true) AS down, min(y) AS low, avg(g) AS mg, stddev_pop(g) AS sg, avg(d) AS md, stddev_pop(d) AS sd, avg(d2) AS m2, stddev_pop(d2) AS s2, regr_r2(y, t) AS r2, regr_syy(y, t) AS syy FROM s2 GROUP BY label), "
    "pos AS (SELECT label, regr_slope(ln(y), t) AS b, regr_intercept(ln(y), t) AS a FROM points WHERE y > 0 GROUP BY label), "
    "c AS (SELECT p.label, CASE WHEN o.syy > 1e-10 THEN 1 - sum(pow(p.y - exp(a + b * p.t), 2)) / o.syy END AS r2e FROM points p JOIN o USING (label) JOIN pos USING (label) WHERE low > 0 AND n >= 4 GROUP BY p.label, o.syy), "
    "q AS (SELECT o.*, r2e, CASE WHEN low > 0 AND n >= 3 AND abs(mg) > 1e-10 THEN sg / abs(mg) END AS gcv, CASE WHEN n >= 3 AND abs(md) > 1e-10 THEN sd / abs(md) END AS scv, CASE WHEN n >= 4 AND abs(m2) > 1e-10 THEN s2 / abs(m2) END AS dcv, CASE WHEN n >= 4 AND syy > 1e-10 THEN r2 END AS r2l FROM o LEFT JOIN c USING (label)) "
)
_ROUND_Q = "SELECT label, n, n >= 3 AND (up OR down) AS monotonic, CASE WHEN up THEN 'increasing' WHEN down THEN 'decreasing' END AS direction, "


@query("ts_monotonic", _POINTS + _ROUND_Q.rstrip(", ") + " FROM q")
def _(read):
    return series.series_measures(event_points(read)).select("label", "n", "monotonic", "direction")


@query("ts_growth", _POINTS + "SELECT label, round(gcv, 6) AS growth_cv, coalesce(gcv < 1e-4, false) AS constant_growth FROM q")
def _(read):
    return series.series_measures(event_points(read)).select("label", "growth_cv", "constant_growth")


@query("ts_spacing", _POINTS + "SELECT label, round(scv, 6) AS spacing_cv, CASE WHEN scv < 1e-4 THEN 'HIGH' WHEN scv < 1e-3 THEN 'MEDIUM' END AS spacing FROM q")
def _(read):
    return series.series_measures(event_points(read)).select("label", "spacing_cv", "spacing")


@query("ts_second_diff", _POINTS + "SELECT label, round(dcv, 6) AS second_cv, coalesce(dcv < 1e-6, false) AS constant_second FROM q")
def _(read):
    return series.series_measures(event_points(read)).select("label", "second_cv", "constant_second")


@query("ts_linear_fit", _POINTS + "SELECT label, round(r2l, 6) AS r2_linear, coalesce(r2l > 0.999, false) AS overfit_linear FROM q")
def _(read):
    return series.series_measures(event_points(read)).select("label", "r2_linear", "overfit_linear")


@query("ts_exp_fit", _POINTS + "SELECT label, round(r2e, 6) AS r2_exponential, coalesce(r2e > 0.999, false) AS overfit_exponential FROM q")
def _(read):
    return series.series_measures(event_points(read)).select("label", "r2_exponential", "overfit_exponential")


@query(
    "ts_severity",
    _POINTS + "SELECT label, coalesce(gcv < 1e-4, false)::INT + coalesce(scv < 1e-4, false)::INT + coalesce(dcv < 1e-6, false)::INT AS n_high, "
    "(n >= 3 AND (up OR down))::INT + coalesce(scv >= 1e-4 AND scv < 1e-3, false)::INT + coalesce(r2l > 0.999, false)::INT + coalesce(r2e > 0.999, false)::INT AS n_medium FROM q",
)
def _(read):
    return series.severity_counts(series.series_measures(event_points(read)))
