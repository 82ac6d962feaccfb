"""Worked cases and thresholds of the detectors."""

import math

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import numeric as num
from tallyglass.functions import relational as rel
from tallyglass.functions import special
from tallyglass.operators import columns, pairs, rows, series, simulation, stats
from tallyglass.plans import findings as fi


def cells(spark, **cols):
    data = [(s, i, c, k, float(v)) for s, one in {"t": cols}.items() for i, (c, values) in enumerate(one.items()) for k, v in enumerate(values)]
    return spark.createDataFrame(data, "source string, col_pos int, col string, idx long, value double")


def two(spark, a, b):
    return rel.column_pairs(cells(spark, a=a, b=b))


def flag(df, name="flagged"):
    found = df.collect()
    return bool(found and found[0][name])


def test_constant_shift(spark):
    r = pairs.constant_shift(two(spark, [1.03, 0.99, 0.97], [1.05, 1.01, 0.99])).first()
    assert r.flagged and r.n == 3 and r.low == pytest.approx(0.02)
    assert not flag(pairs.constant_shift(two(spark, [1, 2, 3], [1, 2, 3])))


def test_cross_file_difference(spark):
    a = cells(spark, x=[33.8, 33.9, 37.9]).withColumn("source", F.lit("A"))
    b = cells(spark, x=[75.2, 75.3, 79.3]).withColumn("source", F.lit("B"))
    r = pairs.cross_source_difference(rel.column_pairs(a.unionByName(b), across_sources=True)).first()
    assert r.flagged and r.difference == pytest.approx(41.4)


def test_prefix_needs_five_rows(spark):
    p = two(spark, [14.5, 16.0, 21.5, 1.0], [14.5, 16.0, 21.5, 2.0])
    assert not flag(pairs.shared_prefix(p))
    r = pairs.identical_columns(p).first()
    assert r.near_identical and not r.identical and r.n_diff == 1
    assert flag(pairs.shared_prefix(two(spark, [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7])))


def test_arithmetic_sequence_depends_on_row_order(spark):
    assert flag(columns.arithmetic_sequence(cells(spark, a=[1, 3, 5, 7, 9])))
    assert not flag(columns.arithmetic_sequence(cells(spark, a=[1, 9, 3, 7, 5])))
    assert not flag(columns.arithmetic_sequence(cells(spark, a=[5, 5, 5, 5])))
    assert not flag(columns.arithmetic_sequence(cells(spark, a=[1, 3, 5])))


def test_last_digits(spark):
    got = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (1.25,), (1e-7,), (-3.40,)], "v double").select(num.last_digit(F.col("v")).alias("d")).collect()
    assert [r.d for r in got] == [0, 5, 1, 5, 7, 4]


@pytest.mark.parametrize("value", [0.1, 1 / 3, 1234567.891, 1e-9, 2.5e20, 100.0, -7.25, 123456789012.0, 0.30000000000000004])
def test_general10_like_c(spark, value):
    r = spark.createDataFrame([(value,)], "v double").select(num.general10(F.col("v"), True).alias("s")).first()
    assert float(r.s) == float("%.10g" % value)


def test_prefixes(spark):
    r = columns.decimal_prefix(cells(spark, a=[1.234, 1.235, 1.236])).where("places = 2").first()
    assert (r.m, r.max_count, r.flagged) == (3, 3, False)


def test_value_sequence_leaves_perfect_ones_out(spark):
    assert not flag(columns.value_sequence(cells(spark, a=range(20))))
    r = columns.value_sequence(cells(spark, a=[*range(20), 25.5, 33.25, 47.5])).first()
    assert r.m == 19 and r.u == 4 and r.flagged
    assert columns.scan_sequences(cells(spark, a=[*range(20), 25.5, 33.25, 47.5])).count() == 1


def test_invariance(spark):
    values = [2.5, 7.25, 1.5, 9.75, 3.0, 2.5, 7.25, 1.5]
    wide = spark.createDataFrame([("s", i, v, v * 2) for i, v in enumerate(values)], "source string, idx long, a double, b double")
    mixed = spark.createDataFrame([("s", i, v, v * 2) for i, v in enumerate(sorted(values))], "source string, idx long, a double, b double")
    for f in (rows.block_duplication, rows.identical_rows):
        assert f(wide, ["a", "b"]).drop("idx").collect() == f(mixed, ["a", "b"]).drop("idx").collect()
    shifted = two(spark, values, [v + 0.5 for v in values])
    assert flag(pairs.constant_shift(shifted)) and flag(pairs.fixed_difference(shifted))
    assert pairs.linear_relation(two(spark, values, [2 * v + 1 for v in values])).where("flagged").select("multiple", "shift").collect() == [(2, 1)]


def test_blocks_across_chunks(spark):
    keys = [1, 2, 3, 4, 9, 1, 2, 3, 4, 8]
    wide = spark.createDataFrame([("s", i, float(k)) for i, k in enumerate(keys)], "source string, idx long, a double")
    want = rows.identical_blocks(wide, ["a"]).orderBy("k").collect()
    assert [(r.k, r.blocks, r.occurrences) for r in want] == [(3, 2, 4), (4, 1, 2), (5, 0, 0)]
    for chunk in (1, 2, 3, 7):
        assert rows.identical_blocks(wide, ["a"], chunk=chunk).orderBy("k").collect() == want


def test_hamming_join_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(8)]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(signed, "id long, hash long")
    for t in (0, 3, 6):
        want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= t}
        assert {tuple(r) for r in rel.hamming_join(df, t).collect()} == want
        assert {tuple(r) for r in rel.hamming_blocks(df, t, 5).collect()} == want
        assert {tuple(r) for r in rel.hamming_probe(df, t).collect()} == want
    halves = df.selectExpr("id", "hash", "id % 2 AS paper")
    for join in (rel.hamming_blocks, rel.hamming_probe):
        assert {r[1:] for r in map(tuple, join(halves, 9, same="paper").collect())} == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (i - j) % 2 == 0 and (a ^ b).bit_count() <= 9}


def test_constant_series_is_monotonic(spark):
    r = series.series_measures(spark.createDataFrame([("x", float(t), 5.0) for t in range(3)], "label string, t double, y double")).first()
    assert r.monotonic and r.direction == "increasing"


def test_summary_case(spark):
    g = stats.cv_check(spark.createDataFrame([(1.2, 0.3, "general"), (1.8, 0.4, "general"), (5.0, 0.0, "wb_gray"), (-1.0, 1.0, "general")], "mean double, sd double, data_type string")).collect()
    assert [r.verdict for r in g] == ["NORMAL", "NORMAL", "CRITICAL", None]
    p = spark.createDataFrame([("x", v) for v in (0.03, 0.12, 0.045)], "key string, p double")
    assert stats.p_distribution(p, ["key"]).count() == 0


def test_exact_tails(spark):
    df = spark.createDataFrame([(2.0, 4.0), (0.0, 7.0), (12.0, 2.0)], "t double, n double")
    got = df.select(special.t_two_sided("t", "n").alias("p"), num.t4_two_sided(F.col("t")).alias("q")).collect()
    assert got[0].p == pytest.approx(got[0].q, abs=1e-12) and got[1].p == pytest.approx(1) and got[2].p == pytest.approx(0.006874, abs=1e-5)
    r = df.select(special.chi2_sf(F.lit(3.841458821), F.lit(1.0)).alias("c"), special.f_sf(F.lit(4.0), F.lit(1.0), F.lit(4.0)).alias("f"), special.t_two_sided(F.lit(2.0), F.lit(4.0)).alias("t")).first()
    assert r.c == pytest.approx(0.05, abs=1e-8) and r.f == pytest.approx(r.t, abs=1e-12)


def test_normal_tail(spark):
    r = spark.range(1).select(*[num.norm_sf(F.lit(z)).alias(str(i)) for i, z in enumerate((0.0, 1.96, -1.0))]).first()
    assert [r[0], r[1], r[2]] == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in (0.0, 1.96, -1.0)], abs=1e-7)


def test_simulation_is_seeded(spark):
    a, b = (simulation.trial_rows(spark, 3, 10, 2, 3, seed=5) for _ in range(2))
    assert a.collect() == b.collect() and a.count() == 30
    names = [c for c in a.columns if c not in ("source", "idx")]
    rates = simulation.false_positive_rates(fi.detect_tables(a, names), 3).collect()
    assert all(r.trial_rate <= 1 for r in rates)


def test_findings_schema_and_report(spark):
    wide = spark.createDataFrame([("s", i, float(i), i + 2.5, float(i % 3)) for i in range(12)], "source string, idx long, a double, b double, c double")
    found = fi.detect_tables(wide, ["a", "b", "c"]).cache()
    assert [f.split()[0] for f in fi.SCHEMA.split(", ")] == found.columns
    assert {"ARITHMETIC_SEQUENCE", "CONSTANT_SHIFT", "FIXED_DIFFERENCE"} <= {r.detector for r in found.collect()}
    report = fi.markdown(found).first().report
    assert report.startswith("## s\n\n- **")
    assert fi.source_risk(found).first().grade == "RED"
    assert fi.summary(found).count() > 3 and fi.as_json(found).count() == found.count()


def test_long_columns_in_ranges_and_chunks(spark):
    import random

    rng = random.Random(3)
    data = [(rng.randint(0, 300), rng.choice([1.0, 2.5, None, 4.0])) for _ in range(400)]
    df = spark.createDataFrame(data, "t int, x double")
    whole = sorted(map(tuple, rel.cells(df, ["x"], F.lit("s"), ["t"]).collect()))
    assert sorted(map(tuple, rel.cells(df, ["x"], F.lit("s"), ["t"], rows_a_range=50).collect())) == whole
    cell = rel.cells(df, ["x"], F.lit("s"), ["t"])
    want = columns.arithmetic_sequence(cell).collect()
    for chunk in (1, 2, 7):
        assert columns.arithmetic_sequence(cell, chunk).collect() == want


def test_neighbours_in_ranges_of_values(spark):
    """Columns cut into ranges and chunks have the steps of columns that one task sorts."""
    from tallyglass.operators import columns

    rows = [(f"s{i % 3}", 0, "c", i, float((i * 37 % 101) * 2.5 + (i % 7 == 0) * 0.3)) for i in range(150)]
    cells = spark.createDataFrame(rows, "source string, col_pos int, col string, idx long, value double")
    for f in (columns.arithmetic_grid, columns.value_sequence):
        whole = sorted(map(tuple, f(cells).collect()))
        assert len(whole) == 3 and sorted(map(tuple, f(cells, rows_a_range=20).collect())) == whole
