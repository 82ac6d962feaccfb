"""Relational building blocks: the cell model, modes, column pairs, ordered neighbours and Hamming joins."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = ["source", "col_pos", "col", "idx", "value"]


def cells(df: DataFrame, columns: list[str], source: Column, order: list[Column | str], rows_a_range: int | None = None) -> DataFrame:
    """The cell model of a wide table: (source, col_pos, col, idx, value).

    idx counts a column's non-null cells in row order within its source, as unparsable cells are dropped, not
    kept as gaps. rows_a_range: for sources larger than a task, see ordered_index; the first of `order` must then be a
    column that casts to a number.
    """
    if rows_a_range is None and set(columns) <= {c for c in order if isinstance(c, str)}:
        return _ordered_cells(df, columns, source, order)
    wide = df.select(source.alias("source"), F.struct(*order).alias("_order"), *[F.col(c).cast("double").alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    long = wide.select("source", "_order", F.inline(parts)).where("value is not null and not isnan(value)")
    first = None if rows_a_range is None else F.col("_order")[order[0]].cast("double")
    placed = ordered_index(long, ["source", "col_pos"], ["_order", "value"], "idx", first, rows_a_range)
    return placed.select("source", "col_pos", "col", "idx", "value")


def _ordered_cells(df: DataFrame, columns: list[str], source: Column, order: list[Column | str]) -> DataFrame:
    """cells() where the columns are in the order: rows that tie are equal in all of them, so whole rows are sorted, once, in place of each column's cells."""
    rows = df.select(source.alias("source"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(order)])
    place = {c: k for k, c in enumerate(order) if isinstance(c, str)}
    value = {c: F.col(f"_o{place[c]}").cast("double") for c in columns}
    so_far = Window.partitionBy("source").orderBy(*[f"_o{k}" for k in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    found = {c: value[c].isNotNull() & ~F.isnan(value[c]) for c in columns}
    placed = rows.select("source", *[value[c].alias(f"_v{i}") for i, c in enumerate(columns)], *[(F.count_if(found[c]).over(so_far) - 1).alias(f"_i{i}") for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), F.col(f"_i{i}").alias("idx"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(columns)])
    return placed.select("source", F.inline(parts)).where("value is not null and not isnan(value)")


def ordered_index(df: DataFrame, keys: list[str], order: list[str], name: str, first: Column | None = None, rows_a_range: int | None = None) -> DataFrame:
    """df with the 0-based place of each row within its keys, by `order`.

    A window by the keys puts a key's rows into one task. With `first` (a number that `order` begins with) and
    rows_a_range, the rows are cut at quantiles of `first` (one literal a range), numbered within (keys, range), and
    moved by the counts of the ranges before, so that no key needs one task.
    """
    if first is None or rows_a_range is None or (k := -(-df.count() // rows_a_range)) <= 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    bounds = sorted(set(df.select(first.alias("_f")).approxQuantile("_f", [i / k for i in range(1, k)], 1 / (4 * k))))
    number = sum((F.when(first >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    cut = df.withColumn("_range", number)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = cut.groupBy(*keys, "_range").count().select(*keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return cut.withColumn("_place", place).join(moved, [*keys, "_range"]).withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before")


def chunked(rows: DataFrame, ahead: int, chunk: int) -> DataFrame:
    """Rows by the chunk of `chunk` places they belong to (`home`), also sent to the chunks (`chunk`) whose last rows look up to `ahead` places ahead to them."""
    home = F.floor(F.col("idx") / chunk)
    back = F.greatest(F.floor((F.col("idx") - ahead) / chunk), F.lit(0))
    return rows.withColumn("home", home).withColumn("chunk", F.explode(F.sequence(back, home)))


def value_steps(values: DataFrame, keys: list[str], rows_a_range: int) -> DataFrame:
    """(keys, step, place) of (keys, value): the difference to the next value in value order, by place from 1; the last value has none.

    More rows than rows_a_range are numbered in ranges of values and looked ahead in chunks of places, so that no key needs one task.
    """
    step = lambda w: F.round(F.lead("value").over(w) - F.col("value"), 10).alias("step")
    if values.count() <= rows_a_range:
        w = Window.partitionBy(*keys).orderBy("value")
        return values.select(*keys, step(w), F.row_number().over(w).alias("place")).where("step is not null")
    placed = chunked(ordered_index(values.select(*keys, "value"), keys, ["value"], "idx", F.col("value"), rows_a_range), 1, rows_a_range)
    w = Window.partitionBy(*keys, "chunk").orderBy("idx")
    return placed.select(*keys, step(w), (F.col("idx") + 1).alias("place"), "home", "chunk").where("step is not null and home = chunk").drop("home", "chunk")


def table_cells(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """The cell model of a whole table as one source, without an order (idx null): for detectors that count only."""
    parts = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.inline(parts)).where("value is not null and not isnan(value)").select(F.lit(source).alias("source"), "col_pos", "col", F.lit(None).cast("long").alias("idx"), "value")


def mode(df: DataFrame, keys: list[str], value: str, place: str | None) -> DataFrame:
    """(keys, n, n_distinct, mode, freq): the most frequent value; ties go to the first by `place`, or to the smallest without one.

    Two hash aggregations with map-side combining; never a window over the rows.
    """
    first = F.min(place) if place else F.lit(0)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"), first.alias("_f"))
    best = F.max(F.struct(F.col("_c"), -F.col("_f"), -F.col(value)))
    top = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count("*").alias("n_distinct"), best.alias("_b"))
    return top.select(*keys, "n", "n_distinct", (-F.col("_b")["col3"]).alias("mode"), F.col("_b")["_c"].alias("freq"))


def wide_pairs(df: DataFrame, columns: list[str], source: Column, idx: Column) -> DataFrame:
    """(source, idx, a, b, va, vb, pos_a, pos_b): all column pairs of each row, in header order, from a table without missing cells: no join and no shuffle."""
    parts = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("va"), F.col(b).cast("double").alias("vb"), F.lit(i).alias("pos_a"), F.lit(j).alias("pos_b"))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return df.select(source.alias("source"), idx.alias("idx"), F.inline(F.array(*parts)))


def column_pairs(cell: DataFrame, across_sources: bool = False) -> DataFrame:
    """The same from the cell model, for columns with missing cells: pairs are compared over their first min(len) cells.

    across_sources: all pairs of (source, column), also of different sources; source is then "a|b".
    """
    a = cell.select(F.col("source").alias("sa"), F.col("col_pos").alias("pos_a"), F.col("col").alias("a"), "idx", F.col("value").alias("va"))
    b = cell.select(F.col("source").alias("sb"), F.col("col_pos").alias("pos_b"), F.col("col").alias("b"), "idx", F.col("value").alias("vb"))
    if across_sources:
        later = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("pos_a") < F.col("pos_b")))
        return a.join(b, "idx").where(later).select(F.concat_ws("|", "sa", "sb").alias("source"), "idx", "a", "b", "va", "vb", "pos_a", "pos_b")
    same = (F.col("sa") == F.col("sb")) & (a["idx"] == b["idx"]) & (F.col("pos_a") < F.col("pos_b"))
    return a.join(b, same).select(F.col("sa").alias("source"), a["idx"].alias("idx"), "a", "b", "va", "vb", "pos_a", "pos_b")


def hamming_join(hashes: DataFrame, threshold: int, words: tuple[str, ...] = ("hash",)) -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b and at most `threshold` differing bits over 64-bit `words`.

    Exact: the bits are cut into threshold + 1 bands at floor(k * bits / (threshold + 1)); two close hashes agree in
    one band at least, so an equi-join on (band, its bits) finds them. Equal hashes meet as one class in the
    bands and are paired by an equi-join of their own.
    """
    bits = 64 * len(words)
    cuts = [k * bits // (threshold + 1) for k in range(threshold + 2)]
    bands = []
    for k in range(threshold + 1):
        parts = []
        for w, name in enumerate(words):
            lo, hi = max(cuts[k], 64 * w) - 64 * w, min(cuts[k + 1], 64 * (w + 1)) - 64 * w
            if lo < hi:
                mask = (1 << (hi - lo)) - 1
                parts.append(F.shiftrightunsigned(F.col(name), lo).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)))
        bands.append(F.struct(F.lit(k).alias("band"), F.hash(*parts).alias("h1"), F.xxhash64(*parts).alias("bits")))
    distinct = hashes.select(*words).distinct()
    rows = distinct.select(*words, F.explode(F.array(*bands)).alias("k")).select("k.band", "k.bits", *words)
    a = rows.select("band", "bits", *[F.col(w).alias(f"{w}_a") for w in words])
    b = rows.select("band", "bits", *[F.col(w).alias(f"{w}_b") for w in words])
    distance = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words[1:]), F.bit_count(F.col(f"{words[0]}_a").bitwiseXOR(F.col(f"{words[0]}_b"))))
    before = F.struct(*[f"{w}_a" for w in words]) < F.struct(*[f"{w}_b" for w in words])
    close = a.join(b, ["band", "bits"]).where(before).withColumn("distance", distance).where(F.col("distance") <= threshold)
    close = close.select(*[f"{w}_{s}" for s in "ab" for w in words], "distance").distinct()
    left = hashes.select(F.col("id").alias("id_x"), *[F.col(w).alias(f"{w}_a") for w in words])
    right = hashes.select(F.col("id").alias("id_y"), *[F.col(w).alias(f"{w}_b") for w in words])
    apart = close.join(left, [f"{w}_a" for w in words]).join(right, [f"{w}_b" for w in words]).select("id_x", "id_y", "distance")
    twin = right.toDF("id_y", *[f"{w}_a" for w in words])
    equal = left.join(twin, [f"{w}_a" for w in words]).where("id_x < id_y").select("id_x", "id_y", F.lit(0).alias("distance"))
    both = apart.unionByName(equal)
    return both.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "distance")


def hamming_blocks(hashes: DataFrame, threshold: int, blocks: int = 16, same: str | None = None) -> DataFrame:
    """hamming_probe() of a few thousand rows: every pair of blocks of rows meets in an equi-join, which costs less there than probes do.

    same: a column that both rows must share; it then takes the place of the blocks.
    """
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    if same:
        a, b = hashes.select(same, F.col("id").alias("id_a"), F.col("hash").alias("hash_a")), hashes.select(same, F.col("id").alias("id_b"), F.col("hash").alias("hash_b"))
        pairs = a.join(b, same).where("id_a < id_b")
        return pairs.withColumn("distance", distance).where(F.col("distance") <= threshold).select(same, "id_a", "id_b", "distance")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    own = hashes.withColumn("k", block)
    a = own.select(F.col("id").alias("id_x"), F.col("hash").alias("hash_a"), F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.lit(blocks - 1))).alias("j"))
    b = own.select(F.col("id").alias("id_y"), F.col("hash").alias("hash_b"), F.col("k").alias("j"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    once = (F.col("i") < F.col("j")) | (F.col("id_x") < F.col("id_y"))
    pairs = a.join(b, ["i", "j"]).where(once).withColumn("distance", distance).where(F.col("distance") <= threshold)
    return pairs.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "distance")


def hamming_probe(hashes: DataFrame, threshold: int, same: str | None = None) -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b and at most `threshold` differing bits, for thresholds at which equal bands prune nothing.

    Exact: of four bands of 16 bits, one at least differs in threshold // 4 bits or fewer, so one side is sent to every value of a
    band within that many bits (137 for 2), where an equi-join on (band, value) finds it. Equal hashes meet as one.
    same: a column that both rows must share.
    """
    keys = [same] if same else []
    masks = [sum(1 << b for b in bits) for n in range(threshold // 4 + 1) for bits in itertools.combinations(range(16), n)]
    value = lambda k: F.shiftrightunsigned(F.col("hash"), 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")
    distinct = hashes.select(*keys, "hash").distinct()
    bands = F.array(*[F.struct(F.lit(k).alias("band"), value(k).alias("value")) for k in range(4)])
    own = distinct.select(*keys, "hash", F.inline(bands))
    probes = own.select(*keys, F.col("hash").alias("hash_a"), "band", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    close = probes.join(own.withColumnRenamed("hash", "hash_b"), [*keys, "band", "value"]).where("hash_a < hash_b").withColumn("distance", distance).where(F.col("distance") <= threshold)
    close = close.select(*keys, "hash_a", "hash_b", "distance").distinct()
    left, right = (hashes.select(*keys, F.col("id").alias(f"id_{x}"), F.col("hash").alias(f"hash_{y}")) for x, y in (("x", "a"), ("y", "b")))
    apart = close.join(left, [*keys, "hash_a"]).join(right, [*keys, "hash_b"]).select(*keys, "id_x", "id_y", "distance")
    equal = left.join(right.withColumnRenamed("hash_b", "hash_a"), [*keys, "hash_a"]).where("id_x < id_y").select(*keys, "id_x", "id_y", F.lit(0).alias("distance"))
    return apart.unionByName(equal).select(*keys, F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "distance")
