"""Queries of the image operators, on 8 x 8 grids made of the driver's embeddings.

Beside the grids stand changed copies (positive controls): every fifth turned a quarter, and one cell raised in
others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images
from .catalog import query

COPY = 1_000_000


def grids(read):
    own = read("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("grid"))
    turned = own.where("id % 5 = 0").select((F.col("id") + COPY).alias("id"), images.turned(F.col("grid"), "rot90").alias("grid"))
    raised = own.where("id % 5 = 1").select((F.col("id") + COPY).alias("id"), F.transform("grid", lambda x, i: F.when(i == F.col("id") % 64, x + 1.0).otherwise(x)).alias("grid"))
    return own.unionByName(turned).unionByName(raised)


_ROT = ", ".join(str(int(i) + 1) for i in images.ORIENTATIONS["rot90"])
_GRIDS = (
    "WITH own AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS g FROM embeddings), grids AS (SELECT * FROM own "
    f"UNION ALL SELECT id + {COPY}, list_transform([{_ROT}], lambda k: g[k]) FROM own WHERE id % 5 = 0 "
    f"UNION ALL SELECT id + {COPY}, list_transform(g, lambda x, i: CASE WHEN i - 1 = id % 64 THEN x + 1.0 ELSE x END) FROM own WHERE id % 5 = 1), "
    "m AS (SELECT id, g, list_reduce(list_prepend(0.0::DOUBLE, g), lambda a, x: a + x) / 64 AS mean FROM grids), "
    "h AS (SELECT id, g, array_to_string(list_transform(g, lambda p: CASE WHEN p >= mean THEN '1' ELSE '0' END), '') AS bits FROM m)"
)


@query("ahash", _GRIDS + " SELECT id, bits FROM h")
def _(read):
    return images.hashes(grids(read)).select("id", "bits")


def _turned(name: str) -> str:
    return "list_transform([" + ", ".join(str(int(i) + 1) for i in images.ORIENTATIONS[name]) + "], lambda k: bits[k])"


@query("orientations", _GRIDS + " SELECT id, " + ", ".join(f"array_to_string({_turned(o)}, '') AS {o}" for o in images.ORIENTATIONS) + " FROM h")
def _(read):
    cells = F.split("bits", "")
    return images.hashes(grids(read)).select("id", *[F.array_join(images.turned(cells, o), "").alias(o) for o in images.ORIENTATIONS])


_SIX = _GRIDS + ", t AS (" + " UNION ".join(f"SELECT id, array_to_string({_turned(o)}, '')::BIT AS b FROM h" for o in images.ORIENTATIONS) + ")"


@query(
    "ahash_pairs",
    _SIX + ", p AS (SELECT x.id AS id_a, y.id AS id_b, min(bit_count(xor(x.b, y.b))) AS distance FROM t x JOIN t y ON x.id < y.id GROUP BY ALL HAVING min(bit_count(xor(x.b, y.b))) <= 6) "
    "SELECT id_a, id_b, distance, CASE WHEN distance <= 3 THEN 'HIGH' WHEN distance <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM p",
)
def _(read):
    return images.average_hash_pairs(grids(read))


def _similar(least: float, same: bool = False) -> str:
    most = int((1 - least) * 64 + 1e-9)
    on = "x.id < y.id AND x.id % 10 = y.id % 10" if same else "x.id < y.id"
    key = "x.id % 10 AS paper, " if same else ""
    return _GRIDS + f", p AS (SELECT {key}x.id AS id_a, y.id AS id_b, bit_count(xor(x.bits::BIT, y.bits::BIT)) AS distance FROM h x JOIN h y ON {on}) SELECT *, round(1 - distance / 64, 6) AS similarity FROM p WHERE distance <= {most}"


@query("phash_compare", _similar(0.85))
def _(read):
    return images.hash_similarity(images.hashes(grids(read)), 0.85)


@query("phash_cross_paper", _similar(0.75))
def _(read):
    return images.hash_similarity(images.hashes(grids(read)), 0.75)


@query("phash_intra_paper", _similar(0.70, True))
def _(read):
    return images.hash_similarity(images.hashes(grids(read)).withColumn("paper", F.col("id") % 10), 0.70, same="paper")


@query("phash_roll_up", "SELECT count(*) AS n, count(*) FILTER (WHERE similarity >= 0.9) AS high, count(*) FILTER (WHERE similarity >= 0.8 AND similarity < 0.9) AS moderate FROM (" + _similar(0.75) + ")")
def _(read):
    return images.similarity_roll_up(images.hash_similarity(images.hashes(grids(read)), 0.75))


_MEAN = "list_reduce(list_prepend(0.0::DOUBLE, {0}), lambda a, x: a + x) / len({0})"
_LEVELS = _GRIDS + ", l AS (SELECT id, list_transform(range(8), lambda r: list_sum(g[r * 8 + 1 : r * 8 + 8]) / 8) AS l, list_transform(range(8), lambda c: list_sum(list_transform(range(8), lambda r: g[r * 8 + c + 1])) / 8) AS k FROM grids), "
_LEVELS += "j AS (SELECT id, l, list_transform(range(7), lambda i: abs(l[i + 2] - l[i + 1])) AS j, list_transform(range(7), lambda i: abs(k[i + 2] - k[i + 1])) AS s FROM l)"


@query(
    "bg_mutation",
    _LEVELS + " SELECT id, round(list_max(j), 6) AS max_jump, len(list_filter(j, lambda x: x > list_avg(j) + 3 * list_stddev_pop(j))) AS n_abrupt, len(list_filter(j, lambda x: x > 3 * list_stddev_pop(l))) AS n_abrupt_level FROM j",
)
def _(read):
    return images.background_mutation(grids(read))


@query(
    "lane_seams",
    _LEVELS + ", z AS (SELECT id, CASE WHEN list_stddev_samp(s) > 0 THEN list_transform(s, lambda x: (x - list_avg(s)) / list_stddev_samp(s)) ELSE [] END AS z FROM j), q AS (SELECT id, len(list_filter(z, lambda x: x >= 1.5)) AS n_seams, round(list_max(z), 6) AS max_z FROM z) SELECT *, CASE WHEN n_seams >= 8 THEN 'HIGH' WHEN n_seams >= 2 THEN 'MEDIUM' END AS severity FROM q",
)
def _(read):
    return images.lane_seams(grids(read), 1.5)


@query("match_level", "WITH p AS (SELECT l_quantity::BIGINT * 3 AS matches, l_extendedprice * 20 AS area_a, l_extendedprice * (1 + l_linenumber % 5) * 8 AS area_b, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), q AS (SELECT *, CASE WHEN area_a > 500000 AND area_b > 500000 AND area_a / area_b BETWEEN 0.3 AND 3 THEN 100 WHEN area_a > 500000 AND area_b > 500000 THEN 40 ELSE 60 END AS lim FROM p) SELECT level, count(*) AS n FROM (SELECT CASE WHEN matches >= lim THEN 'HIGH' WHEN matches >= greatest(8, floor(lim / 3)) THEN 'MODERATE' WHEN matches >= 4 THEN 'LOW' ELSE 'NO' END AS level FROM q) GROUP BY level")
def _(read):
    p = read("lineitem").select((F.col("l_quantity").cast("long") * 3).alias("m"), (F.col("l_extendedprice") * 20).alias("a"), (F.col("l_extendedprice") * (1 + F.col("l_linenumber") % 5) * 8).alias("b"))
    return p.groupBy(images.match_level(F.col("m"), F.col("a"), F.col("b")).alias("level")).agg(F.count("*").alias("n"))


@query("figure_bundle")
def _(read):
    return images.figure_bundle(images.from_grids(grids(read)))


@query("figure_summary")
def _(read):
    return images.figure_summary(images.figure_bundle(images.from_grids(grids(read))))


@query("band_pairs")
def _(read):
    return images.band_pairs(images.from_grids(grids(read)))


@query("repeated_lanes")
def _(read):
    return images.repeated_lanes(images.from_grids(grids(read)))


@query("fft_score")
def _(read):
    return images.frequency_scores(images.from_grids(grids(read)))


@query("ssim_verify")
def _(read):
    pairs = images.hash_similarity(images.hashes(grids(read)), 0.90)
    return images.verify_pairs(pairs, images.from_grids(grids(read)))
