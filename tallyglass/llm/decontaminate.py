"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (powers of two). Each item keeps a bottom-k
MinHash sketch: its SKETCH smallest shingle hashes, those that over SHARED items have coming last, so that what
many items begin with proposes none of them. As items are short and documents long, the search asks
for containment, not resemblance: a document's whole shingle hashes are joined to the sketches, so an item
is a candidate wherever one of its sketch hashes stands, in partitions whose items can reach the threshold
with that document's number of shingles. Of an item with at least 0.8 of its shingles in a document, all
SKETCH smallest are missing with a chance below 0.2 ** SKETCH (6.6e-12), and never if it has fewer than
5 * SKETCH shingles. Candidates are verified by exact containment over the shingles' words. An item of fewer than
SHINGLE words is one shingle of its own length; documents have shingles of such a length only if an item asks for them.

The shingles are exploded with explode_outer, and what the join compares can't be null: otherwise Spark infers
filters from explode and join that compute the whole array again, once for each shingle.

Sketches are broadcast only while they have at most BROADCAST_ROWS rows (20 bytes a row); beyond that the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, table, words

SHINGLE = 5
CONTAINMENT = 0.8
SKETCH = 16
BROADCAST_ROWS = 1_000_000
#: A shingle of more items than this comes last in sketches.
SHARED = 20


def _shingle(w: Column, i: Column, n: int = SHINGLE) -> Column:
    return F.concat_ws(" ", F.slice(w, i + 1, n))


def _hash(w: Column, i: Column, n: int = SHINGLE) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(n)])


def _places(w: Column, n: int = SHINGLE) -> Column:
    """0-based starts of the runs of n words; empty for fewer words."""
    last = F.size(w) - n
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _runs(w: Column, short: tuple[int, ...], of) -> Column:
    """Distinct of(w, place, words) of the runs of SHINGLE words, and of those of the lengths in `short`."""

    def runs(n: int) -> Column:
        return F.transform(_places(w, n), lambda i: of(w, i, n))

    return F.array_distinct(F.concat(runs(SHINGLE), *map(runs, short)) if short else runs(SHINGLE))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingle, hash, n_words, size, part), distinct; part: the size partition, floor(log2(size))."""
    w = F.col("_w")

    def runs(n: int) -> Column:
        return F.transform(_places(w, n), lambda i: F.struct(_shingle(w, i, n).alias("shingle"), _hash(w, i, n).alias("hash"), F.lit(n).alias("n_words")))

    own = runs(SHINGLE)
    for n in range(1, SHINGLE):
        own = F.when(F.size(w) == n, runs(n)).otherwise(own)
    split = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("_w")).select("item_id", F.explode_outer(own).alias("s"))
    one = split.select("item_id", "s.*").where("hash is not null").distinct()
    size = F.count("*").over(Window.partitionBy("item_id"))
    return one.withColumn("size", size).withColumn("part", F.floor(F.log2("size")).cast("int"))


def sketches(shingles: DataFrame) -> DataFrame:
    """(item_id, hash, part): the SKETCH smallest hashes of each item, those of more than SHARED items last."""
    often = shingles.groupBy("hash").agg(F.count("*").alias("_n")).where(F.col("_n") > SHARED).select("hash", F.lit(1).alias("_often"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("_often", F.lit(0)), "hash"))
    return shingles.join(often, "hash", "left").withColumn("_r", rank).where(F.col("_r") <= SKETCH).select("item_id", "hash", "part")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment) wherever at least CONTAINMENT of an item's shingles stand in a document.

    Words are lower-cased runs of letters, digits and characters beyond ASCII. An item of fewer than SHINGLE words is
    found where its words stand consecutively. Null texts and those without words are never found and never hold an item. Rows without an id are left out,
    as their finding could not be named. Each row of an id is judged on its own; the id has the highest
    containment of its rows. Other columns aren't read. Empty tables give an empty result.
    """
    shingles = checkpoint(item_shingles(items))
    short = tuple(sorted(r["n_words"] for r in shingles.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()))
    sketch = broadcast_if_small(checkpoint(sketches(shingles)), BROADCAST_ROWS)
    whole = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("_w"))
    hashed = whole.select("doc_id", "version", _runs(F.col("_w"), short, _hash).alias("_h"))
    rows = hashed.select("doc_id", "version", F.coalesce(F.floor(F.log2(F.size("_h") / CONTAINMENT)).cast("int"), F.lit(-1)).alias("_most"), F.explode_outer("_h").alias("hash"))
    found = checkpoint(rows.join(sketch, "hash").where("part <= _most").select("doc_id", "version", "item_id").distinct())
    named = broadcast_if_small(found.select("doc_id").distinct(), BROADCAST_ROWS)
    return _verified(whole.join(named, "doc_id", "left_semi"), found, shingles, short)


def _verified(texts: DataFrame, found: DataFrame, shingles: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """Exact containment of the candidates, over the words of the shingles."""
    w = F.col("_w")
    known = broadcast_if_small(shingles.select("item_id", "shingle", "size"), BROADCAST_ROWS)
    spots = texts.select("doc_id", "version", F.explode_outer(_runs(w, short, _shingle)).alias("shingle"))
    return (
        spots.join(known, "shingle")
        .join(found, ["doc_id", "version", "item_id"], "left_semi")
        .groupBy("doc_id", "version", "item_id", "size")
        .agg(F.count_distinct("shingle").alias("n"))
        .where(F.col("n") / F.col("size") >= CONTAINMENT)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.col("n") / F.col("size")).alias("containment"))
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Items of fewer than five words are one shingle of all their words (n of them).
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL
), i AS (
  SELECT item_id, w, least(len(w), 5) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT n FROM i
), have AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN lengths ON len(w) >= n)
), asked AS (
  SELECT DISTINCT item_id, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)
), size AS (
  SELECT item_id, count(*) AS n FROM asked GROUP BY item_id
)
SELECT doc_id, item_id, count(*) / any_value(n) AS containment
FROM have JOIN asked USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.8
"""
