"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by MD5 of seed and id), up to twice over. A
copy's virtual finish time is its source's cumulative words divided by the source's target; the mix is
all copies in that order, cut where the total budget is spent. As the targets add up to the budget, that
is virtual time 1, and the copy that spans it gives its first words only.

The running sums are taken in two levels, so that a source with a third of all rows is no single task:
within each of 4,096 hash ranges of a source, then over the sums of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN, checkpoint, table

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_REPEATS = 2
SEED = "mix-1"
_RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_key, source_size, target) of (source, source_size), one row a source.

    Weights repeat over the sources by code point, null last. Targets share SHARE_PERCENT of all words by
    weight, stop at MAX_REPEATS times the source's words, and the excess goes to the others by weight until
    none is above: with sources ordered by cap / weight, those whose cap lies below what the rest of the
    budget gives them are full. The window runs over one row a source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * MAX_REPEATS).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(SHARE_PERCENT / 100))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.sum("weight").over(after))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("rank_fill", "level"))).over(everything)["level"]
    return (
        filled.withColumn("rank_fill", F.row_number().over(by_fill))
        .withColumn("share", level)
        .select(
            _source_key(F.col("source")).alias("source_key"),
            "source_size",
            F.when(F.col("full") | F.col("share").isNull(), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("weight")).alias("target"),
        )
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, taken and virtual_start (of the first copy) as further columns.

    docs needs doc_id, source and size; all its other columns go along, but for those of the results' names. taken: the words of the copies that
    lie before virtual time 1. Ties in the shuffled order (repeated rows) are ordered by id and size, so
    reruns agree. A null id is shuffled as an empty one, a null size counts as 0, a source without words has
    target 0. An empty table gives an empty one.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = (
        docs.drop("source_size", "target", "taken", "virtual_start")
        .withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long"))
        .withColumn("_key", _source_key(F.col("source")))
        .withColumn("_order", order)
        .withColumn("_range", F.substring("_order", 1, _RANGE_DIGITS))
    )
    ranges = checkpoint(rows.groupBy("source", "_key", "_range").agg(F.sum("size").alias("_sum")))
    sizes = ranges.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    offsets = ranges.select(
        "_key", "_range", F.coalesce(F.sum("_sum").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")
    )
    offsets = offsets.join(targets(sizes, weights).withColumnRenamed("source_key", "_key"), "_key")
    within = Window.partitionBy("_key", "_range").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["_key", "_range"])
    start = F.col("_before") + F.col("_offset")
    whole = F.floor("target")
    given = [F.greatest(F.lit(0), F.least(F.col("size"), whole - start - F.col("source_size") * copy)) for copy in range(MAX_REPEATS)]
    return (
        queued.withColumn("taken", sum(given[1:], given[0]).cast("long"))
        .withColumn("virtual_start", F.when(F.col("target") > 0, start / F.col("target")))
        .drop("_key", "_order", "_range", "_before", "_offset")
    )


def mixed_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: one row a taken copy with its copy number, words and virtual_finish, range-sorted by that.

    Where docs has text, the copy that is cut has its first words only, with single spaces.
    """
    mixed = mix(docs, weights, seed)
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("copy")))
    if "text" in docs.columns:
        first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), 1, words.cast("int")), " ")
        copies = copies.withColumn("text", F.when(words < F.col("size"), F.when(words > 0, first_words)).otherwise(F.col("text")))
    finish = F.col("virtual_start") + (F.col("source_size") * F.col("copy") + F.col("size")) / F.col("target")
    return copies.withColumn("words", words).where("words > 0").withColumn("virtual_finish", finish).orderBy("virtual_finish", "doc_id", "copy")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(checkpoint(docs)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR))) AS o
  FROM documents
), s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CAST([3, 1, 2][CAST((ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight,
         source_size * 2 AS cap, ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) AS rk
  FROM s
), f AS (
  SELECT *, (CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5
             - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / SUM(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
         ROW_NUMBER() OVER (ORDER BY cap / weight, rk) AS rf
  FROM r
), g AS (
  SELECT *, cap <= lvl * weight AS is_full, MIN(CASE WHEN NOT cap <= lvl * weight THEN rf END) OVER () AS first_open FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN is_full OR first_open IS NULL THEN CAST(cap AS DOUBLE)
              ELSE (SELECT lvl FROM g AS h WHERE h.rf = g.first_open) * weight END AS target
  FROM g
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS whole,
         CAST(COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, whole - start)) + greatest(0, least(size, whole - start - source_size)) AS BIGINT) AS taken
FROM q
"""
