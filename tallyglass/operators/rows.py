"""Row and block detectors over wide rows (source, idx, columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions.relational import chunked


def row_key(columns: list[str]) -> Column:
    return F.concat_ws("|", *[num.general10(F.col(c).cast("double"), True) for c in columns])


def block_duplication(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Repeated rows (values rounded to 6 places): 3 or more and over 30 %, of 4 rows and 2 columns or more."""
    by = rows.groupBy("source", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]).count()
    out = by.groupBy("source").agg(F.sum("count").alias("n"), F.count("*").alias("n_unique")).withColumn("dups", F.col("n") - F.col("n_unique"))
    z = num.binomial_z(F.col("n_unique"), F.col("n"), 0.5)
    flagged = F.lit(len(columns) >= 2) & (F.col("n") >= 4) & (F.col("dups") >= 3) & (F.col("dups") > 0.3 * F.col("n"))
    return out.select("source", "n", "n_unique", "dups", z.alias("z"), flagged.alias("flagged"))


def identical_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that print the same: 3 repeats or more in all and a group of 3 or more."""
    by = rows.groupBy("source", row_key(columns).alias("key")).agg(F.count("*").alias("c"))
    out = by.groupBy("source").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("dups"), F.max("c").alias("largest"), F.count_if(F.col("c") >= 2).alias("groups"))
    return out.select("source", "n", "dups", "largest", "groups", num.binomial_z(F.col("dups"), F.col("n"), 0.01).alias("z"), ((F.col("dups") >= 3) & (F.col("largest") >= 3)).alias("flagged"))


def identical_row_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The repeated rows themselves: (source, key, c, first, last)."""
    by = rows.groupBy("source", row_key(columns).alias("key")).agg(F.count("*").alias("c"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    return by.where("c >= 2")


def identical_blocks(rows: DataFrame, columns: list[str], sizes: tuple[int, ...] = (3, 4, 5), chunk: int = 1 << 16) -> DataFrame:
    """Runs of k rows that appear twice or more in a source (overlaps count), of 2k rows or more.

    (source, k, n, blocks, occurrences, max_occurrences, flagged). Sliding windows don't need a whole source in one
    task: rows are cut into chunks of `chunk` places, and each chunk also gets the max(k) - 1 rows that follow.
    """
    most = max(sizes) - 1
    keyed = rows.select("source", "idx", row_key(columns).alias("key"))
    spread = chunked(keyed, most, chunk)
    w = Window.partitionBy("source", "chunk").orderBy("idx")
    ahead = [F.lead("key", j).over(w) for j in range(1, max(sizes))]
    cols = [F.col("key"), *ahead]
    windows = spread.select("source", "home", "chunk", *[F.when(cols[k - 1].isNotNull(), F.concat_ws("\n", *cols[:k])).alias(f"w{k}") for k in sizes]).where("home = chunk")
    long = windows.select("source", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("block")) for k in sizes]))).where("block is not null")
    by = long.groupBy("source", "k", "block").agg(F.count("*").alias("c"))
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    again = F.col("c") >= 2
    out = by.groupBy("source", "k").agg(F.count_if(again).alias("blocks"), F.sum(F.when(again, F.col("c")).otherwise(0)).alias("occurrences"), F.max("c").alias("max_occurrences"))
    return out.join(n, "source").select("source", "k", "n", "blocks", "occurrences", "max_occurrences", ((F.col("n") >= 2 * F.col("k")) & (F.col("blocks") > 0)).alias("flagged"))
