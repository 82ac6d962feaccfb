"""The training-data pipeline over `documents`: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import decontaminate, language, mixing, secrets, simhash
from tallyglass.llm.common import broadcast_if_small, checkpoint, new_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids to drop are broadcast up to this number only; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Near-duplicates are linked by their fingerprints, and by this resemblance of their five-word shingles.
RESEMBLANCE = 0.8


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows with an id in `ids`; rows with a null id stay."""
    return docs.join(broadcast_if_small(checkpoint(ids), BROADCAST_IDS), "doc_id", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go (null and empty texts among them). lang stays as it was where it is known, else it is the prediction.

    Long texts count whole, equal cosines go to the first language by name, repeated rows and null ids each stay a row, an
    empty table gives an empty one. Of extra columns, whatever their names, only those of documents are kept.
    """
    found = language.identify(docs.select(*COLUMNS), COLUMNS).where(~F.col("lang_pred").eqNullSafe(language.UNKNOWN))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; repeated rows of an id count once.

    Null and empty texts are near-duplicates of each other; rows without an id always stay, as they can't be named. Long
    texts count whole, ties go to the smaller id, an empty table gives an empty one. Extra columns aren't kept.
    """
    docs = docs.select(*COLUMNS)
    found = checkpoint(simhash.near_duplicates(docs, RESEMBLANCE))
    kept = _without(docs, found.where("component_id < doc_id").select("doc_id").distinct())
    repeated = checkpoint(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = kept.join(broadcast_if_small(repeated, BROADCAST_IDS), "doc_id", "left_semi")
    return _without(kept, repeated).unionByName(again.dropDuplicates(["doc_id"]).select(*COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do rows without an id, which can't be named; all rows of an id go with
    the one that holds an item. Long texts count whole; empty tables drop nothing. Extra columns aren't kept.
    """
    docs = docs.select(*COLUMNS)
    return _without(docs, decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows.

    Texts without a secret, null and empty ones among them, stay as they are; repeated rows and null ids each stay a row;
    of overlapping spans one mark stands for all. An empty table gives an empty one. Extra columns aren't kept.
    """
    found, _ = secrets.findings(docs.select(*COLUMNS))
    some = F.size("spans") > 0
    text = F.when(some, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, in order of virtual time.

    Null and empty texts have no words and aren't taken; a null source is a source of its own; repeated rows and null ids
    are queued row by row, ties in a fixed order. The copy that the budget cuts has its first words only. An empty table gives an empty
    one. Extra columns aren't kept.
    """
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size"))
    return mixing.mixed_copies(sized).select(*COLUMNS, "copy", "words", "virtual_finish")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: No SQL: fingerprints and language profiles aren't SQL. tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; the stages' tables are in the shared folder (remove_written() of functions/storage.py removes them)."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
