"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import checkpoint, new_path, remove_written, shared_dir, temporary, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters, digits and everything beyond ASCII (after lower-casing).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
KELVIN, REPLACEMENT = "\u212a", "\ufffd"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast only where a count proves at most max_rows rows; otherwise the join shuffles. df: cheap to count (a checkpoint)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def pieces(text: Column, separator: str) -> Column:
    """What stands between separators, without empty pieces; none for null. Splitting is several times as fast as extracting the words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator, -1), "")


def words(text: Column) -> Column:
    """Words of the lower-cased whole text; none for null.

    The Kelvin sign, the one character beyond ASCII whose lower case is an ASCII word of its own, is replaced before, so
    that ASCII words are equal exactly where they are with A-Z alone lower-cased.
    """
    return pieces(F.lower(F.replace(text, F.lit(KELVIN), F.lit(REPLACEMENT))), SEPARATOR)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text leaves `part`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
