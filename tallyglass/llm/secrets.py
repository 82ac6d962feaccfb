"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds the findings of each (blob,
rule version) pair that was ever scanned; only unseen pairs are scanned, one text a blob, and the findings
are joined back to all paths (rows) that hold the blob.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, new_path, table

RULE_VERSION = "2"
#: Findings are broadcast while they have so many spans at most (12 bytes a span, 32 a blob); beyond that the join shuffles.
BROADCAST_SPANS = 500_000
#: (kind, pattern, what must stand in the text for a match, group and its least length) in the order spans sort in.
#: The first three patterns are fixed values: assign keeps matches whose group 2 has 6 characters or more; for
#: access and hex the least lengths of 20 and 24 characters stand in the pattern.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("=", ":"), 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", ("AKIA",), 0, 0),
    ("hex", r"[0-9a-f]{24,}", (), 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",), 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",), 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("-----BEGIN",), 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",), 0, 0),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<start:int,rank:int,end:int>>"
LEDGER = f"blob binary, spans {SPANS}, rule_version string"


def _kind_spans(text: Column, rank: int) -> Column:
    """Spans (code points, end exclusive) of one kind: the pieces between matches give the places."""
    _, pattern, needs, group, least = RULES[rank]
    inner = F.col("_t")
    pieces, found = F.split(inner, pattern, -1), F.regexp_extract_all(inner, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(inner, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"), kept.alias("group"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPANS).alias("none"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + F.length(r["gap"])
        end = start + F.length(r["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), a["none"].alias("none"), F.when(F.length(r["group"]) >= least, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    can = F.lit(True)
    if needs:
        can = F.lit(False)
        for x in needs:
            can = can | F.contains(inner, F.lit(x))
    return F.when(can & inner.rlike(pattern), F.aggregate(rows, zero, step, lambda a: a["out"])).otherwise(F.array().cast(SPANS))


def with_spans(blobs: DataFrame) -> DataFrame:
    """blobs (with text) with spans in place of text: all kinds, sorted by start, then kind as listed."""
    found = blobs.withColumn("_t", F.coalesce("text", F.lit("")))
    for rank in range(len(RULES)):
        found = found.withColumn(f"_s{rank}", _kind_spans(F.col("_t"), rank))
    every = F.array_sort(F.flatten(F.array(*[F.col(f"_s{k}") for k in range(len(RULES))])))
    return found.withColumn("spans", every).drop("text", "_t", *[f"_s{k}" for k in range(len(RULES))])


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans): one for each blob of docs that `ledger` lacks at this rule version.

    docs may hold every version of a path, one row each; a version that came back is not scanned again.

    Copies meet once a blob and map task before the shuffle, so a text that a third of the rows share is one row
    from each task.
    """
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    one = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return with_spans(one).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(docs with spans as a further column, the new ledger rows).

    Null texts count as empty. Every row gets its blob's spans, so repeated rows, null ids and copies each give a
    row; other columns go along. Blobs without findings stay in the ledger, but only those with findings are
    joined back. Repeated ledger rows count once. An empty table gives empty ones.
    """
    new = checkpoint(scan_unseen(docs, ledger, rule_version))
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"]).select(new.columns))
    hits = known.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    if (hits.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        hits = F.broadcast(hits)
    joined = docs.withColumn("_id", blob_id(F.col("text"))).join(hits, F.col("_id") == F.col("_blob"), "left")
    return joined.withColumn("spans", F.coalesce("_spans", F.array().cast(SPANS))).drop("_id", "_blob", "_spans"), new


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger stored at path, by rule version; None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(docs: DataFrame, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """findings() of docs by the ledger stored at path, to which the new rows are added.

    The rows to add are checkpointed before they are written, so a lost executor repeats no scan; a run that breaks off
    before it ends leaves the ledger as it was or with all its rows.
    """
    found, new = findings(docs, read_ledger(docs.sparkSession, path), rule_version)
    new.select("blob", "spans", "rule_version").write.mode("append").partitionBy("rule_version").parquet(path)
    return found


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by the mark; overlapping spans by one mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = text.substr(a["at"] + 1, s["start"] - a["at"])
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """The findings of all documents; the ledger is a new one in the shared folder, so that a result never hangs on earlier runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, new_path(spark, "secret-ledger"))
    kinds = F.array(*[F.lit(r[0]) for r in RULES])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql() -> str:
    """Matches of every kind; their places are the lengths of the pieces and matches before them."""
    kinds = []
    for rank, (kind, pattern, _, group, least) in enumerate(RULES):
        p = _text(pattern)
        kinds.append(
            f"SELECT doc_id, {rank} AS kind_rank, '{kind}' AS kind, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, "
            f"regexp_extract_all(text, {p}, {group}) AS groups, {least} AS least FROM t WHERE regexp_matches(text, {p})"
        )
    return (
        "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (" + " UNION ALL ".join(kinds) + "), "
        "e AS (SELECT doc_id, kind_rank, kind, gaps, hits, groups, least, unnest(range(1, len(hits) + 1)) AS i FROM m), "
        "p AS (SELECT doc_id, kind_rank, kind, length(hits[i]) AS n, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s "
        "FROM e WHERE length(groups[i]) >= least), "
        "a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, "
        f"string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, kind_rank) FILTER (WHERE kind_rank < {len(BASE_KINDS)}) AS base, "
        "string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, kind_rank) AS spans FROM p GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"
    )


OP5_SQL = _sql()
