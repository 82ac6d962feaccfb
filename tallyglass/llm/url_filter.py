"""URL filters: host-suffix and path-prefix expressions, joined to the rules by short hash prefixes.

Each distinct (host, path) becomes one expression for every host suffix and path prefix of a length that
some rule has, so the number of expressions a URL is bounded by the rules' lengths, not by the URL. The
first 32 bits of an expression's SHA-256 are the join key; the full digest then confirms, and precedence
picks one rule. Rules are broadcast only while their number is at most BROADCAST_RULES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, table

BROADCAST_RULES = 50_000
#: The rules of the contract as (host, path, verdict).
BASE_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: The method's own rules where no list is given (read_rules), which decide where no base rule fits; an empty path fits all.
EXTRA_RULES = (
    ("ads-track.example.org", "", "block"),
    ("ads-track.example.com", "", "block"),
    ("ads-track.example.net", "", "block"),
    ("spam-farm.example.org", "", "block"),
    ("spam-farm.example.com", "", "block"),
    ("spam-farm.example.net", "", "block"),
    ("cheap-pills.example.com", "", "block"),
    ("cheap-pills.example.net", "", "block"),
    ("cheap-pills.example.org", "", "block"),
)
DEFAULT = "allow"
_KEY_DIGITS = 8
RULES = "tier int, host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, lower-cased; empty for null or without ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def default_rules(spark) -> DataFrame:
    rows = [(0, *r) for r in BASE_RULES] + [(1, *r) for r in EXTRA_RULES]
    return spark.createDataFrame(rows, RULES)


def read_rules(spark, path: str) -> DataFrame:
    """The base rules and those of a list: Parquet, or CSV without a header, of (host, path, verdict). Rows without a host or with another verdict don't count; hosts are lower-cased, leading dots and stars go, a null path fits all."""
    csv = path.endswith((".csv", ".txt"))
    rows = spark.read.csv(path, schema="host string, path string, verdict string") if csv else spark.read.parquet(path).select("host", "path", "verdict")
    host = ascii_lower(F.regexp_replace(F.trim("host"), r"^[*.]+", ""))
    listed = rows.select(F.lit(1).alias("tier"), host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict"))
    base = spark.createDataFrame([(0, *r) for r in BASE_RULES], RULES)
    return base.unionByName(listed.where("host <> '' and verdict in ('allow', 'block')").distinct())


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict as further columns (they replace columns of these names).

    rules: (tier, host, path, verdict), a host in lower case. A rule fits its host and all subdomains where the
    URL's path starts with the rule's. The lowest tier wins, in it the longest host + path, then the longer host,
    then block. rule: host + path of the winner if it is of tier 0, else null. verdict: the winner's, else
    `default`. A null URL or one without :// has empty host and path; an empty host fits no rule. Repeated rows
    each give a row.
    """
    parted = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    keyed = rules.where("host <> ''").withColumn("digest", F.sha2(F.concat("host", "path"), 256))
    lengths = keyed.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("h"), F.collect_set(F.length("path")).alias("p")).first()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(lengths["h"])]).cast("array<int>"), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(lengths["p"])]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.col("path").substr(F.lit(1), n),
    )
    expressions = (
        parted.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("_s"), prefixes.alias("_p"))
        .select("host", "path", "_s", F.explode("_p").alias("_x"))
        .withColumn("_digest", F.sha2(F.concat("_s", "_x"), 256))
        .select("host", "path", "_digest", F.substring("_digest", 1, _KEY_DIGITS).alias("_key"))
    )
    index = broadcast_if_small(
        keyed.select(
            F.substring("digest", 1, _KEY_DIGITS).alias("_key"),
            "digest",
            F.struct((-F.col("tier")).alias("tier"), F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.col("verdict").alias("verdict"), F.concat("host", "path").alias("rule")).alias("_rule"),
        ),
        BROADCAST_RULES,
    )
    best = expressions.join(index, "_key").where("_digest = digest").groupBy("host", "path").agg(F.max("_rule").alias("_best"))
    # what has no host fits no rule: all such rows have one key, which the join needn't gather
    judged = parted.where("host <> ''").join(best, ["host", "path"], "left")
    nowhere = parted.where("host = ''").withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType))
    return (
        judged.unionByName(nowhere)
        .withColumn("rule", F.when(F.col("_best.tier") == 0, F.col("_best.rule")))
        .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default)))
        .drop("_best")
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
), c AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches('.' || host, '\.(ads-track|spam-farm|cheap-pills)\.example\.(org|com|net)$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM c
"""
