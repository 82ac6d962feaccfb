"""Cross-document and author signals over (paper, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as lk
from .text import contains_any, matches


def emails(docs: DataFrame, distinct: bool = True) -> DataFrame:
    """(paper, email): the addresses of each paper, once each unless not distinct."""
    found = F.regexp_extract_all("text", F.lit(lk.EMAIL), F.lit(0))
    return docs.select("paper", F.explode(F.array_distinct(found) if distinct else found).alias("email"))


def shared_emails(edges: DataFrame) -> DataFrame:
    """(email, n_papers, first_paper, last_paper) of the addresses in more than one paper."""
    out = edges.distinct().groupBy("email").agg(F.count("*").alias("n_papers"), F.min("paper").alias("first_paper"), F.max("paper").alias("last_paper"))
    return out.where("n_papers > 1")


def cross_paper_signals(edges: DataFrame) -> DataFrame:
    """(email, paper, n_papers, status): the shared addresses with each of their papers, for a human to verify."""
    shared = shared_emails(edges).select("email", "n_papers")
    return edges.distinct().join(shared, "email").select("email", "paper", "n_papers", F.lit("NEEDS_HUMAN_VERIFICATION").alias("status"))


def patterned_names(edges: DataFrame) -> DataFrame:
    """(paper, n_emails, n_patterned, signal) of papers with two addresses or more of which two or more are a name and a number."""
    hit = F.col("email").rlike(lk.NAME_AND_NUMBER) | F.col("email").rlike(lk.ABBREVIATION_AND_NUMBER)
    out = edges.distinct().groupBy("paper").agg(F.count("*").alias("n_emails"), F.count_if(hit).alias("n_patterned"))
    return out.where("n_emails >= 2 and n_patterned >= 2").withColumn("signal", F.lit("MEDIUM"))


def papers_without_signal(docs: DataFrame, edges: DataFrame) -> DataFrame:
    return docs.select("paper").distinct().join(patterned_names(edges), "paper", "left_anti").join(cross_paper_signals(edges), "paper", "left_anti")


def roll_up(edges: DataFrame) -> DataFrame:
    """(paper, n_signals, kinds): both kinds of signals by paper."""
    a = patterned_names(edges).select("paper", F.lit("PATTERNED_NAMING").alias("kind"))
    b = cross_paper_signals(edges).select("paper", F.lit("CROSS_PAPER_EMAIL").alias("kind"))
    both = a.unionByName(b)
    return both.groupBy("paper").agg(F.count("*").alias("n_signals"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))


def domain_profile(edges: DataFrame) -> DataFrame:
    """(paper, total, suspicious, academic, signal): HIGH over half suspicious, MEDIUM over 30 %, LOW for some but under 30 % academic. Domains are looked for anywhere in the address."""
    odd, good = contains_any(F.col("email"), lk.SUSPICIOUS_DOMAINS), contains_any(F.col("email"), lk.ACADEMIC_DOMAINS)
    out = edges.groupBy("paper").agg(F.count("*").alias("total"), F.count_if(odd).alias("suspicious"), F.count_if(good).alias("academic"))
    rate = F.col("suspicious") / F.col("total")
    low = (F.col("academic") > 0) & (F.col("academic") < F.col("total") * 0.3)
    return out.withColumn("signal", F.when(rate > 0.5, "HIGH").when(rate > 0.3, "MEDIUM").when(low, "LOW").otherwise("CLEAN"))


def institution_rules(docs: DataFrame, chars: int = 5000) -> DataFrame:
    """(paper, institutions, mismatch): listed institutions in the first characters, and local hospitals that claim molecular work."""
    head = F.substring("text", 1, chars)
    listed = F.filter(F.array(*map(F.lit, lk.RETRACTED_INSTITUTIONS)), lambda x: F.contains(head, x))
    return docs.select("paper", F.array_join(listed, "|").alias("institutions"), (head.rlike(lk.LOCAL_HOSPITAL) & head.rlike(lk.MOLECULAR_WORK)).alias("mismatch"))


def without_doi(docs: DataFrame) -> DataFrame:
    """(paper, signal): LOW for papers without a DOI."""
    return docs.select("paper", F.when(~F.col("text").rlike(lk.DOI), "LOW").alias("signal"))


def authors(docs: DataFrame) -> DataFrame:
    """(paper, n_emails, authors_zh, authors_en, affiliations, dois)."""
    t = F.col("text")
    joined = lambda m: F.array_join(m, "|")
    return docs.select(
        "paper", F.size(F.regexp_extract_all("text", F.lit(lk.EMAIL), F.lit(0))).cast("long").alias("n_emails"),
        joined(matches(t, lk.LISTED_AUTHORS_ZH, 1)).alias("authors_zh"),
        joined(F.slice(matches(t, lk.LISTED_AUTHORS_EN, 1), 1, 20)).alias("authors_en"),
        joined(matches(t, lk.AFFILIATIONS, 1, True)).alias("affiliations"),
        joined(F.regexp_extract_all("text", F.lit(lk.DOI), F.lit(1))).alias("dois"),
    )
