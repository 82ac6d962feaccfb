"""Text rules over (doc_id, text): number patterns, p values, declarations, phrases, identity, data types.

Patterns are prefixed with (?U), so that word characters and boundaries are Unicode's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as lk


def matches(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?Ui)" if ignore_case else "(?U)") + pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.size(matches(text, pattern)).cast("long")


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_alias(text: Column, aliases, longest: bool = False) -> Column:
    """The name of the first alias that the lower-cased text contains; of the longest with `longest`."""
    low = F.lower(F.trim(text))
    order = sorted(aliases, key=lambda a: -len(a[0])) if longest else aliases
    out = F.when(F.lit(False), F.lit(""))
    for alias, name in order:
        out = out.when(F.contains(low, F.lit(alias)), name)
    return out


def decimal_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, digits, total, tail, freq, signal): the commonest tail of the decimals with `digits` places, where there are 10 or more.

    HIGH over half, MEDIUM over 30 %; CLEAN is only reported up to 2 places. Ties go to the tail that comes first.
    """
    tails = docs.select("doc_id", F.posexplode(matches(F.col("text"), lk.DECIMAL, 2)).alias("at", "tail"))
    by = tails.groupBy("doc_id", F.length("tail").alias("digits"), "tail").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    out = by.groupBy("doc_id", "digits").agg(F.sum("c").alias("total"), F.max(F.struct(F.col("c"), -F.col("first"), F.col("tail"))).alias("b")).where("total >= 10")
    share = F.col("b")["c"] / F.col("total")
    out = out.select("doc_id", "digits", "total", F.col("b")["tail"].alias("tail"), F.col("b")["c"].alias("freq"), F.when(share > 0.5, "HIGH").when(share > 0.3, "MEDIUM").otherwise("CLEAN").alias("signal"))
    return out.where("signal <> 'CLEAN' or digits <= 2")


def p_value_format(docs: DataFrame) -> DataFrame:
    """How p values are printed: zero values (L2), thresholds only (L1)."""
    t = F.col("text")
    out = docs.select(
        "doc_id",
        count(t, lk.P_EXACT_ZERO).alias("exact_zero"), count(t, lk.P_BELOW_ZERO).alias("below_zero"), count(t, lk.P_THRESHOLD).alias("thresholds"),
        count(t, lk.P_EXACT).alias("exact"), count(t, lk.P_PRECISE).alias("precise"), count(t, lk.SIGNIFICANT_WORD).alias("significant"),
    )
    level = F.when((F.col("exact_zero") > 0) | (F.col("below_zero") > 0), "L2").when((F.col("thresholds") > 5) & (F.col("exact") == 0), "L1")
    return out.withColumn("no_precise", (F.col("thresholds") > 5) & (F.col("exact") == 0)).withColumn("level", level)


def duplicate_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, n, n_unique, repeated, signal): the share of numbers of 3 digits or more that the 20 commonest repeated ones make up; of 10 or more."""
    numbers = matches(F.col("text"), lk.NUMBER, 1)
    long = F.filter(numbers, lambda x: F.length(F.replace(x, F.lit("."), F.lit(""))) >= 3)
    some = docs.select("doc_id", F.explode(long).alias("x"))
    by = some.groupBy("doc_id", "x").agg(F.count("*").alias("c"))
    out = by.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.sort_array(F.collect_list(F.when(F.col("c") >= 2, F.col("c"))), False).alias("top")).where("n >= 10")
    repeated = F.aggregate(F.slice("top", 1, 20), F.lit(0).cast("long"), lambda a, x: a + x)
    rate = F.col("repeated") / F.col("n")
    return out.select("doc_id", "n", "n_unique", repeated.alias("repeated")).withColumn("signal", F.when(rate > 0.3, "HIGH").when(rate > 0.15, "MEDIUM").otherwise("CLEAN"))


def language(text: Column) -> Column:
    """zh with over 50 CJK characters among the first 1000, else en."""
    return F.when(F.regexp_count(F.substring(text, 1, 1000), F.lit("[一-鿿]")) > 50, "zh").otherwise("en")


def tortured_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, abnormal, usual, confidence, start, end, context) of the phrases in dictionary order, without overlaps; places in characters from 0.

    Only texts that contain a phrase leave the JVM; there an earlier phrase's places shut out later ones.
    """
    schema = "doc_id long, abnormal string, usual string, confidence string, start int, end int, context string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                taken: list[tuple[int, int]] = []
                for odd, usual, sure in lk.TORTURED_PHRASES:
                    for m in re.finditer(re.escape(odd), text):
                        if all(m.end() <= a or m.start() >= b for a, b in taken):
                            taken.append(m.span())
                            out.append({"doc_id": doc, "abnormal": odd, "usual": usual, "confidence": sure, "start": m.start(), "end": m.end(), "context": text[max(0, m.start() - 40) : m.end() + 40]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("abnormal", pa.string()), ("usual", pa.string()), ("confidence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string())]))

    with_one = docs.where(contains_any(F.col("text"), [p for p, _, _ in lk.TORTURED_PHRASES]))
    return with_one.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def tortured_risk(phrases: DataFrame) -> DataFrame:
    """(doc_id, n, n_high, risk): HIGH from 5 sure phrases, MEDIUM from 3 of any kind, else LOW."""
    out = phrases.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("n_high"))
    return out.withColumn("risk", F.when(F.col("n_high") >= 5, "HIGH").when(F.col("n") >= 3, "MEDIUM").otherwise("LOW"))


def declarations(docs: DataFrame) -> DataFrame:
    """(doc_id, line, kind, method): statistical declarations of each line, the first line of each software name, the first p threshold (line 0)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select("doc_id", (F.col("i") + 1).alias("line"), F.trim("raw").alias("raw")).where("raw <> ''")
    tagged = lambda k: lambda m: F.struct(F.lit(f"method{k}").alias("kind"), m.alias("method"))
    found = F.flatten(F.array(*[F.transform(matches(F.col("raw"), p, 0, True), tagged(k)) for k, p in enumerate(lk.DECLARATIONS, 1)]))
    named = lines.select("doc_id", "line", F.inline(found))
    software = lines.select("doc_id", "line", F.explode(F.filter(F.array(*map(F.lit, lk.SOFTWARE)), lambda s: F.contains(F.lower("raw"), F.lower(s)))).alias("s"))
    first = software.groupBy("doc_id", "s").agg(F.min("line").alias("line")).select("doc_id", "line", F.lit("software").alias("kind"), F.col("s").alias("method"))
    p = F.regexp_extract("text", lk.P_DECLARED, 1)
    threshold = docs.select("doc_id", F.lit(0).alias("line"), F.lit("threshold").alias("kind"), p.alias("method")).where("method <> ''")
    return named.unionByName(first).unionByName(threshold)


def method_suitability(declared: DataFrame) -> DataFrame:
    """declared (data_type, method text) with the normalised method and HIGH (wrong), LOW (acceptable) or null.

    The lists' own names are normalised as well, so that "t检验" is the independent-samples test in both.
    """
    known = dict(lk.METHOD_ALIASES)

    def standard(name: str) -> str:
        low = name.lower()
        return known.get(low) or next((v for k, v in lk.METHOD_ALIASES if k in low), name)

    def map_of(which: int) -> Column:
        return F.create_map(*[x for k, v in lk.SUITABILITY.items() for x in (F.lit(k), F.array(*map(F.lit, sorted({standard(n) for n in v[which]} | set(v[which])))).cast("array<string>"))])

    out = declared.withColumn("normal", first_alias(F.col("method"), lk.METHOD_ALIASES))
    in_list = lambda k: F.coalesce(F.array_contains(F.try_element_at(map_of(k), F.col("data_type")), F.col("normal")), F.lit(False))
    return out.withColumn("severity", F.when(in_list(0), F.lit(None)).when(in_list(2), "HIGH").when(in_list(1), "LOW"))


def premises(docs: DataFrame) -> DataFrame:
    """Premises of declared methods: normality, equal variances, group sizes below 3 and below 5, inferred data type."""
    t, low = F.col("text"), F.lower("text")
    n = F.transform(matches(t, lk.GROUP_SIZE, 1), lambda x: x.try_cast("long"))
    t_test = contains_any(low, lk.T_TEST_WORDS)
    anova = contains_any(low, lk.ANOVA_WORDS)
    words = F.filter(F.array(*map(F.lit, lk.STATISTICAL_WORDS)), lambda w: F.contains(low, F.lower(w)))
    out = docs.select("doc_id", t_test.alias("t_test"), anova.alias("anova"), words.alias("words"), F.slice(n, 1, 10).alias("n_values"), F.exists(n, lambda x: x < 3).alias("below_3"), t.alias("_t"), low.alias("_l"))
    infer = F.when(F.lit(False), "")
    for kind, some in lk.INFERRED_TYPES:
        infer = infer.when(contains_any(F.col("_l"), some), kind)
    infer = infer.otherwise("unknown")
    small = F.filter("n_values", lambda x: x < 5)
    return out.select(
        "doc_id", F.array_join("words", "|").alias("words"), F.array_join(F.col("n_values").cast("array<string>"), "|").alias("n_values"),
        F.when(F.col("t_test") & ~F.contains("_t", F.lit(lk.NORMALITY_WORD)), "MEDIUM").alias("normality"),
        F.when(F.col("anova") & ~contains_any(F.col("_l"), lk.EQUAL_VARIANCE_WORDS), "MEDIUM").alias("homoscedasticity"),
        F.when(F.col("t_test") & F.coalesce("below_3", F.lit(False)), "HIGH").alias("too_few"),
        F.when((F.size(small) > 0) & F.exists("words", lambda w: F.contains(F.lower(w), F.lit("t"))), F.array_min(small)).alias("small_n"),
        F.try_to_number(F.nullif(F.regexp_extract("_t", "(?U)" + lk.P_LIMIT, 1), F.lit("")), F.lit("9.9999999999")).cast("double").alias("p_threshold"),
        infer.alias("data_type"),
    )


def conclusions(docs: DataFrame, statements: int = 10, others: int = 5) -> DataFrame:
    """(doc_id, severity, kind, text): claims of significance (INFO), p values against their wording (HIGH), claims for all time points (MEDIUM).

    The limits are a report's: 10 for each kind of statement, 5 contradictions, 5 sweeping claims.
    """
    t = F.col("text")
    kinds = [("INFO", k, F.slice(matches(t, p), 1, statements)) for k, p in (("significant", lk.SIGNIFICANT), ("not_significant", lk.NOT_SIGNIFICANT), ("effect", lk.MARKED_EFFECT))]
    kinds.append(("HIGH", "contradiction", F.slice(F.concat(matches(t, lk.CONTRADICTION_LOW), matches(t, lk.CONTRADICTION_HIGH)), 1, others)))
    kinds.append(("MEDIUM", "sweeping", F.slice(matches(t, lk.SWEEPING), 1, others)))
    tagged = lambda s, k: lambda x: F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), x.alias("text"))
    rows = F.flatten(F.array(*[F.transform(m, tagged(s, k)) for s, k, m in kinds]))
    return docs.select("doc_id", F.inline(rows))


def mean_sd_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, n, first_pairs): printed mean ± deviation pairs and the first five."""
    p = lk.MEAN_SD
    m, s = matches(F.col("text"), p, 1), matches(F.col("text"), p, 2)
    five = F.transform(F.slice(F.arrays_zip(m.alias("m"), s.alias("s")), 1, 5), lambda x: F.concat_ws("±", x["m"], x["s"]))
    return docs.select("doc_id", F.size(m).cast("long").alias("n"), F.array_join(five, "|").alias("first_pairs"))


def data_type(docs: DataFrame) -> DataFrame:
    """(doc_id, data_type, has_wb, has_bar_chart, is_trial, has_mean_sd, has_funding, layer1..layer5): a cascade of key words, and the layers' coverage."""
    t, low = F.col("text"), F.lower("text")
    head = lambda n, c: F.substring(c, 1, n)
    review = contains_any(head(lk.REVIEW_CHARS, t), lk.REVIEW_WORDS)
    survey = ~review & contains_any(head(lk.SURVEY_CHARS, t), lk.SURVEY_WORDS)
    geo = ~review & ~survey & contains_any(low, lk.GEO_WORDS)
    wb = ~review & ~survey & ~geo & contains_any(low, lk.WET_LAB_WORDS)
    bar = contains_any(low, lk.BAR_CHART_WORDS)
    trial = contains_any(head(lk.TRIAL_CHARS, low), lk.TRIAL_WORDS)
    mean_sd = t.rlike(lk.MEAN_SD_SIGN) | low.rlike(lk.MEAN_SD_WORDS)
    funding = t.rlike(lk.GRANT_NUMBER) & contains_any(low, lk.FUNDING_WORDS)
    kind = F.when(review, "review").when(survey, "survey").when(geo, "geo_data").when(wb, "wet_lab").when(bar, "bar_chart").when(trial, "clinical_trial").when(mean_sd, "clinical_table").otherwise("unknown")
    table = F.create_map(*[x for k, v in lk.COVERAGE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = docs.select("doc_id", kind.alias("data_type"), wb.alias("has_wb"), bar.alias("has_bar_chart"), trial.alias("is_trial"), mean_sd.alias("has_mean_sd"), funding.alias("has_funding"))
    layers = F.coalesce(F.try_element_at(table, F.col("data_type")), F.array(*map(F.lit, lk.OTHER_COVERAGE)))
    return out.select("*", *[F.get(layers, F.lit(i)).alias(f"layer{i + 1}") for i in range(5)])


def fallback_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, contradiction, direction, difference): the three short contradiction rules."""
    t = F.col("text")
    return docs.select("doc_id", *[t.rlike("(?U)" + r).alias(n) for n, r in lk.SHORT_RULES])


def identity(docs: DataFrame) -> DataFrame:
    """(doc_id, language, doi, authors, first_author, corresponding, institution, journal, funding) from the text of a paper's first pages."""
    t = F.col("text")
    one = lambda p, g=1, c=t: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    zh = language(t) == "zh"
    doi = F.regexp_replace(one(lk.DOI_FIELD), "[.,;]+$", "")
    zh_raw = F.regexp_replace(one(lk.AUTHORS_ZH), lk.AUTHOR_MARKS, "")
    zh_authors = F.filter(F.split(zh_raw, lk.AUTHOR_GAP_ZH), lambda a: F.length(F.trim(a)) >= 2)
    listed = one(lk.AUTHORS_EN, 1, F.substring(t, 1, 3000))
    named = F.filter(F.transform(F.split(listed, lk.AUTHOR_GAP_EN), lambda a: F.regexp_replace(F.trim(a), "[,.]+$", "")), lambda a: F.length(a) > 2)
    line = one(lk.CAPITAL_AUTHORS, 0)
    capital = F.transform(F.filter(F.split(F.regexp_replace(line, r"\d{1,2}", ""), lk.CAPITAL_GAP), lambda a: F.length(F.trim(a)) > 3), lambda a: F.initcap(F.trim(a)))
    en_authors = F.when(F.size(named) > 0, named).otherwise(capital)
    corr_zh = F.coalesce(F.trim(one(lk.CORRESPONDING_ZH)), F.array_join(F.array_distinct(matches(F.substring(t, 1, 2000), lk.STARRED_ZH, 1)), "|"))
    corr_line = one(lk.CORRESPONDING_EN)
    stars = F.filter(matches(F.substring(t, 1, 2000), lk.STARRED_EN, 1), lambda c: F.length(c) > 3)
    corr_en = F.when(corr_line.isNotNull(), F.trim(F.regexp_replace(corr_line, r"\S+@\S+", ""))).otherwise(F.array_join(F.array_distinct(stars), "|"))
    inst_zh = one(lk.INSTITUTION_ZH, 0)
    inst_en = one(lk.INSTITUTION_EN, 0, F.substring(t, 1, 3000))
    top = F.substring(t, 1, 500)
    journal = F.coalesce(F.trim(one(lk.JOURNAL_VOLUME, 1, top)), F.trim(one(lk.JOURNAL_NAME, 0, top)))
    lines = F.slice(matches(t, lk.FUNDING_LINE, 1, True), 1, 3)
    funding = F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda x: matches(x, lk.FUNDING_NUMBER, 1)))))
    authors = F.coalesce(F.when(zh, zh_authors).otherwise(en_authors), F.array().cast("array<string>"))
    out = docs.select(
        "doc_id", F.when(zh, "zh").otherwise("en").alias("language"), doi.alias("doi"), authors.alias("_a"),
        F.nullif(F.when(zh, corr_zh).otherwise(corr_en), F.lit("")).alias("corresponding"), F.substring(F.trim(F.when(zh, inst_zh).otherwise(inst_en)), 1, 200).alias("institution"),
        F.when(~zh, journal).alias("journal"), F.array_join(funding, "|").alias("funding"),
    )
    return out.select("doc_id", "language", "doi", F.array_join("_a", "|").alias("authors"), F.get("_a", F.lit(0)).alias("first_author"), "corresponding", "institution", "journal", "funding")


def _sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, table_id, body): the text after each table title up to the next; section 0 is what precedes the first."""
    titles, bodies = matches(F.col("text"), lk.TABLE_TITLE), F.split("text", "(?U)" + lk.TABLE_TITLE, -1)
    return docs.select("doc_id", titles.alias("_n"), F.posexplode(bodies).alias("section", "body")).select(
        "doc_id", "section", F.when(F.col("section") > 0, F.get("_n", F.col("section") - 1)).otherwise(lk.NO_TABLE).alias("table_id"), "body"
    )


def _with_deviations(body: Column) -> Column:
    """The body if it has a ± at all, else an empty text: the row patterns backtrack over long names."""
    return F.when(F.contains(body, F.lit("±")), body).otherwise("")


def table_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, table_id, group_raw, group_name, mean, sd): printed mean ± deviation rows by table and normalised group."""
    b = _with_deviations(F.col("body"))
    zipped = F.arrays_zip(matches(b, lk.GROUP_ROW, 1).alias("g"), matches(b, lk.GROUP_ROW, 2).alias("m"), matches(b, lk.GROUP_ROW, 3).alias("s"))
    rows = _sections(docs).select("doc_id", "table_id", F.inline(zipped)).withColumn("g", F.trim(F.regexp_replace("g", r"^\s+|\s+$", "")))
    return rows.select("doc_id", "table_id", F.col("g").alias("group_raw"), F.coalesce(first_alias(F.col("g"), lk.GROUP_ALIASES), F.col("g")).alias("group_name"), F.col("m").cast("double").alias("mean"), F.col("s").cast("double").alias("sd"))


def table_series(docs: DataFrame) -> DataFrame:
    """(doc_id, label, t, y): rows of three or more mean ± deviation values after a table title, at times 0, 1, 2, ..."""
    b = _with_deviations(F.col("body"))
    rows = _sections(docs).where("section > 0").select("doc_id", "table_id", F.inline(F.arrays_zip(matches(b, lk.SERIES_ROW, 1).alias("g"), matches(b, lk.SERIES_ROW, 2).alias("d"))))
    label = F.concat("g", F.lit("("), "table_id", F.lit(")"))
    return rows.select("doc_id", label.alias("label"), F.posexplode(matches(F.col("d"), lk.MEAN_SD, 1)).alias("t", "y")).select("doc_id", "label", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
