"""Queries of the text and cross-document rules.

The driver's documents have no Chinese text, p values or mean ± deviation rows, so each rule also meets a few
literal papers beside them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as lk
from ..operators import crossdoc, text
from . import review
from .catalog import query

PAPERS = (
    "采用t检验进行比较。差异有统计学意义(P<0.05)。差异无统计学意义(P<0.05)。n=2, n=12。P=0.000 P = 0.000 P=0.0001",
    "ANOVA and chi-square were used; P<0.05, P<0.01, P<0.05, P<0.001, P < 0.05, P<0.05; n=6; mean 1.20 ± 0.30 and 2.25±0.10",
    "Age 12.34 15.34 18.34 21.34 12.34 15.34 18.34 21.34 12.34 15.34 18.34 7.5 8.5 9.5 1234 1234 1234 5678 5678 4321",
    "各组比较采用单因素方差分析，方差齐性检验。数据以 x̄±s 表示。各时间点均显著(P<0.05)。明显升高(P<0.01)。正态分布",
    "Review of western blot methods. 支撑向量机 and 西方印记 in 深刻学习. Kaplan-Meier curves; Funding: 1234567 grant",
    "Randomized clinical trial with bar chart. Pearson correlation, n=4. doi:10.1234/abc.def. contact zhangsan66@qq.com lxj068@163.com",
    "某县人民医院 细胞转染 基因敲除 临沂市人民医院 ymh3011@163.com zhangsan66@qq.com someone@uni.edu",
    "统计学差异 P > 0.05 差异具有统计学意义 P>0.05 问卷调查 geo accession GSE1 卡方检验 生存",
    "ONCOLOGY LETTERS 22: 13001, 2021\nAuthors: Anna Berg1, Carl Dorn2, Eva Falk and others\nCorrespondence to: Anna Berg a.berg@uni.edu\nDepartment of Medicine, University of Somewhere\ndoi: 10.1234/xyz.5.\nFunding: grants 1234567 and 7654321",
    "YANYI LI1, HUIHUI KE1, RUI ZHANG1, JIANLONG ZHU1 and MINGHUA YU2 on repeated values",
    "作者：张三1，李四2；王五\n通讯作者：张三 电话\n单位：某某大学附属医院 内科\n基金项目：国家自然科学基金 81234567\n" + "本研究采用回顾性方法收集病例并对数据进行整理" * 3,
)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def papers(read):
    spark = read("documents").sparkSession
    made = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(PAPERS)], "doc_id long, text string").coalesce(1)
    return read("documents").select("doc_id", "text").unionByName(made)


_PAPERS = "papers AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {sql_text(t)})" for i, t in enumerate(PAPERS)) + ") v(doc_id, text))"
_WITH = f"WITH {_PAPERS}"
#: What Java's Unicode word boundary is, for RE2: neither side may be a letter, digit or underscore of any script.
_EDGE = r"(?:^|[^\pL\pN\pM_.])"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {sql_text(pattern)}))"


@query(
    "pvalue_format",
    f"{_WITH}, q AS (SELECT doc_id, {_count('P[ \\t\\n]*=[ \\t\\n]*0\\.000(?:[^0-9]|$)')} AS exact_zero, {_count('P[ \\t\\n]*<[ \\t\\n]*0\\.000')} AS below_zero, {_count('P[ \\t\\n]*<[ \\t\\n]*0\\.\\d+')} AS thresholds, "
    f"{_count('P[ \\t\\n]*=[ \\t\\n]*0\\.\\d+')} AS exact, {_count('P[ \\t\\n]*=[ \\t\\n]*0\\.\\d{3,}')} AS precise, {_count('差异有统计学意义')} AS significant FROM papers) "
    "SELECT *, thresholds > 5 AND exact = 0 AS no_precise, CASE WHEN exact_zero > 0 OR below_zero > 0 THEN 'L2' WHEN thresholds > 5 AND exact = 0 THEN 'L1' END AS level FROM q",
)
def _(read):
    return text.p_value_format(papers(read))


def plain_numbers(read):
    """Only ASCII: every character beyond it becomes a space, so that both engines' word boundaries agree."""
    return papers(read).select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", " ").alias("text"))


_PLAIN = _WITH + r", plain AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM papers)"


@query(
    "decimal_tail_text",
    _PLAIN + r", e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d+\.(\d+))\b', 2)) AS tail, unnest(range(len(regexp_extract_all(text, '\b(\d+\.(\d+))\b', 2)))) AS place FROM plain), "
    "b AS (SELECT doc_id, length(tail) AS digits, tail, count(*) AS c, min(place) AS first FROM e GROUP BY ALL), r AS (SELECT *, sum(c) OVER w AS total, row_number() OVER (PARTITION BY doc_id, digits ORDER BY c DESC, first) AS r FROM b WINDOW w AS (PARTITION BY doc_id, digits)), "
    "q AS (SELECT doc_id, digits, total::BIGINT AS total, tail, c AS freq, CASE WHEN c / total > 0.5 THEN 'HIGH' WHEN c / total > 0.3 THEN 'MEDIUM' ELSE 'CLEAN' END AS signal FROM r WHERE r = 1 AND total >= 10) SELECT * FROM q WHERE signal <> 'CLEAN' OR digits <= 2",
)
def _(read):
    return text.decimal_tails(plain_numbers(read))


@query(
    "dup_numbers",
    _PLAIN + r", e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d+\.?\d*)\b', 1)) AS x FROM plain), b AS (SELECT doc_id, x, count(*) AS c FROM e WHERE length(replace(x, '.', '')) >= 3 GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS r FROM b), q AS (SELECT doc_id, sum(c)::BIGINT AS n, count(*) AS n_unique, coalesce(sum(c) FILTER (WHERE c >= 2 AND r <= 20), 0)::BIGINT AS repeated FROM r GROUP BY doc_id) "
    "SELECT *, CASE WHEN repeated / n > 0.3 THEN 'HIGH' WHEN repeated / n > 0.15 THEN 'MEDIUM' ELSE 'CLEAN' END AS signal FROM q WHERE n >= 10",
)
def _(read):
    return text.duplicate_numbers(plain_numbers(read))


@query("lang_cjk", f"{_WITH} SELECT doc_id, CASE WHEN len(regexp_extract_all(substr(text, 1, 1000), '[一-鿿]')) > 50 THEN 'zh' ELSE 'en' END AS language FROM papers")
def _(read):
    return papers(read).select("doc_id", text.language(F.col("text")).alias("language"))


@query("mean_sd_pairs", f"{_WITH}, m AS (SELECT doc_id, regexp_extract_all(text, '(\\d+\\.?\\d*)\\s*±\\s*(\\d+\\.?\\d*)', 1) AS m, regexp_extract_all(text, '(\\d+\\.?\\d*)\\s*±\\s*(\\d+\\.?\\d*)', 2) AS s FROM papers) SELECT doc_id, len(m) AS n, array_to_string(list_transform(list_zip(m, s)[1:5], lambda x: x[1] || '±' || x[2]), '|') AS first_pairs FROM m")
def _(read):
    return text.mean_sd_pairs(papers(read))


@query(
    "method_suitability",
    "WITH a(alias, name, o) AS (VALUES " + ", ".join(f"({sql_text(k)}, {sql_text(v)}, {i})" for i, (k, v) in enumerate(lk.METHOD_ALIASES)) + "), t(data_type) AS (VALUES " + ", ".join(f"({sql_text(k)})" for k in lk.SUITABILITY) + "), "
    "s(data_type, which, m) AS (VALUES " + ", ".join(f"({sql_text(k)}, {w}, {sql_text(m)})" for k, v in lk.SUITABILITY.items() for w, names in enumerate(v) for m in names) + "), "
    "std AS (SELECT data_type, which, m AS m FROM s UNION SELECT data_type, which, (SELECT name FROM a WHERE contains(lower(s.m), alias) ORDER BY alias = lower(s.m) DESC, o LIMIT 1) FROM s), "
    "d AS (SELECT data_type, alias AS method, (SELECT name FROM a AS b WHERE contains(a.alias, b.alias) ORDER BY o LIMIT 1) AS normal FROM t, a) "
    "SELECT data_type, method, normal, CASE WHEN EXISTS (SELECT 1 FROM std WHERE std.data_type = d.data_type AND which = 0 AND m = normal) THEN NULL WHEN EXISTS (SELECT 1 FROM std WHERE std.data_type = d.data_type AND which = 2 AND m = normal) THEN 'HIGH' WHEN EXISTS (SELECT 1 FROM std WHERE std.data_type = d.data_type AND which = 1 AND m = normal) THEN 'LOW' END AS severity FROM d",
)
def _(read):
    spark = read("region").sparkSession
    rows = [(t, alias) for t in lk.SUITABILITY for alias, _ in lk.METHOD_ALIASES]
    return text.method_suitability(spark.createDataFrame(rows, "data_type string, method string"))


@query(
    "conclusion_rules",
    f"{_WITH}, r AS (SELECT doc_id, 'INFO' AS severity, 'significant' AS kind, unnest(regexp_extract_all(text, {sql_text(lk.SIGNIFICANT)})[1:10]) AS text FROM papers "
    f"UNION ALL SELECT doc_id, 'INFO', 'not_significant', unnest(regexp_extract_all(text, {sql_text(lk.NOT_SIGNIFICANT)})[1:10]) FROM papers UNION ALL SELECT doc_id, 'INFO', 'effect', unnest(regexp_extract_all(text, {sql_text(lk.MARKED_EFFECT)})[1:10]) FROM papers "
    f"UNION ALL SELECT doc_id, 'HIGH', 'contradiction', unnest((regexp_extract_all(text, {sql_text(lk.CONTRADICTION_LOW)}) || regexp_extract_all(text, {sql_text(lk.CONTRADICTION_HIGH)}))[1:5]) FROM papers UNION ALL SELECT doc_id, 'MEDIUM', 'sweeping', unnest(regexp_extract_all(text, {sql_text(lk.SWEEPING)})[1:5]) FROM papers) SELECT * FROM r",
)
def _(read):
    return text.conclusions(papers(read))


@query("fallback_rules", f"{_WITH} SELECT doc_id, regexp_matches(text, '差异无统计学意义.*P\\s*[<＜]\\s*0\\.\\d+') AS contradiction, regexp_matches(text, '差异具有统计学意义.*?P\\s*>\\s*0\\.\\d+') AS direction, regexp_matches(text, '统计学差异.*?P\\s*>\\s*0\\.\\d+') AS difference FROM papers")
def _(read):
    return text.fallback_rules(papers(read))


_KINDS = (
    ("review", _any("substr(text, 1, 200)", ["综述", "Review", "进展", "Progress"])),
    ("survey", _any("substr(text, 1, 300)", ["问卷调查", "问卷", "调查表", "量表", "计数", "例数"])),
    ("geo_data", _any("lower(text)", ["geo ", "gse", "tcga", "geo accession", "geo数据集"])),
    ("wet_lab", _any("lower(text)", ["western blot", "免疫印迹", "western-blot", "wb "])),
)
_COVER = "CASE data_type " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in lk.COVERAGE.items()) + " ELSE [50, 50, 50, 50, 50] END"


@query(
    "data_type",
    f"{_WITH}, b AS (SELECT doc_id, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _KINDS) + f" END AS first, {_any('lower(text)', ['bar chart', '柱状图', 'barplot'])} AS has_bar_chart, {_any('lower(substr(text, 1, 500))', ['rct', 'randomized', '随机对照', '临床试验', 'clinical trial'])} AS is_trial, "
    "regexp_matches(text, '[xX̄\\\\bar{}][±]\\s*[sS]') OR regexp_matches(lower(text), 'mean\\s*±\\s*sd') AS has_mean_sd, "
    f"regexp_matches(text, '\\d{{7,10}}') AND {_any('lower(text)', ['基金', 'funding', 'grant', '资助', '国家自然科学'])} AS has_funding FROM papers), "
    "k AS (SELECT *, coalesce(first, CASE WHEN has_bar_chart THEN 'bar_chart' WHEN is_trial THEN 'clinical_trial' WHEN has_mean_sd THEN 'clinical_table' ELSE 'unknown' END) AS data_type FROM b), "
    f"c AS (SELECT *, {_COVER} AS cover FROM k) SELECT doc_id, data_type, coalesce(first = 'wet_lab', false) AS has_wb, has_bar_chart, is_trial, has_mean_sd, has_funding, cover[1] AS layer1, cover[2] AS layer2, cover[3] AS layer3, cover[4] AS layer4, cover[5] AS layer5 FROM c",
)
def _(read):
    return text.data_type(papers(read))


_L = "lower(text)"


@query(
    "method_premises",
    f"{_WITH}, n AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[nN]\\s*[=＝]\\s*(\\d+)', 1), lambda x: try_cast(x AS BIGINT)) AS n, list_filter([{', '.join(map(sql_text, lk.STATISTICAL_WORDS))}], lambda w: contains(lower(text), lower(w))) AS w FROM papers) "
    f"SELECT doc_id, array_to_string(w, '|') AS words, array_to_string(n[1:10], '|') AS n_values, CASE WHEN {_any(_L, ['t检验', 't test'])} AND NOT contains(text, '正态') THEN 'MEDIUM' END AS normality, "
    f"CASE WHEN {_any(_L, ['方差分析', 'anova'])} AND NOT {_any(_L, ['方差齐性', 'levene', 'bartlett'])} THEN 'MEDIUM' END AS homoscedasticity, CASE WHEN {_any(_L, ['t检验', 't test'])} AND len(list_filter(n, lambda x: x < 3)) > 0 THEN 'HIGH' END AS too_few, "
    "CASE WHEN len(list_filter(w, lambda x: contains(lower(x), 't'))) > 0 THEN list_min(list_filter(n[1:10], lambda x: x < 5)) END AS small_n, try_cast(nullif(regexp_extract(text, 'P\\s*[<≤]\\s*(0\\.\\d+)', 1), '') AS DOUBLE) AS p_threshold, "
    f"CASE WHEN {_any(_L, ['χ²', 'χ2', '卡方', '计数', '例数', '构成比', '率'])} THEN 'categorical_rxc' WHEN {_any(_L, ['kaplan', 'meier', '生存', 'cox', 'log.rank', 'log-rank'])} THEN 'survival_time' WHEN {_any(_L, ['pearson', 'spearman', '相关', '相关系数'])} THEN 'correlation' "
    f"WHEN {_any(_L, ['配对', '前后', '自身对照', '同体'])} THEN 'continuous_paired' WHEN {_any(_L, ['多组', '方差分析', 'anova', '单因素分差'])} THEN 'continuous_normal_multi_groups' WHEN {_any(_L, ['两组', 't检验', 't test'])} THEN 'continuous_normal_two_groups' ELSE 'unknown' END AS data_type FROM n",
)
def _(read):
    return text.premises(papers(read))


_LINES = "lines AS (SELECT doc_id, line, trim(raw) AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM papers) WHERE trim(raw) <> '')"


@query(
    "declarations",
    f"{_WITH}, {_LINES} "
    + " UNION ALL ".join(f"SELECT doc_id, line, 'method{k}' AS kind, unnest(regexp_extract_all(raw, {sql_text('(?i)' + p)})) AS method FROM lines" for k, p in enumerate(lk.DECLARATIONS, 1))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT doc_id, min(line), 'software', {sql_text(x)} FROM lines WHERE contains(lower(raw), {sql_text(x.lower())}) GROUP BY doc_id" for x in lk.SOFTWARE)
    + " UNION ALL SELECT doc_id, 0, 'threshold', regexp_extract(text, 'P\\s*[<＜]\\s*(0\\.\\d+)', 1) FROM papers WHERE regexp_matches(text, 'P\\s*[<＜]\\s*0\\.\\d+')",
)
def _(read):
    return text.declarations(papers(read))


#: Occurrences of the phrases but for those that an earlier phrase overlaps.
TORTURED_SQL = (
    f"{_WITH}, phrases(k, abnormal, usual, confidence) AS (VALUES " + ", ".join(f"({k}, {sql_text(a)}, {sql_text(b)}, {sql_text(c)})" for k, (a, b, c) in enumerate(lk.TORTURED_PHRASES)) + "), "
    "has AS (SELECT doc_id, text, k, abnormal, usual, confidence, unnest(range(0, length(text))) AS s FROM papers JOIN phrases ON contains(text, abnormal)), "
    "found AS (SELECT *, s + length(abnormal) AS e FROM has WHERE substr(text, s + 1, length(abnormal)) = abnormal), "
    "kept AS (SELECT * FROM found AS f WHERE NOT EXISTS (SELECT 1 FROM found AS g WHERE g.doc_id = f.doc_id AND g.k < f.k AND g.s < f.e AND f.s < g.e))"
)


@query("tortured_phrases", TORTURED_SQL + ' SELECT doc_id, abnormal, usual, confidence, s::INTEGER AS "start", e::INTEGER AS "end", substr(text, greatest(s - 40, 0) + 1, least(e + 40, length(text)) - greatest(s - 40, 0)) AS context FROM kept')
def _(read):
    return text.tortured_phrases(papers(read))


def _re(pattern: str) -> str:
    """A pattern without Java's flag for Unicode classes."""
    return sql_text(pattern.replace("(?Ui)", "(?i)").replace("(?U)", ""))


def _first(pattern: str, group: int = 1, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, {_re(pattern)}, {group}), '')"


#: RE2 has no look-ahead: what stands before a capital becomes a mark first.
_LISTED = f"regexp_replace(regexp_replace(regexp_replace({_first(lk.AUTHORS_EN, 1, 'substr(text, 1, 3000)')}, '\\d,\\s*', chr(1), 'g'), ',\\s*([A-Z])', chr(1) || '\\1', 'g'), '\\d\\s+([A-Z])', chr(1) || '\\1', 'g')"
_CAPITALS = f"list_filter(string_split_regex(regexp_replace({_first(lk.CAPITAL_AUTHORS, 0)}, '\\d{{1,2}}', '', 'g'), {_re(lk.CAPITAL_GAP)}), lambda x: length(trim(x)) > 3)"
_IDENTITY = (
    f"{_WITH}, i AS (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 1000), '[一-鿿]')) > 50 AS zh, regexp_replace({_first(lk.DOI_FIELD)}, '[.,;]+$', '') AS doi, "
    f"list_filter(string_split_regex(regexp_replace({_first(lk.AUTHORS_ZH)}, {_re(lk.AUTHOR_MARKS)}, '', 'g'), {_re(lk.AUTHOR_GAP_ZH)}), lambda x: length(trim(x)) >= 2) AS zh_authors, "
    f"list_filter(list_transform(string_split({_LISTED}, chr(1)), lambda x: regexp_replace(trim(x), '[,.]+$', '')), lambda x: length(x) > 2) AS listed, "
    f"list_transform({_CAPITALS}, lambda x: array_to_string(list_transform(string_split(lower(trim(x)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS capital, "
    f"coalesce(trim({_first(lk.CORRESPONDING_ZH)}), array_to_string(list_distinct(regexp_extract_all(substr(text, 1, 2000), {_re(lk.STARRED_ZH)}, 1)), '|')) AS zh_corr, {_first(lk.CORRESPONDING_EN)} AS corr_line, "
    f"list_distinct(list_filter(regexp_extract_all(substr(text, 1, 2000), {_re(lk.STARRED_EN)}, 1), lambda x: length(x) > 3)) AS stars, {_first(lk.INSTITUTION_ZH, 0)} AS zh_inst, {_first(lk.INSTITUTION_EN, 0, 'substr(text, 1, 3000)')} AS en_inst, "
    f"coalesce(trim({_first(lk.JOURNAL_VOLUME, 1, 'substr(text, 1, 500)')}), trim({_first(lk.JOURNAL_NAME, 0, 'substr(text, 1, 500)')})) AS journal, "
    f"list_sort(list_distinct(flatten(list_transform(regexp_extract_all(text, {sql_text('(?i)' + lk.FUNDING_LINE)}, 1)[1:3], lambda x: regexp_extract_all(x, {_re(lk.FUNDING_NUMBER)}, 1))))) AS funding FROM papers), "
    "a AS (SELECT *, coalesce(CASE WHEN zh THEN zh_authors WHEN len(listed) > 0 THEN listed ELSE capital END, []) AS authors FROM i) "
    "SELECT doc_id, CASE WHEN zh THEN 'zh' ELSE 'en' END AS language, doi, array_to_string(authors, '|') AS authors, authors[1] AS first_author, "
    "nullif(CASE WHEN zh THEN zh_corr WHEN corr_line IS NOT NULL THEN trim(regexp_replace(corr_line, '\\S+@\\S+', '', 'g')) ELSE array_to_string(stars, '|') END, '') AS corresponding, "
    "substr(trim(CASE WHEN zh THEN zh_inst ELSE en_inst END), 1, 200) AS institution, CASE WHEN NOT zh THEN journal END AS journal, array_to_string(funding, '|') AS funding FROM a"
)


@query("identity", _IDENTITY)
def _(read):
    return text.identity(papers(read))


def named(read):
    return papers(read).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper"), "text")


_EMAIL = r"[\pL\pN\pM_.+-]+@[\pL\pN\pM_-]+\.[\pL\pN\pM_.-]+"
_EDGES = f"{_WITH}, edges AS (SELECT DISTINCT paper, email FROM (SELECT 'p' || doc_id AS paper, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM papers))"


@query("email_extract", _EDGES + " SELECT * FROM edges")
def _(read):
    return crossdoc.emails(named(read))


@query("email_cross_paper", _EDGES + " SELECT email, count(*) AS n_papers, min(paper) AS first_paper, max(paper) AS last_paper FROM edges GROUP BY email HAVING count(*) > 1")
def _(read):
    return crossdoc.shared_emails(crossdoc.emails(named(read)))


@query("email_cross_signals", _EDGES + ", s AS (SELECT email, count(*) AS n_papers FROM edges GROUP BY email HAVING count(*) > 1) SELECT email, paper, n_papers, 'NEEDS_HUMAN_VERIFICATION' AS status FROM edges JOIN s USING (email)")
def _(read):
    return crossdoc.cross_paper_signals(crossdoc.emails(named(read)))


_HIT = r"(regexp_matches(email, '(?i)^([a-z]{3,}_?[a-z]*)(\d{2,5})@') OR regexp_matches(email, '(?i)^([a-z]{2,6})(\d{3,6})@'))"
_PATTERNED = f"pat AS (SELECT paper, count(*) AS n_emails, count(*) FILTER (WHERE {_HIT}) AS n_patterned FROM edges GROUP BY paper HAVING count(*) >= 2 AND count(*) FILTER (WHERE {_HIT}) >= 2)"


@query("email_patterned", f"{_EDGES}, {_PATTERNED} SELECT *, 'MEDIUM' AS signal FROM pat")
def _(read):
    return crossdoc.patterned_names(crossdoc.emails(named(read)))


@query(
    "email_roll_up",
    f"{_EDGES}, {_PATTERNED}, s AS (SELECT email FROM edges GROUP BY email HAVING count(*) > 1), b AS (SELECT paper, 'PATTERNED_NAMING' AS kind FROM pat UNION ALL SELECT paper, 'CROSS_PAPER_EMAIL' FROM edges JOIN s USING (email)) SELECT paper, count(*) AS n_signals, array_to_string(list_sort(list_distinct(list(kind))), '|') AS kinds FROM b GROUP BY paper",
)
def _(read):
    return crossdoc.roll_up(crossdoc.emails(named(read)))


@query("email_no_signal", f"{_EDGES}, {_PATTERNED}, s AS (SELECT email FROM edges GROUP BY email HAVING count(*) > 1) SELECT DISTINCT 'p' || doc_id AS paper FROM papers WHERE 'p' || doc_id NOT IN (SELECT paper FROM pat) AND 'p' || doc_id NOT IN (SELECT paper FROM edges JOIN s USING (email))")
def _(read):
    return crossdoc.papers_without_signal(named(read), crossdoc.emails(named(read)))


@query(
    "email_domains",
    f"{_WITH}, edges AS (SELECT 'p' || doc_id AS paper, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM papers), q AS (SELECT paper, count(*) AS total, count(*) FILTER (WHERE {_any('email', lk.SUSPICIOUS_DOMAINS)}) AS suspicious, count(*) FILTER (WHERE {_any('email', lk.ACADEMIC_DOMAINS)}) AS academic FROM edges GROUP BY paper) "
    "SELECT *, CASE WHEN suspicious / total > 0.5 THEN 'HIGH' WHEN suspicious / total > 0.3 THEN 'MEDIUM' WHEN academic > 0 AND academic < total * 0.3 THEN 'LOW' ELSE 'CLEAN' END AS signal FROM q",
)
def _(read):
    return crossdoc.domain_profile(crossdoc.emails(named(read), distinct=False))


@query("institution_rules", f"{_WITH} SELECT 'p' || doc_id AS paper, array_to_string(list_filter([{', '.join(map(sql_text, lk.RETRACTED_INSTITUTIONS))}], lambda x: contains(substr(text, 1, 5000), x)), '|') AS institutions, regexp_matches(substr(text, 1, 5000), {sql_text(lk.LOCAL_HOSPITAL)}) AND regexp_matches(substr(text, 1, 5000), {sql_text(lk.MOLECULAR_WORK)}) AS mismatch FROM papers")
def _(read):
    return crossdoc.institution_rules(named(read))


@query("no_doi", f"{_WITH} SELECT 'p' || doc_id AS paper, CASE WHEN NOT regexp_matches(text, '10\\.\\d{{4,}}/[\\pL\\pN_.()-]+') THEN 'LOW' END AS signal FROM papers")
def _(read):
    return crossdoc.without_doi(named(read))


_JOINED = lambda p, most="": f"array_to_string(regexp_extract_all(text, {sql_text(p)}, 1){most}, '|')"


@query(
    "author_extract",
    f"{_WITH} SELECT 'p' || doc_id AS paper, len(regexp_extract_all(text, '{_EMAIL}')) AS n_emails, {_JOINED(lk.LISTED_AUTHORS_ZH)} AS authors_zh, {_JOINED(lk.LISTED_AUTHORS_EN, '[1:20]')} AS authors_en, "
    f"{_JOINED('(?i)' + lk.AFFILIATIONS)} AS affiliations, {_JOINED(r'(10\.\d{4,}/[\pL\pN\pM_.()-]+)')} AS dois FROM papers",
)
def _(read):
    return crossdoc.authors(named(read))


TABLED = (
    "表 1 Control 1.20 ± 0.05 模型组 2.50±0.10\n表 2 Control 3.80 ± 0.05\n模型组 2.52±0.10",
    "Table 1 siRNA-a 1.0±0.1 2.0±0.1 3.0±0.1 4.0±0.1\nTable 2 vegf 1.0±0.1 2.0±0.2 4.0±0.1 8.0±0.1\nno rows",
)


def tabled(read):
    """All papers, and those with tables."""
    made = read("documents").sparkSession.createDataFrame([(-100 - i, t) for i, t in enumerate(TABLED)], "doc_id long, text string").coalesce(1)
    return papers(read).unionByName(made)


_TITLE = r"(?:表\s*\d+|Table\s*\d+|Tab\.?\s*\d+)"
_NAME = r"一-鿿\pL\pN\pM_"
_SECTIONS = (
    f"{_WITH}, tabled AS (SELECT * FROM papers UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-100 - i}, {sql_text(t)})" for i, t in enumerate(TABLED)) + ") v(doc_id, text)), "
    f"cut AS (SELECT doc_id, regexp_extract_all(text, '{_TITLE}') AS titles, string_split_regex(text, '{_TITLE}') AS bodies FROM tabled WHERE contains(text, '±')), "
    "sections AS (SELECT doc_id, section, CASE WHEN section = 0 THEN '未知表' ELSE titles[section] END AS table_id, body FROM (SELECT doc_id, titles, unnest(bodies) AS body, unnest(range(0, len(bodies))) AS section FROM cut) WHERE contains(body, '±'))"
)
_ROW = rf"([{_NAME}\s\-/]+?)\s+(\d+\.?\d*)\s*±\s*(\d+\.?\d*)"
_POINTS = rf"([{_NAME}-]+)\s+((?:\d+\.?\d*\s*±\s*\d+\.?\d*\s*){{3,}})"


@query(
    "table_groups",
    f"{_SECTIONS}, r AS (SELECT doc_id, table_id, unnest(regexp_extract_all(body, '{_ROW}', 1)) AS g, unnest(regexp_extract_all(body, '{_ROW}', 2)) AS m, unnest(regexp_extract_all(body, '{_ROW}', 3)) AS s FROM sections), "
    "t AS (SELECT doc_id, table_id, trim(regexp_replace(g, '^\\s+|\\s+$', '', 'g')) AS g, m, s FROM r) SELECT doc_id, table_id, g AS group_raw, CASE "
    + " ".join(f"WHEN contains(lower(g), {sql_text(a)}) THEN {sql_text(n)}" for a, n in lk.GROUP_ALIASES)
    + " ELSE g END AS group_name, CAST(m AS DOUBLE) AS mean, CAST(s AS DOUBLE) AS sd FROM t",
)
def _(read):
    return text.table_groups(tabled(read))


@query(
    "table_series",
    f"{_SECTIONS}, r AS (SELECT doc_id, table_id, unnest(regexp_extract_all(body, '{_POINTS}', 1)) AS g, unnest(regexp_extract_all(body, '{_POINTS}', 2)) AS d FROM sections WHERE section > 0), "
    "y AS (SELECT doc_id, g || '(' || table_id || ')' AS label, regexp_extract_all(d, '(\\d+\\.?\\d*)\\s*±\\s*(\\d+\\.?\\d*)', 1) AS v FROM r) "
    "SELECT doc_id, label, CAST(unnest(range(0, len(v))) AS DOUBLE) AS t, CAST(unnest(v) AS DOUBLE) AS y FROM y",
)
def _(read):
    return text.table_series(tabled(read))


@query("paper_review")
def _(read):
    found = review.review(tabled(read))
    return found.select("source", "detector", "severity", F.array_join("subject", ",").alias("subject"), "description")


@query("paper_verdicts")
def _(read):
    docs = papers(read)
    return review.verdicts(docs, review.review(docs))
