"""Text rules on literal papers."""

from tallyglass.operators import crossdoc, images, text


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_english_authors_and_journal(spark):
    line = "ONCOLOGY LETTERS 22: 13001, 2021\nYANYI LI1, HUIHUI KE1, RUI ZHANG1, JIANLONG ZHU1 and MINGHUA YU2\nDepartment of Oncology, Hospital\ndoi: 10.3892/ol.2021.13001.\nFunding: grant 81772345 of NSFC"
    r = text.identity(docs(spark, line)).first()
    assert r.authors == "Yanyi Li|Huihui Ke|Rui Zhang|Jianlong Zhu|Minghua Yu" and r.first_author == "Yanyi Li"
    assert (r.journal, r.doi, r.language, r.funding) == ("ONCOLOGY LETTERS", "10.3892/ol.2021.13001", "en", "81772345")
    assert r.institution.startswith("Department of Oncology")


def test_chinese_identity(spark):
    r = text.identity(docs(spark, "作者：张三，李四1，王小五\n通讯作者：李四光\n单位：某某医科大学附属医院\n" + "中" * 60)).first()
    assert (r.language, r.authors, r.corresponding) == ("zh", "张三|李四|王小五", "李四光")


def test_address_patterns(spark):
    mails = "zhangsan66@a.com li_si88@a.com ymh3011@a.com lxj068@a.com wang5@a.com"
    r = crossdoc.patterned_names(crossdoc.emails(docs(spark, mails).withColumnRenamed("doc_id", "paper"))).first()
    assert (r.n_emails, r.n_patterned) == (5, 3)


def test_phrases_do_not_overlap(spark):
    found = text.tortured_phrases(docs(spark, "研究卡方检验分析与深刻学习，方差分析检验分析", "nothing")).orderBy("start").collect()
    assert [(r.abnormal, r.start, r.end) for r in found] == [("卡方检验分析", 2, 8), ("深刻学习", 9, 13), ("方差分析检验", 14, 20)]
    assert text.tortured_risk(text.tortured_phrases(docs(spark, "深刻学习 西方印记 假冒意识 数据存储仓库 西方墨点"))).first().risk == "HIGH"


def test_boundaries_are_unicode(spark):
    assert text.decimal_tails(docs(spark, "为0.05和" * 20)).count() == 0
    assert text.decimal_tails(docs(spark, " 0.05 ," * 20)).first().signal == "HIGH"


def test_p_value_format(spark):
    r = text.p_value_format(docs(spark, "P=0.000 P = 0.0001 P<0.000 " + "P<0.05 " * 6)).first()
    assert (r.exact_zero, r.below_zero, r.thresholds, r.exact, r.precise, r.level) == (1, 1, 7, 2, 2, "L2")
    assert text.p_value_format(docs(spark, "P<0.05 " * 6)).first().level == "L1"


def test_tables_and_series(spark):
    body = "表 1 Control 1.2 ± 0.3\nconcentration 2.0±0.1\n表2 给药组 1.0±0.1 2.0±0.1 3.0±0.2\n"
    groups = text.table_groups(docs(spark, body)).collect()
    assert [(r.table_id, r.group_name, r.mean) for r in groups][:2] == [("表 1", "Control", 1.2), ("表 1", "Control", 2.0)]
    assert [(r.label, r.t, r.y) for r in text.table_series(docs(spark, body)).orderBy("t").collect()] == [("给药组(表2)", 0.0, 1.0), ("给药组(表2)", 1.0, 2.0), ("给药组(表2)", 2.0, 3.0)]


def test_declarations(spark):
    got = {(r.line, r.kind, r.method) for r in text.declarations(docs(spark, "first\n采用 SPSS 20.0 软件 进行t检验, P<0.05\nspss again")).collect()}
    assert (2, "software", "SPSS") in got and (0, "threshold", "0.05") in got and any(k == "method1" for _, k, _ in got)


def test_suitability_normalises_both_sides(spark):
    rows = spark.createDataFrame([("categorical_2x2", "t检验"), ("rank_ordinal", "Wilcoxon test"), ("continuous_paired", "t test"), ("nothing", "t test")], "data_type string, method string")
    assert [r.severity for r in text.method_suitability(rows).collect()] == ["HIGH", None, "LOW", None]


def test_kernels(spark):
    import numpy as np

    tile = (np.arange(1024).reshape(32, 32) % 200 + 20).astype(np.uint8)
    twice = np.tile(tile, (4, 4))
    assert images.block_duplicates(twice) == (8, 9)
    assert images.block_duplicates(np.full((64, 64), 255, np.uint8)) == (0, 0)
    assert images.ssim(twice, twice) == 1 and images.ssim(twice, 255 - twice) < 0.5
    assert images.find_bands(np.array([0, 0, 2, 4, 5, 4, 2, 0, 0] + [0] * 20 + [0, 2, 4, 6, 4, 2, 0, 0.0]), 1.0) == [4, 32]
    f = images.frequency_features(np.random.default_rng(1).integers(0, 255, (128, 128)).astype(np.uint8))
    assert 0 < f[0] < 1 and 0 <= images.synthetic_score(f) <= 1
    assert images.resized(np.arange(16).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_review_of_papers(spark):
    from tallyglass.plans import review

    body = "采用t检验。差异无统计学意义(P<0.05)。n=2。contact a1@qq.com\n表 1 Control 1.20 ± 0.05\n表 2 Control 3.80 ± 0.05\n"
    df = docs(spark, body, "plain text of a review doi 10.1234/ab.1", None)
    found = review.review(df).cache()
    kinds = {(r.source, r.detector) for r in found.collect()}
    assert {("0", "CROSS_TABLE"), ("0", "CONCLUSION_CONTRADICTION"), ("0", "TOO_FEW_FOR_T_TEST"), ("0", "MISSING_NORMALITY_CHECK"), ("0", "EMAIL_DOMAINS"), ("0", "NO_DOI")} <= kinds
    got = {r.source: r for r in review.verdicts(df, found).collect()}
    assert got["0"].risk == "RED" and got["1"].risk == "GREEN" and len(got) == 3
