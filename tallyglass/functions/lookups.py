"""Names, aliases, word lists and patterns that results must agree on."""

#: Statistical method by the first alias that a lower-cased text contains, in this order.
METHOD_ALIASES = (
    ("t检验", "独立样本t检验"),
    ("t test", "独立样本t检验"),
    ("student's t test", "独立样本t检验"),
    ("student t检验", "独立样本t检验"),
    ("welch's t test", "Welch's t-test"),
    ("welch t检验", "Welch's t-test"),
    ("配对t检验", "配对t检验"),
    ("paired t test", "配对t检验"),
    ("单因素方差分析", "单因素方差分析"),
    ("单因素分差分析", "单因素方差分析"),
    ("one-way anova", "单因素方差分析"),
    ("anova", "单因素方差分析"),
    ("方差分析", "单因素方差分析"),
    ("重复测量方差分析", "重复测量方差分析"),
    ("repeated measures anova", "重复测量方差分析"),
    ("双因素方差分析", "双因素方差分析"),
    ("two-way anova", "双因素方差分析"),
    ("秩和检验", "Mann-Whitney U检验"),
    ("mann-whitney", "Mann-Whitney U检验"),
    ("mann whitney u", "Mann-Whitney U检验"),
    ("wilcoxon", "Wilcoxon符号秩检验"),
    ("wilcoxon符号秩检验", "Wilcoxon符号秩检验"),
    ("kruskal-wallis", "Kruskal-Wallis检验"),
    ("kruskal wallis", "Kruskal-Wallis检验"),
    ("卡方检验", "卡方检验"),
    ("χ²检验", "卡方检验"),
    ("χ2检验", "卡方检验"),
    ("chi-square", "卡方检验"),
    ("chi square", "卡方检验"),
    ("fisher精确检验", "Fisher精确检验"),
    ("fisher exact", "Fisher精确检验"),
    ("fisher's exact", "Fisher精确检验"),
    ("pearson相关", "Pearson相关"),
    ("pearson correlation", "Pearson相关"),
    ("spearman等级相关", "Spearman等级相关"),
    ("spearman correlation", "Spearman等级相关"),
    ("spearman", "Spearman等级相关"),
    ("spss", "SPSS"),
    ("sas", "SAS"),
    ("stata", "Stata"),
    ("graphpad", "GraphPad"),
    ("graphpad prism", "GraphPad Prism"),
    ("prism", "GraphPad Prism"),
)

#: Which methods suit a type of data: recommended, acceptable, wrong.
SUITABILITY = {
    "continuous_normal_two_groups": (
        ("独立样本t检验", "Student's t-test", "Welch's t-test", "Mann-Whitney U检验"),
        ("单因素方差分析",),
        ("卡方检验", "χ²检验", "Fisher精确检验"),
    ),
    "continuous_normal_multi_groups": (
        ("单因素方差分析", "ANOVA", "重复测量方差分析", "Kruskal-Wallis检验"),
        ("独立样本t检验",),
        ("卡方检验",),
    ),
    "continuous_paired": (("配对t检验", "Wilcoxon符号秩检验"), ("独立样本t检验",), ("卡方检验", "单因素方差分析")),
    "categorical_2x2": (("卡方检验", "χ²检验", "Fisher精确检验"), (), ("t检验", "t test", "方差分析", "ANOVA")),
    "categorical_rxc": (("卡方检验", "χ²检验", "Fisher精确检验"), (), ("t检验", "方差分析")),
    "rank_ordinal": (("Mann-Whitney U检验", "Kruskal-Wallis检验", "Wilcoxon符号秩检验", "Spearman等级相关"), (), ("t检验", "方差分析", "Pearson相关")),
    "survival_time": (("Kaplan-Meier", "log-rank检验", "Cox回归"), (), ("t检验", "卡方检验")),
    "correlation": (("Pearson相关", "Spearman等级相关"), ("线性回归",), ("t检验", "卡方检验")),
}

#: Group of a table row by the first alias that its lower-cased name contains, in this order.
GROUP_ALIASES = (
    ("control", "Control"),
    ("control组", "Control"),
    ("空白对照", "Control"),
    ("空白对照组", "Control"),
    ("阴性对照", "Control"),
    ("阴性对照组", "Control"),
    ("nc", "Control"),
    ("ctrl", "Control"),
    ("treatment", "Treatment"),
    ("treatment组", "Treatment"),
    ("给药组", "Treatment"),
    ("药物组", "Treatment"),
    ("model", "Model"),
    ("模型组", "Model"),
    ("sirna", "siRNA"),
    ("si-", "siRNA"),
    ("sh-", "shRNA"),
    ("dll4", "DLL4"),
    ("vegf", "VEGF"),
    ("pbs", "PBS"),
)

#: (abnormal phrase, usual phrase, confidence), in the order they are looked for.
TORTURED_PHRASES = (
    ("假冒意识", "人工智能", "high"),
    ("深刻学习", "深度学习", "high"),
    ("深层神经组织", "深度神经网络", "high"),
    ("随机森林地带", "随机森林", "high"),
    ("支撑向量机", "支持向量机", "low"),
    ("信号到噪声比例", "信噪比", "medium"),
    ("西方印记", "Western blot", "high"),
    ("西方墨点", "Western blot", "high"),
    ("基因表达谱系", "基因表达谱", "low"),
    ("蛋白质印记", "蛋白质印迹/Western blot", "medium"),
    ("免疫组织合成化学", "免疫组织化学", "high"),
    ("聚合酶链式反应放大", "聚合酶链式反应/PCR", "medium"),
    ("逆转录聚合酶链式反应", "逆转录PCR/RT-PCR", "low"),
    ("流式细胞分析术", "流式细胞术", "medium"),
    ("酶联免疫吸附剂测定", "酶联免疫吸附试验/ELISA", "medium"),
    ("定量即时聚合酶链式反应", "实时定量PCR/qPCR", "high"),
    ("细胞死亡机制", "细胞凋亡", "medium"),
    ("程序性细胞死亡通路", "细胞凋亡通路", "medium"),
    ("转录因子结合位点序列", "转录因子结合位点", "medium"),
    ("微小核糖核酸", "微小RNA/miRNA", "medium"),
    ("短发夹核糖核酸", "短发夹RNA/shRNA", "high"),
    ("小干扰核糖核酸", "小干扰RNA/siRNA", "high"),
    ("长链非编码核糖核酸", "长链非编码RNA/lncRNA", "low"),
    ("显著性差异分析", "显著性检验", "low"),
    ("统计显著性检验", "显著性检验", "low"),
    ("方差分析检验", "方差分析/ANOVA", "medium"),
    ("卡方检验分析", "卡方检验", "medium"),
    ("皮尔逊相关系数检验", "Pearson相关系数", "medium"),
    ("斯皮尔曼等级相关系数分析", "Spearman等级相关", "high"),
    ("多元线性回归分析模型", "多元线性回归", "low"),
    ("逻辑回归模型分析", "Logistic回归", "medium"),
    ("考克斯比例风险回归模型", "Cox比例风险模型", "medium"),
    ("数据存储仓库", "数据仓库", "high"),
    ("高性能计算技术", "高性能计算/HPC", "medium"),
    ("信息提取技术", "信息提取", "low"),
    ("机器学习算法模型", "机器学习算法", "low"),
    ("深度卷积神经网络模型", "深度卷积神经网络", "medium"),
    ("长短时记忆神经网络", "LSTM网络", "medium"),
    ("自然语言处理技术", "自然语言处理/NLP", "low"),
    ("计算机辅助诊断系统", "计算机辅助诊断/CAD", "medium"),
    ("图像分割算法技术", "图像分割", "medium"),
    ("特征提取和选择", "特征工程/特征选择", "medium"),
    ("数据增强和扩充", "数据增强", "medium"),
    ("模型训练和优化", "模型训练", "low"),
    ("超参数优化调整", "超参数调优", "medium"),
    ("细胞培养和传代", "细胞培养", "low"),
    ("细胞转染和感染", "细胞转染", "medium"),
    ("质粒构建和转染", "质粒转染", "medium"),
    ("基因敲除和敲低实验", "基因敲除/敲低", "medium"),
    ("蛋白质提取和定量分析", "蛋白提取和定量", "low"),
    ("免疫荧光染色分析", "免疫荧光染色", "medium"),
    ("免疫共沉淀实验分析", "免疫共沉淀/Co-IP", "medium"),
    ("染色质免疫沉淀测序分析", "ChIP-seq", "high"),
    ("RNA测序和转录组分析", "RNA-seq/转录组分析", "low"),
    ("单细胞RNA测序技术", "单细胞RNA测序/scRNA-seq", "medium"),
    ("回顾性队列研究分析", "回顾性队列研究", "low"),
    ("前瞻性随机对照临床试验", "RCT/随机对照试验", "medium"),
    ("多中心随机双盲安慰剂对照试验", "多中心RCT", "medium"),
    ("生存分析和预后评估", "生存分析", "medium"),
    ("诊断效能评估分析", "诊断效能评估", "medium"),
    ("受试者工作特征曲线分析", "ROC曲线分析", "medium"),
)

#: Words that mark statistical statements in a text.
STATISTICAL_WORDS = ("t检验", "t test", "方差分析", "ANOVA", "卡方", "chi-square", "Mann-Whitney", "Wilcoxon", "Kruskal-Wallis", "正态", "normal", "x̄±s", "mean±SD", "中位数", "median", "IQR")
SOFTWARE = ("SPSS", "SAS", "Stata", "GraphPad", "Prism", "R软件", "R语言", "Excel")

SUSPICIOUS_DOMAINS = ("163.com", "126.com", "qq.com", "sina.com", "sohu.com", "yeah.net", "sina.cn", "aliyun.com", "foxmail.com", "tom.com", "139.com", "189.cn")
ACADEMIC_DOMAINS = (".edu", ".ac.", ".gov", ".org")
RETRACTED_INSTITUTIONS = ("济宁市第一人民医院", "沧州市中心医院", "河南大学淮河医院", "潍坊市人民医院", "临沂市人民医院", "新乡医学院第一附属医院", "齐齐哈尔医学院")
LOCAL_HOSPITAL = r"(?:县|区|镇|乡).*医院"
MOLECULAR_WORK = r"(?:细胞|分子|基因|蛋白|RNA|DNA|WB|western|PCR|qPCR|转染|敲除|过表达|免疫组化|流式)"

EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
NAME_AND_NUMBER = r"(?i)^([a-z]{3,}_?[a-z]*)(\d{2,5})@"
ABBREVIATION_AND_NUMBER = r"(?i)^([a-z]{2,6})(\d{3,6})@"
DOI = r"(?U)(10\.\d{4,}/[\w.()-]+)"

#: Coverage (percent) of the five layers by type of data.
COVERAGE = {
    "clinical_table": (100, 100, 100, 100, 100),
    "bar_chart": (85, 100, 100, 100, 50),
    "wet_lab": (0, 50, 100, 100, 25),
    "geo_data": (0, 50, 100, 100, 25),
    "survey": (0, 0, 25, 25, 0),
    "review": (0, 0, 10, 0, 0),
}
OTHER_COVERAGE = (50, 50, 50, 50, 50)

#: How statistical declarations are phrased in a line (case doesn't count).
DECLARATIONS = (
    r"(?:采用|使用|应用|以|用|经|行)\s*(?:SPSS\s*[\d.]+|SAS|Stata|GraphPad\s*Prism\s*[\d.]+|Prism\s*[\d.]+)?\s*[^\s。，]{0,20}?((?:独立样本\s*)?(?:配对\s*)?t\s*(?:检验|test)|单因素分差分析|单因素方差分析|双因素方差分析|重复测量方差分析|方差分析|ANOVA|卡方检验|χ[²2]\s*检验|chi-square|秩和检验|Mann[-\s]Whitney\s*U|Wilcoxon|Kruskal[-\s]Wallis|Fisher\s*精确检验|log[-\s]rank|Kaplan[-\s]Meier|Cox\s*(?:回归|模型)|Pearson\s*(?:相关|相关分析|相关系数)|Spearman\s*(?:相关|等级相关|等级相关分析)|q\s*检验|LSD[-\s]t\s*检验|SNK\s*检验|Tukey\s*检验|Bonferroni)",
    r"(?:各组|组间|两组|多组)[^。]{0,20}(?:比较|分析|采用|用)\s*((?:独立样本\s*)?(?:配对\s*)?t\s*(?:检验|test)|单因素分差分析|单因素方差分析|方差分析|χ[²2]检验|卡方检验|秩和检验|q检验)",
    r"((?:实验数据|计量资料|数据|结果)?以\s*(?:珋)?\s*x̄\s*[±±±]\s*s\s*(?:表示|来表达))",
    r"(?:以|取)\s*P\s*[<＜]\s*(0\.\d+)\s*(?:为|作为)\s*(?:差异)?有?统计学意义",
    r"((?:LSD|SNK|Tukey|Bonferroni|Dunnett|Student-Newman-Keuls|q\s*检验|Newman[-\s]Keuls)\s*(?:法|检验|比较)?)",
    r"((?:SPSS|SAS|Stata|GraphPad\s*Prism|Prism)\s*[\d.]*\s*(?:软件|统计软件|统计学软件))",
)
SIGNIFICANT = r"差异[有具]统计学意义.*?P\s*[<＜]\s*0\.\d+"
NOT_SIGNIFICANT = r"差异无统计学意义.*?P\s*[>＞]\s*0\.\d+"
MARKED_EFFECT = r"明显[高低升降增减].*?P\s*[<＜]\s*0\.\d+"
CONTRADICTION_LOW = r"差异无统计学意义.*?P\s*[<＜]\s*0\.\d+"
CONTRADICTION_HIGH = r"差异[有具]统计学意义.*?P\s*[>＞]\s*0\.\d+"
SWEEPING = r"各时间点[均都]?.*?P\s*[<＜]\s*0\.\d+"

#: Numbers, p values and printed mean ± deviation pairs in a text.
DECIMAL = r"\b(\d+\.(\d+))\b"
NUMBER = r"\b(\d+\.?\d*)\b"
MEAN_SD = r"(\d+\.?\d*)\s*[±]\s*(\d+\.?\d*)"
GROUP_SIZE = r"[nN]\s*[=＝]\s*(\d+)"
P_EXACT_ZERO = r"P\s*=\s*0\.000(?!\d)"
P_BELOW_ZERO = r"P\s*<\s*0\.000"
P_THRESHOLD = r"P\s*<\s*0\.\d+"
P_EXACT = r"P\s*=\s*0\.\d+"
P_PRECISE = r"P\s*=\s*0\.\d{3,}"
P_LIMIT = r"P\s*[<≤]\s*(0\.\d+)"
P_DECLARED = r"(?U)P\s*[<＜]\s*(0\.\d+)"
SIGNIFICANT_WORD = "差异有统计学意义"

#: Words of declared tests and of the checks they need.
T_TEST_WORDS = ("t检验", "t test")
ANOVA_WORDS = ("方差分析", "anova")
NORMALITY_WORD = "正态"
EQUAL_VARIANCE_WORDS = ("方差齐性", "levene", "bartlett")

#: Type of data that a declared method implies: the first whose words the lower-cased text contains.
INFERRED_TYPES = (
    ("categorical_rxc", ("χ²", "χ2", "卡方", "计数", "例数", "构成比", "率")),
    ("survival_time", ("kaplan", "meier", "生存", "cox", "log.rank", "log-rank")),
    ("correlation", ("pearson", "spearman", "相关", "相关系数")),
    ("continuous_paired", ("配对", "前后", "自身对照", "同体")),
    ("continuous_normal_multi_groups", ("多组", "方差分析", "anova", "单因素分差")),
    ("continuous_normal_two_groups", ("两组", "t检验", "t test")),
)

#: Words of each kind of paper, and in how many first characters they are looked for (0: the whole lower-cased text).
REVIEW_WORDS, REVIEW_CHARS = ("综述", "Review", "进展", "Progress"), 200
SURVEY_WORDS, SURVEY_CHARS = ("问卷调查", "问卷", "调查表", "量表", "计数", "例数"), 300
GEO_WORDS = ("geo ", "gse", "tcga", "geo accession", "geo数据集")
WET_LAB_WORDS = ("western blot", "免疫印迹", "western-blot", "wb ")
BAR_CHART_WORDS = ("bar chart", "柱状图", "barplot")
TRIAL_WORDS, TRIAL_CHARS = ("rct", "randomized", "随机对照", "临床试验", "clinical trial"), 500
MEAN_SD_SIGN = r"(?U)[xXx̄\\bar{X}][±±±]\s*[sS]"
MEAN_SD_WORDS = r"(?U)mean\s*±\s*sd"
GRANT_NUMBER = r"(?U)\d{7,10}"
FUNDING_WORDS = ("基金", "funding", "grant", "资助", "NSFC", "国家自然科学")

#: The three short contradiction rules.
SHORT_RULES = (
    ("contradiction", r"差异无统计学意义.*P\s*[<＜]\s*0\.\d+"),
    ("direction", r"差异具有统计学意义.*?P\s*>\s*0\.\d+"),
    ("difference", r"统计学差异.*?P\s*>\s*0\.\d+"),
)

#: Where a paper's identity stands in its first pages.
DOI_FIELD = r"(?U)(?:doi|DOI)[:\s]*([0-9]+\.[0-9]+/[^\s]+)"
AUTHORS_ZH = r"(?U)(?:作者[：:]\s*)([^。\n]{5,300})"
AUTHOR_MARKS = "[0-9①②③④⑤⑥⑦⑧⑨⑩*△#†‡§¶]"
AUTHOR_GAP_ZH = r"(?U)[，,;；\s]+"
AUTHORS_EN = r"(?Ui)(?:Authors?|Author\s*list)[:\s]+([^\n]{20,400})"
AUTHOR_GAP_EN = r"(?U),\s*(?=[A-Z])|\d,\s*|\d\s+(?=[A-Z])"
CAPITAL_AUTHORS = r"(?U)(?:[A-Z]{2,}(?:\s+[A-Z]{2,})?\d{1,2}(?:,\s+|\s+and\s+)){2,}[A-Z]{2,}(?:\s+[A-Z]{2,})?\d{1,2}"
CAPITAL_GAP = r"(?U),\s*|\s+and\s+"
CORRESPONDING_ZH = r"(?U)(?:通讯作者|通信作者)[：:\s]*([^\n]{3,50})"
STARRED_ZH = r"([一-鿿]{2,4})[*△](?:\s|,|，|$)"
CORRESPONDING_EN = r"(?Ui)(?:Correspondence\s*to|Corresponding\s*author)[:\s]*([^\n,]{5,80})"
STARRED_EN = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})[*△#](?:\s|,|\.|$)"
INSTITUTION_ZH = r"(?U)(?:单位|机构)[：:\s]*([^\n]{5,200})"
INSTITUTION_EN = r"(?:Department|Institute|College|University|Hospital|School)[^\n]{5,200}"
JOURNAL_VOLUME = r"(?U)([A-Z][A-Z\s&]+)\s+\d+[:\s]"
JOURNAL_NAME = r"(?:ONCOLOGY|CANCER|NATURE|SCIENCE|CELL|LANCET|BMJ|PLOS|JOURNAL)[A-Z\s]*"
FUNDING_LINE = r"(?:(?:基金项目|基金|资助)|(?:Funding|Grant|Supported\s*by|Acknowledgments?))[：:\s]*([^\n]{5,400})"
FUNDING_NUMBER = r"(\d{7,10})"

#: Author and affiliation lines across papers.
LISTED_AUTHORS_ZH = r"(?:作者|通讯作者|第一作者)[：:]\s*(.+?)(?:[。，;；\n]|$)"
LISTED_AUTHORS_EN = r"([A-Z][a-z]+ (?:[A-Z]\.?\s?)?[A-Z][a-z]+)"
AFFILIATIONS = r"(?:单位|机构|作者单位|affiliation|department)[：:]\s*(.+?)(?:[。\n]|$)"

#: Titles and rows of printed tables.
TABLE_TITLE = r"(?:表\s*\d+|Table\s*\d+|Tab\.?\s*\d+)"
NO_TABLE = "未知表"
GROUP_ROW = r"([一-鿿\w\s\-/]+?)\s+(\d+\.?\d*)\s*±\s*(\d+\.?\d*)"
SERIES_ROW = r"([一-鿿\w-]+)\s+((?:\d+\.?\d*\s*±\s*\d+\.?\d*\s*){3,})"
