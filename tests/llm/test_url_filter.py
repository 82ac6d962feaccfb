import re

from tallyglass.llm import url_filter as u


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = lambda r: host and ("." + host).endswith("." + r[0]) and path.startswith(r[1])
    base = max((r for r in u.BASE_RULES if fits(r)), key=lambda r: len(r[0] + r[1]), default=None)
    own = any(fits(r) for r in u.EXTRA_RULES)
    return host, path, base and base[0] + base[1], base[2] if base else "block" if own else "allow"


URLS = [
    None, "", "no scheme /en/7", "http://COM/en/", "http://com/en/x", "http://a.example.com/en/7", "http://example.com/en/77?q=/de/", "http://xexample.com/en/7",
    "http://notcom/en/", "https://b.example.net/de/81#x", "https://net/de/8", "http://q.org/es/", "http://q.org/ES/", "http://www.spam-farm.example.org", "http://spam-farm.example.org?x",
    "a://b://c.com/en/", "http://.com/en/", "http://com./en/", "http://c.com", "http://ÄB.com/en/é", "http://u@c.com:80/en/", "://com/en/", "http:///en/", "http://" + "a." * 400 + "com/en/" + "x" * 5000,
]


def test_brute_force(spark):
    rows = [(i, x, "extra") for i, x in enumerate(URLS)] + [(3, URLS[3], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(pages, u.default_rules(spark)).collect()}
    assert got == {i: slow(x) for i, x in enumerate(URLS)}
    assert u.judge_urls(pages, u.default_rules(spark)).count() == len(rows)
    assert u.judge_urls(pages.where("false"), u.default_rules(spark)).count() == 0


def test_many_rules_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(u, "BROADCAST_RULES", 2)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(pages, u.default_rules(spark)).collect()}
    assert got == {i: slow(x) for i, x in enumerate(URLS)}


def test_driver_pages(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.op3_url_filter(spark, sf).collect()}
    assert got == {i: slow(x) for i, x in urls.items()}


def test_rules_from_a_list(spark, tmp_path):
    rows = [("*.Bad.example", None, "Block"), (".worse.example", "/x", "block"), ("ok.bad.example", "", "allow"), (None, "/y", "block"), ("odd.example", "", "perhaps")]
    frame = spark.createDataFrame(rows, "host string, path string, verdict string")
    frame.write.parquet(str(tmp_path / "list"))
    frame.write.csv(str(tmp_path / "list.csv"))
    urls = ["http://a.bad.example/", "http://ok.bad.example/z", "http://worse.example/y", "http://worse.example/xy", "http://odd.example/", "http://com/en/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for path in ("list", "list.csv"):
        got = {r.page_id: (r.rule, r.verdict) for r in u.judge_urls(pages, u.read_rules(spark, str(tmp_path / path))).collect()}
        assert got == {0: (None, "block"), 1: (None, "allow"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "allow"), 5: ("com/en/", "block"), 6: (None, "allow")}
