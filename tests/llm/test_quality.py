import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from tallyglass.functions.storage import shared_dir
from tallyglass.llm import quality as q


def slow_model(texts, vocabulary, words):
    """texts: (lang, text) -> p(lang, u, v, w) by the book."""
    c3 = Counter()
    for lang, text in texts:
        s = [0, 0, *q.numbers(text, vocabulary).tolist(), 1]
        c3.update((lang, *s[i : i + 3]) for i in range(len(s) - 2))
    c2 = Counter((lang, v, w) for lang, u, v, w in c3)
    c1 = Counter((lang, w) for lang, v, w in c2)

    def off(counts):
        n = Counter(min(c, 5) for c in counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.75 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]

    def level(counts):
        d, by = off(counts), defaultdict(list)
        for k, c in counts.items():
            by[k[:-1]].append(c)

        def p(key, lower):
            here = by.get(key[:-1])
            if not here:
                return lower
            c, total = counts.get(key, 0), sum(here)
            own = (c - d[min(c, 3) - 1]) / total if c else 0
            return own + sum(d[min(x, 3) - 1] for x in here) / total * lower

        return p

    p3, p2, p1 = level(c3), level(c2), level(c1)
    return lambda lang, u, v, w: p3((lang, u, v, w), p2((lang, v, w), p1((lang, w), 1 / words)))


@pytest.mark.parametrize("block", [40, 10_000])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(q, "BLOCK_TOKENS", block)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "Cat", "dogs", "runs", "RUNS", "x1", "12", "!!", "é"]) for _ in range(rng.randint(0, 40)))
    docs = [(i, text(), rng.choice(["en", "de", None])) for i in range(60)] + [(60, None, "en"), (61, "", "xx"), (61, "some", "xx"), (None, text(), "de")]
    vocabulary = {w: q.FIRST_WORD + i for i, w in enumerate(["the", "of", "and", "runs", "!!"])}
    langs = {x: q.language_key(x) for x in ("en", "de", "xx", None)}
    words = q.FIRST_WORD + len(vocabulary)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    encoded = q.encode(frame, vocabulary)
    counts = q.count_trigrams(encoded.where("doc_id % 3 = 0"))
    p = slow_model([(langs[x], t) for d, t, x in docs if d is not None and d % 3 == 0], vocabulary, words)
    want = []
    for d, t, x in docs:
        s = [0, 0, *q.numbers(t, vocabulary).tolist(), 1]
        logs = [math.log(p(langs[x], *s[i : i + 3])) for i in range(len(s) - 2)]
        want.append((d, len(s) - 3, round(math.exp(-sum(logs) / len(logs)), 6) if len(s) > 3 else None))
    got = sorted(((r.doc_id, r.n_tokens, r.perplexity) for r in q.perplexities(encoded, counts, words).collect()), key=lambda r: str(r[:2]))
    want = sorted(want, key=lambda r: str(r[:2]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == [r[2] and pytest.approx(r[2], rel=1e-5) for r in want]


def test_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = q.op7_quality(spark, sf).collect()
    good = [r.keep for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.keep for r in rows if labels.get(r.doc_id) == 0]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(good) / len(good) >= 0.95
    assert sum(bad) / len(bad) < 0.2


def test_keys_are_those_of_spark(spark):
    tokens = q.numbers("The cat, the Cat", {})
    assert (q._unpack(q._pack(tokens)) == tokens).all() and not len(q._unpack(q._pack(tokens[:0])))
    s = [0, 0, *tokens.tolist(), 1]
    rows = [(5, *s[i : i + 3]) for i in range(len(s) - 2)]
    want = spark.createDataFrame(rows, "l long, u long, v long, w long").selectExpr("xxhash64(l, w)", "xxhash64(l, v, w)", "xxhash64(l, u, v, w)", "xxhash64(l)").collect()
    k0, k1, k2, k3 = q.keys(5, tokens)
    assert [tuple(r) for r in want] == [(*r, k0[0]) for r in zip(k1[1:].tolist(), k2[1:].tolist(), k3.tolist(), strict=True)]


def test_invented_and_repeated_words_are_noticed(spark):
    """Junk of ordinary shapes: invented content words, one rare word over and over, shuffled words."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    known = [word() for _ in range(600)]
    after = {w: rng.choices(known, k=3) for w in known}

    def prose():
        w = [rng.choice(known)]
        while len(w) < 80:
            w.append(rng.choice(after[w[-1]]))
        return w

    trusted = [prose() for _ in range(400)]
    new = [prose() for _ in range(40)]
    junk = [[word() for _ in range(80)] for _ in range(20)] + [[rng.choice(known)] * 80 for _ in range(20)] + [rng.sample(w, len(w)) for w in new[:20]]
    texts = [" ".join(w) for w in trusted + new + junk]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(trusted))], "doc_id long, quality int")
    keep = {r.doc_id: r.keep for r in q.classify(docs, labels).collect()}
    at = len(trusted) + len(new)
    assert sum(keep[i] for i in range(len(trusted), at)) >= 36
    assert [sum(keep[i] for i in range(at + k, at + k + 20)) for k in (0, 20, 40)] == [0, 0, 0]


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 1), (3, None), (3, 1), (None, 1)], "doc_id long, quality int")
    rows = q.classify(odd, labels).collect()
    assert len(rows) == 8
    assert all(not r.keep and r.perplexity is None for r in rows if r.doc_id in (1, 2, 5))
    assert q.classify(odd, labels.where("false")).count() == 8
    assert q.classify(odd.where("false"), labels).count() == 0
    clash = odd.withColumnRenamed("source", "perplexity").withColumnRenamed("n_chars", "keep")
    assert q.classify(clash, labels.withColumn("lang", labels["quality"])).count() == 8


def test_packed_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) if n else np.zeros(0, np.uint64))
        assert (q._unpack_keys(q._pack_keys(keys)) == keys).all() and len(q._unpack_keys(q._pack_keys(keys))) == len(keys)
    shard = keys >> np.uint64(7)
    assert len(q._pack_keys(shard)) < 6 * len(keys)
    ends = np.array([0, 5, (1 << 64) - 1], np.uint64)
    assert (q._unpack_keys(q._pack_keys(ends)) == ends).all()


def test_rounds_agree_and_leave_only_scores(spark, monkeypatch):
    """Counting and scoring in rounds change nothing, and of the tables on the way nothing stays on disk."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    where = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in where.rglob("*") if p.is_file())
    before = size()
    one = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert size() - before < 300_000
    monkeypatch.setattr(q, "ROUND_ROWS", 400)
    three = q.classify(docs, labels).collect()
    assert len(three) == len(one) == docs.count()
    assert [r.perplexity for r in three] == [pytest.approx(one[r.doc_id].perplexity, rel=1e-9) for r in three]
    assert [r.keep for r in three] == [one[r.doc_id].keep for r in three]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tallyglass")]
