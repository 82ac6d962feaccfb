import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import mixing


def slow(rows):
    """rows: (doc_id, source, size) -> (target by source, sorted (doc_id, size, taken))."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), sum(sizes.values()) * 1.5
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if 2 * sizes[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        left -= over
    out = []
    for s in names:
        at = 0
        queue = sorted((hashlib.md5(":".join([mixing.SEED] + [str(d)] * (d is not None)).encode()).hexdigest(), d or 0, n, d) for d, x, n in rows if x == s)
        for *_, n, d in queue:
            room = math.floor(target[s] + 1e-9)
            out.append((d, n, sum(max(0, min(n, room - at - sizes[s] * k)) for k in (0, 1))))
            at += n
    return target, out


@pytest.mark.parametrize("case", range(3))
def test_brute_force(spark, case):
    sources = [["a", "b", "c", None], ["a"], ["é", "z", "Z", "aa", None, ""]][case]
    rows = [(i, sources[(i * i) % len(sources)], (i * 37) % 90) for i in range(200)] + [(7, sources[0], 5), (7, sources[0], 5), (None, None, 4)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, target string")
    got = mixing.mix(docs).collect()
    target, want = slow(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]


def test_order_and_budget(spark, frame, odd):
    docs = odd.withColumn("size", mixing.word_count(F.col("text")))
    copies = mixing.mixed_copies(docs).collect()
    times = [r.virtual_finish for r in copies]
    assert times == sorted(times)
    mixed = mixing.mix(docs)
    assert sum(r.words for r in copies) == mixed.agg(F.sum("taken")).first()[0]
    assert mixed.count() == 8
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("doc_id = 2")).first().target == 0


def test_word_count(spark, frame):
    texts = [None, "", " ", "a b\tc\nd\x0be\x0cf\rg", "a\u00a0b\x1cc", "x" * 50000]
    docs = frame([(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.n for r in docs.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
