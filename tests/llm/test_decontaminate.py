import random
import re

import pytest

from tallyglass.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def runs(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def slow(docs, items):
    s = {i: shingles(t) or (runs(t, runs(t, 1)[1])[0] if runs(t, 1)[1] else set()) for i, t in items if i is not None}
    size = {i: min(5, runs(t, 1)[1]) for i, t in items if i is not None}
    out = {}
    for doc, text in docs:
        by = {n: runs(text, n)[0] for n in set(size.values()) if n}
        for i, q in s.items():
            have = by.get(size[i], set())
            if doc is not None and q and len(q & have) / len(q) >= 0.8:
                out[doc, i] = max(out.get((doc, i), 0), len(q & have) / len(q))
    return out


def run(spark, docs, items):
    a = spark.createDataFrame([(*r, "clash", 1, 2) for r in docs], "doc_id long, text string, item_id string, containment int, hash int")
    b = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id long, size string")
    rows = d.contained(a, b).collect()
    got = {(r.doc_id, r.item_id): pytest.approx(r.containment) for r in rows}
    assert len(got) == len(rows)
    return got


def cases(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([4, 5, 6, 9, 14, 20, 40, 90, 300, 700])] + [(50, None), (51, ""), (None, text(9)), (52, "no " * 30), (53, "the of and"), (54, "Xylem!")]
    docs = [(100, None), (101, ""), (102, "short, xylem"), (104, "a the of and b"), (None, items[5][1])]
    for k, (i, t) in enumerate(items[:10]):
        docs.append((k, f"{text(80)}. {t}!? {text(400)}"))
        w = t.split()
        w[rng.randrange(len(w))] = "CHANGED"
        docs += [(20 + k, text(30) + " " + " ".join(w)), (40 + k, t.upper()), (60 + k, " ".join(w[: len(w) * 3 // 4]))]
    docs += [(0, "another row of the same id"), (5, items[5][1]), (5, items[5][1]), (103, text(20000) + " " + items[4][1] + " " + items[8][1])]
    return docs, items


def test_brute_force(spark, monkeypatch):
    docs, items = cases()
    want = slow(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items) == want
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(d, "SHARED", 0)
    assert run(spark, docs, items) == want
    assert run(spark, [], items) == {} == run(spark, docs, [])


def test_driver_tables(spark, sf):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    want = slow(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert {(r.doc_id, r.item_id): pytest.approx(r.containment) for r in d.op9_decontaminate(spark, sf).collect()} == want
