import math
import random
import zlib

import numpy as np

from tallyglass.llm import toxicity as t


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    rows = []
    for i in range(n):
        s = [" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 30))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            k = rng.randrange(len(s))
            s[k] += " " + rng.choice(["zorgo", "blarg", "krumpf"])
        rows.append((i, ". ".join(s) + ".", toxic))
    return rows


def test_held_out_accuracy_and_sentences(spark, frame):
    rows = corpus()
    docs = frame([(i, x, None, None) for i, x, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5], "doc_id long, toxic int")
    weights, bias = t.fit(docs, labels)
    text = {i: x for i, x, _ in rows}
    held = {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    good = 0
    for r in t.score(docs, weights, bias).collect():
        by_hand = 1.0
        for _, _, w in t.sentence_words(text[r.doc_id]):
            by_hand *= 1 - 1 / (1 + math.exp(-bias - sum(weights.get(f, 0) for x in w for f in t._features(x))))
        assert abs(r.score - (1 - by_hand)) < 1e-9
        for s in r.offending:
            assert any(x in text[r.doc_id][s.start : s.end] for x in ("zorgo", "blarg", "krumpf"))
        if r.doc_id in held:
            good += (r.score >= 0.5) == held[r.doc_id]
    assert good / len(held) > 0.95


def slow_train(bags, labels, size):
    """The proximal AdaGrad of the noisy-or's mean log-likelihood, a number at a time."""
    n, w, b = len(labels), [0.0] * size, -5.0
    for epochs, l1 in ((t.EPOCHS, t.L1_DOCUMENTS / n), (t.REFIT, 0.0)):
        keep = [i for i in range(size) if w[i] or l1]
        gw, gb = [1e-8] * size, 1e-8
        for _ in range(epochs):
            step, up = [0.0] * size, 0.0
            for sentences, y in zip(bags, labels, strict=True):
                z = [b + sum(w[f] for f in s if f in keep) for s in sentences]
                p = [1 / (1 + math.exp(-x)) for x in z]
                none = math.prod(1 - x for x in p)
                push = none / max(1 - none, 1e-9) * (1 if l1 else t.TOXIC_WEIGHT)
                for s, x in zip(sentences, p, strict=True):
                    g = (push if y else -1) * x / n
                    up += g
                    for f in s:
                        if f in keep:
                            step[f] += g
            gb += up * up
            for i in keep:
                gw[i] += step[i] ** 2
                rate = t.RATE / math.sqrt(gw[i])
                w[i] += rate * step[i]
                w[i] = math.copysign(max(abs(w[i]) - rate * l1, 0), w[i])
            b += t.RATE / math.sqrt(gb) * up
    return w, b


def test_training_by_hand():
    rng = random.Random(3)
    bags = [[sorted(rng.sample(range(6), rng.randint(0, 4))) for _ in range(rng.randint(1, 4))] for _ in range(30)]
    labels = [int(any(5 in s for s in b)) for b in bags]
    packed = [(np.array([f for s in b for f in s], np.int32), np.array([len(s) for s in b], np.int32)) for b in bags]
    w, b = t.train(packed, labels, 6)
    slow_w, slow_b = slow_train(bags, labels, 6)
    assert np.allclose(w, slow_w, atol=1e-6) and abs(b - slow_b) < 1e-6
    assert w[5] == max(w) > 0
    assert t.train(packed, [0] * 30, 6)[1] == -50 and t.train([], [], 6)[1] == -50


def test_bounds_ties_and_clashing_names(spark, frame):
    """Repeated ids with other texts, names of the results among the columns, and fewer characters than the labelled texts have."""
    rows = corpus(120, 5)
    docs = [(i, x, None, None) for i, x, _ in rows] + [(i, x[::-1], None, None) for i, x, _ in rows[:10]]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    clash = frame(docs).withColumnRenamed("lang", "score").withColumnRenamed("source", "toxic").withColumnRenamed("n_chars", "offending")
    one = t.fit(clash, labels)
    assert one == t.fit(clash.repartition(3), labels)
    assert t.score(clash, *one).count() == len(docs)
    few = t.fit(clash, labels, max_chars=3000)
    assert few != one and t.score(clash, *few).count() == len(docs)


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.fit(odd, none)[0] == {}
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    rows = t.score(odd, *t.fit(odd, labels)).collect()
    assert len(rows) == 8
    assert all(r.score == 0 for r in rows if r.doc_id in (1, 2, 5))
    assert all(0 <= r.score <= 1 for r in rows)
    assert t.score(odd.where("false"), {}, 0.0).count() == 0


def test_query(spark, sf):
    rows = t.op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
