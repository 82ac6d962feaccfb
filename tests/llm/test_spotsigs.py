import hashlib
import random

import numpy as np
import pytest
import xxhash

from tallyglass.llm import spotsigs as s

WORDS = ["the", "of", "and", "is"]


def slow_signatures(text):
    w = s.WORD.findall((text or "").lower())
    content = [i for i, x in enumerate(w) if x not in s.ANCHORS]
    out, found = set(), 0
    for i, x in enumerate(w):
        after = [j for j in content if j > i][:2]
        if x in s.ANCHORS and len(after) == 2:
            out.add(f"{x}:{w[after[0]]} {w[after[1]]}")
            found += 1
    if w and (not out or (len(w) > s.SPARSE and found * s.SPARSE < len(w))):
        return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choices("abcdef", k=5)) for _ in range(n))


def slow_rows(docs):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest(r[1])))
    out = []
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = map(slow_signatures, (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(b), jaccard(a, b), jaccard(a, c)))
    return out


def slow_classes(docs):
    """id -> smallest id reachable: an id's texts, equal texts and texts that resemble each other by 0.8 are linked."""
    sig = [(d, t or "", slow_signatures(t)) for d, t in docs]
    near = lambda a, b: a[0] == b[0] or a[1] == b[1] or (a[2] and b[2] and jaccard(a[2], b[2]) >= 0.8)
    best, changed = {d: d for d, _ in docs}, True
    links = [(a[0], b[0]) for a in sig for b in sig if near(a, b)]
    while changed:
        changed = False
        for a, b in links:
            if best[b] < best[a]:
                best[a], changed = best[b], True
    return best


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_query_brute_force(spark, frame, tmp_path, monkeypatch, size):
    monkeypatch.setattr(s, "ROWS_A_RANGE", size)
    rng = random.Random(2)
    docs = [(i * 7 % 41 - 5, prose(rng, rng.randint(0, 40))) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "é😀" * 3), (53, "the"), (54, docs[0][1]), (54, docs[0][1]), (54, "zz top"), (None, "no id"), (None, None), (None, "more without an id"), (55, prose(rng, 4000))]
    frame([(d, t, None, None) for d, t in docs]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = s.op6_spotsigs(spark, str(tmp_path)).collect()
    by = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint), len(r.edited_fingerprint), r.near_edited, r.near_next) for r in rows), key=by)
    want = sorted(slow_rows(docs), key=by)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])
    best = slow_classes([(d, t) for d, t in docs if d is not None])
    assert all(r.class_id == best.get(r.doc_id) for r in rows)


def test_empty_and_single(spark, frame, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert s.op6_spotsigs(spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(9, "the one text of all")], "doc_id long, text string")
    one.write.parquet(str(tmp_path / "b/documents.parquet"))
    assert s.op6_spotsigs(spark, str(tmp_path / "b")).first().near_next == 1


def test_duplicates_brute_force(spark, frame):
    rng = random.Random(4)
    docs = []
    for i in range(12):
        w = prose(rng, 120).split()
        for k in range(5):
            v = list(w)
            for _ in range(k * 2):
                v[rng.randrange(len(v))] = "x" + "".join(rng.choices("ghij", k=4))
            docs.append((i * 10 + k, " ".join(v)))
    docs += [(500, docs[3][1]), (501, None), (502, ""), (500, docs[3][1])]
    docs += [(600 + i, f"word{i} the") for i in range(4)]
    rows = s.duplicates(frame([(d, t, None, None) for d, t in docs])).collect()
    assert len(rows) == len({d for d, _ in docs})
    best = slow_classes(docs)
    assert len(set(best.values())) < len(best) - 20
    assert {r.doc_id: r.class_id for r in rows} == best
    assert s.duplicates(frame([])).count() == 0


def test_odd_rows(odd, spark, tmp_path):
    odd.withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "class_id").withColumnRenamed("n_chars", "key").write.parquet(str(tmp_path / "documents.parquet"))
    rows = s.op6_spotsigs(spark, str(tmp_path)).collect()
    assert len(rows) == 8
    assert {r.class_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.class_id for r in rows if r.doc_id in (4, 6)} == {4}
    assert [r.class_id for r in rows if r.doc_id is None] == [None]


def test_word_hashes(monkeypatch):
    """Equal words have equal hashes wherever they stand, others have others, and parts of a long text give the same."""
    rng = random.Random(8)
    text = " ".join(rng.choice(["the", "été", "日本語", "a1", "x" * 30, "the_end", "ab", "ba", "don't", "½"]) + rng.choice([",", "", "-", "\n"]) for _ in range(400)).lower()
    words = s.WORD.findall(text)
    h = s.word_hashes(text).tolist()
    assert len(h) == len(words) and len(dict(zip(words, h, strict=True))) == len(set(zip(words, h, strict=True))) == len(set(h))
    monkeypatch.setattr(s, "CHUNK_CHARS", 40)
    assert s.word_hashes(text).tolist() == h


def test_few_anchors():
    words = [f"w{i}" for i in range(200)]
    text, edited = " ".join(["the", *words]), " ".join(["the", *words[:100], *(f"x{i}" for i in range(100))])
    late = s.signatures(" ".join([*words, "the"]))
    assert len(late) == 200 and s.likeness(late, s.signatures("")) == 0
    assert len(s.signatures(text)) == 200 and s.likeness(s.signatures(text), s.signatures(edited)) < 0.5
