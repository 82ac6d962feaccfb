import random
import re

import numpy as np
import xxhash

from tallyglass.llm import components, resemblance, simhash


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps):
    """doc -> smallest doc reachable."""
    best = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and best[b] < best[a]:
                    best[a], changed = best[b], True
    return best


def test_driver_documents(spark, sf):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op10_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    want = slow_components(fps)
    assert got == {d: (fps[d], want[d]) for d in fps}


def test_dense_groups_and_chains(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {0: base}
    for i in range(1, 160):
        x = base if i < 90 else fps[rng.choice(list(fps))]
        for b in rng.sample(range(64), rng.choice((1, 2, 3))):
            x ^= 1 << b
        fps[i] = x
    fps |= {200 + i: rng.getrandbits(64) for i in range(60)}
    classes = {}
    for d, f in fps.items():
        classes.setdefault(f, d)
    rows = [(f - (1 << 64) if f >> 63 else f, d) for f, d in classes.items()]
    links = simhash.near_duplicate_links(spark.createDataFrame(rows, "fp long, doc long"))
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    best = slow_components({d: f for f, d in classes.items()})
    assert {d: got.get(d, d) for d in best} == best


def test_components_in_one_task_and_by_rounds(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    best, changed = {x: x for a, b in links if None not in (a, b) and a != b for x in (a, b)}, True
    while changed:
        changed = False
        for a, b in links:
            if a in best and b in best and best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    frame = spark.createDataFrame(links, "a long, b long")
    for most in (components.ONE_TASK, 0):
        monkeypatch.setattr(components, "ONE_TASK", most)
        rows = components.connected_components(frame).collect()
        assert len(rows) == len(best) and {r.node: r.component for r in rows} == best
        assert components.connected_components(frame.where("false")).count() == 0


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    y = x ^ (np.uint32(1) << rng.integers(0, 32, 500, dtype=np.uint32))
    for a, b in zip(x, y, strict=True):
        assert set(simhash.anchors(np.array([a]))[1].tolist()) & set(simhash.anchors(np.array([b]))[1].tolist())
    assert np.bincount(simhash.anchors(x)[0]).max() <= 17


def test_odd_rows(odd, spark):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 8
    assert {r[2] for r in got if r[1] == 0} == {1}
    assert {r[2] for r in got if r[0] in (4, 6)} == {4}
    assert sum(r[0] == 3 for r in got) == 2
    assert simhash.near_duplicates(odd.where("false")).count() == 0
    clash = odd.withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id").withColumnRenamed("n_chars", "component")
    for resemblance in (None, 0.8):
        assert simhash.near_duplicates(clash, resemblance).count() == 8
        assert simhash.near_duplicates(odd.where("false"), resemblance).count() == 0


def test_resembling_copies_are_found(frame):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, truth = [], {}
    for g in range(25):
        w = [word() for _ in range(120)]
        for c in range(3):
            v = list(w)
            if c:
                v[rng.randrange(len(v))] = word()
            rows.append((g * 10 + c, " ".join(v), None, None))
            truth[g * 10 + c] = g * 10
    rows += [(500, "short text", None, None), (501, "short words", None, None)]
    few = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows)).collect()}
    many = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows), 0.8).collect()}
    caught = lambda found: sum(found[d] == t for d, t in truth.items())
    assert caught(few) < caught(many) == len(truth)
    assert all(many[d] // 10 == d // 10 for d in truth)
    assert all(many[d] <= few[d] for d in few)
    assert (many[500], many[501]) == (500, 501)


def test_every_resembling_pair_is_linked(frame, monkeypatch):
    """By bands of resemblance against brute force, in dense groups of near copies too; fingerprints that never meet change nothing."""
    from .test_decontaminate import shingles

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(12)]
    rows = []
    for g in range(12):
        w = [word() for _ in range(100)] + passage
        for c in range(6):
            v = list(w)
            for _ in range(c * (g % 3 + 1) // 2):
                v[rng.randrange(100)] = word()
            rows.append((g * 10 + c, " ".join(v), None, None))
    rows += [(300, rows[0][1], None, None), (301, "few words", None, None), (302, None, None, None)]
    sets = {d: shingles(t) for d, t, _, _ in rows}
    near = lambda a, b: bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    fps = {d: slow_fingerprint(t) for d, t, _, _ in rows}
    best, changed = {d: d for d in fps}, True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if best[b] < best[a] and ((fps[a] ^ fps[b]).bit_count() <= 3 or near(a, b)):
                    best[a], changed = best[b], True
    for common in (100_000, 1):
        monkeypatch.setattr(resemblance, "COMMON", common)
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows), 0.8).collect()}
        bands = {}
        for a in sets:
            for b in sets:
                if a < b and near(a, b):
                    bands.setdefault(int(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) * 20), []).append(found[a] == found[b])
        assert {16, 17, 18} <= set(bands)
        assert {k: sum(v) / len(v) for k, v in bands.items()} == dict.fromkeys(bands, 1.0)
        assert found == best


def test_bitmaps_never_rule_out_what_resembles():
    rng = np.random.default_rng(7)
    ruled_out = 0
    for _ in range(400):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(1, 900)))
        b = np.unique(np.r_[rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 300))])
        both = resemblance.share(a, b)
        assert both == len(np.intersect1d(a, b))
        x, y = (np.frombuffer(resemblance._bitmap(v), np.uint8) for v in (a, b))
        may = resemblance._may_resemble(len(a), x, len(b), y, 0.8)
        assert may or both < 0.8 * (len(a) + len(b) - both)
        ruled_out += not may
    assert ruled_out > 200
