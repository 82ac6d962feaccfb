import re
from collections import Counter

import corpus_pipeline as p
from tallyglass.llm.common import table

from .test_decontaminate import shingles
from .test_decontaminate import slow as slow_contained
from .test_mixing import slow as slow_mix
from .test_secrets import slow as slow_secrets
from .test_simhash import slow_components, slow_fingerprint


def test_stages_against_brute_force(spark, sf):
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    docs = table(spark, sf, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    got = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf).cache()
        got.append((name, docs.columns, docs.collect()))
    letters = {d for d, r in before.items() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in got[0][2]} == letters
    best = slow_components({d: slow_fingerprint(before[d].text) for d in letters})
    base = {d for d in letters if best[d] == d}
    one = {r.doc_id for r in got[1][2]}
    assert one <= base and len(got[1][2]) == len(one)
    sets = {d: shingles(before[d].text) for d in letters}
    for d in base - one:
        near = [x for x in letters if x != d and best[x] != d and sets[x] & sets[d] and len(sets[x] & sets[d]) >= 0.8 * len(sets[x] | sets[d])]
        assert near, d
    leaks = {d for d, _ in slow_contained([(d, before[d].text) for d in one], bench)}
    assert leaks
    assert {r.doc_id for r in got[2][2]} == one - leaks
    clean = {r.doc_id: r for r in got[3][2]}
    assert set(clean) == one - leaks
    for d, r in clean.items():
        assert slow_secrets(r.text)[:3] == (0, 0, 0)
        assert (r.text == before[d].text) == (sum(slow_secrets(before[d].text)[:3]) == 0 or "[SECRET]" not in r.text)
        assert r.n_chars == len(r.text)
    assert any("[SECRET]" in r.text for r in clean.values()) or sum(sum(slow_secrets(before[d].text)[:3]) for d in clean) == 0
    assert all(columns == list(p.COLUMNS) for _, columns, _ in got[:-1])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    _, want = slow_mix([(d, r.source, size(r.text)) for d, r in clean.items()])
    taken = Counter()
    for r in got[4][2]:
        taken[r.doc_id] += r.words
        assert size(r.text) == r.words
    assert taken == Counter({d: t for d, _, t in want if t})


def test_run_and_odd_rows(spark, sf, odd):
    docs = odd
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() >= 1
    empty = odd.where("false")
    for _, stage in p.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
    assert p.drop_near_duplicates(spark, odd, sf).where("doc_id = 3").count() == 1
    assert p.run(spark, sf).count() > 50
