"""Properties over generated texts, without Spark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyglass.llm import language, quality, simhash, spotsigs

from .test_language import slow_bundle
from .test_simhash import slow_fingerprint
from .test_spotsigs import jaccard, slow_signatures

words = st.sampled_from(["the", "of", "und", "la", "Ab", "zug", "été", "x1", "!!", " ", "\n", "\t", "日本", "😀", ""])
texts = st.lists(words, max_size=30).map(" ".join) | st.text(max_size=40)


@settings(deadline=None, max_examples=60)
@given(texts)
def test_fingerprint(text):
    if "\ud800" <= max(text, default="") <= "\udfff":
        return
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == slow_fingerprint(text)


@settings(deadline=None, max_examples=60)
@given(texts, texts)
def test_signatures(a, b):
    x, y = spotsigs.signatures(a), spotsigs.signatures(b)
    assert len(x) == len(slow_signatures(a))
    assert abs(spotsigs.likeness(x, y) - jaccard(slow_signatures(a), slow_signatures(b))) < 1e-12
    assert np.array_equal(x, spotsigs.signatures(a))


@settings(deadline=None, max_examples=20)
@given(st.lists(texts, min_size=1, max_size=4))
def test_bundles_do_not_depend_on_the_batch(batch):
    rows = language.bundles(batch)
    for t, row in zip(batch, rows, strict=True):
        assert np.array_equal(row, slow_bundle(t))


@settings(deadline=None, max_examples=60)
@given(texts)
def test_token_numbers(text):
    n = quality.numbers(text, {"the": quality.FIRST_WORD})
    assert len(n) == len(quality.TOKEN.findall(text))
    k = quality.keys(3, n)[3]
    padded = [quality.START, quality.START, *n.tolist(), quality.END]
    triples = list(zip(padded, padded[1:], padded[2:], strict=False))
    assert len(k) == len(n) + 1 and len(set(zip(triples, k.tolist(), strict=True))) == len(set(triples)) == len(set(k.tolist()))
    assert not set(k.tolist()) & set(quality.keys(4, n)[3].tolist())
