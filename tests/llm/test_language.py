import tracemalloc
import zlib

import numpy as np

from tallyglass.llm import language


def slow_bundle(text):
    vec = lambda c: np.random.default_rng([language.SEED, c]).integers(0, 2, language.DIM, dtype=np.int8) * 2 - 1
    out, s = np.zeros(language.DIM), [0]
    for c in (text or "").lower():
        if c.isalpha():
            s.append(ord(c))
        elif s[-1]:
            s.append(0)
    if s[-1]:
        s.append(0)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c)
    return out


def test_bundles_by_hand():
    texts = ["Hello, wörld!", None, "", "a", "123 --", "été ÉTÉ", " x", "日本語 テキスト", "ab" * 300]
    got = language.bundles(texts)
    for t, row in zip(texts, got, strict=True):
        assert np.array_equal(row, slow_bundle(t)), t
    assert np.array_equal(language.bundles(texts[5:6])[0], got[5])


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(language, "_CHUNK_CHARS", 7)
    monkeypatch.setattr(language, "_TRIGRAMS", 5)
    texts = ["some words,  and -- more of them!", "ab", None, "日本語のテキスト" * 4, " leading gap, trailing gap  ", "éé éé 12 " * 9, "x" * 50]
    for t, row in zip(texts, language.whole_bundles(texts), strict=True):
        assert np.array_equal(row, slow_bundle(t)), t


def test_memory_of_a_long_text():
    """A million characters of 6,000 letters: most trigrams occur once."""
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 6000, 1_000_000)))
    tracemalloc.start()
    language.whole_bundles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000


def test_predictions_by_hand(spark, frame):
    """Prototypes are sums of unit bundles of the documents learned from, predictions the nearest of them; nulls, ties, repeats and clashing names."""
    texts = {"de": ["der Hund und die Katze", "nicht auf der Wiese"], "en": ["the dog and the cat", "with that of those"], None: ["ohne", "the"]}
    docs = [(i * 2 + k, t, x, None) for i, (x, ts) in enumerate(list(texts.items()) * 6) for k, t in enumerate(ts)]
    for d in (*range(3), 7):
        docs += [(900 + d, ["katze und hund", "", "123", None, "The those"][d % 5], "de", None)] * 2
    learn = [(t, x) for d, t, x, _ in docs if x and zlib.crc32(str(d).encode()) % 3 != 1]
    unit = lambda v: v / np.linalg.norm(v)
    proto = {x: unit(sum(unit(slow_bundle(t)) for t, y in learn if y == x and slow_bundle(t).any())) for x in ("de", "en")}
    clash = frame(docs).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "lang_pred")
    for r in language.identify(clash).collect():
        text = next(t for d, t, _, _ in docs if d == r.doc_id)
        b = slow_bundle(text)
        want = max(("de", "en"), key=lambda x: unit(b) @ proto[x]) if b.any() else "und"
        assert r.lang_pred == want and abs(r.score - (max(0, unit(b) @ proto[want]) if b.any() else 0)) < 1e-4


def test_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op4_language(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, frame):
    docs = [(i, "der die das und nicht" if i % 2 else "the and with that", "de" if i % 2 else "en", "s") for i in range(40)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else x, None) for i, t, x, _ in docs]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(x)).collect()} for x in (docs, wrong))
    assert a == b
    assert {p for p, _ in a.values()} == {"de", "en"}


def test_odd_rows(odd):
    rows = language.identify(odd).collect()
    assert len(rows) == 8
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 5)} == {"und"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.identify(odd.where("false")).count() == 0
    assert {r.lang_pred for r in language.classify(odd, [], np.zeros((0, language.DIM))).collect()} == {"und", None}
