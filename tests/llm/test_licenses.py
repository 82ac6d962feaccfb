import re

from tallyglass.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None,
    "",
    "nothing here",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. Released under the MIT License. The MIT-license; mit licenses",
    "gnu general public",
    "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0! apache\u00a0license Apache  license",
    "é mit license ＭＩＴ license cc cc by by",
    "word " * 30000 + "Licensed under the Apache License, Version 2.0. " * 3 + "tail " * 100,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in it without restriction",
    "free charge person obtaining copy software files deal restriction",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_base(text):
    w = WORD.findall(lower(text))
    at = [(i, label) for p, label in li.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def slow_matches(text, index):
    w = WORD.findall(lower(text))
    at = lambda i: w[i] if 0 <= i < len(w) else None
    found = []
    for t, (label, template, phrases) in enumerate(li.TEMPLATES):
        own = [(p, word, weight) for word, k, p, weight in index if k == t]
        tw = li.template_words(template)
        for d in sorted({i - p for i, x in enumerate(w) for p, word, _ in own if x == word}):
            s = sum(weight for p, word, weight in own if any(at(d + p - k) == word for k in range(li.SLACK + 1)))
            good = True
            for phrase in phrases:
                p = phrase.split()
                o = next(i for i in range(len(tw)) if tw[i : i + len(p)] == p)
                good &= any(d + o + k >= 0 and w[d + o + k : d + o + k + len(p)] == p for k in range(-li.SLACK, li.SLACK + 1))
            if s >= li.MIN_COVERAGE - 1e-9 and good:
                found.append((t, label, d, s))
    better = lambda x, c: x[0] == c[0] and abs(x[2] - c[2]) <= li.SLACK and (x[3] > c[3] + 1e-12 or (abs(x[3] - c[3]) <= 1e-12 and x[2] < c[2]))
    return {(c[1], c[2], round(c[3], 9)) for c in found if not any(better(x, c) for x in found)}


def check(spark, docs):
    vocabulary = sorted({w for _, text, _ in li.TEMPLATES for w in li.template_words(text)})
    texts = [r.text for r in docs.collect()]
    n, frequency = li.document_frequencies(docs, vocabulary)
    assert n == len(texts)
    sets = [set(WORD.findall(lower(t))) for t in texts]
    assert frequency == {w: c for w in vocabulary if (c := sum(w in s for s in sets))}
    index = li.build_index(n, frequency)
    seen = 0
    for r in li.scan_licenses(docs).collect():
        nw, nb, first, last, labels = slow_base(r.text)
        assert (r.n_words, len(r.base)) == (nw, nb)
        assert (min((b.place for b in r.base), default=None), max((b.place for b in r.base), default=None)) == (first, last)
        got = {(m.label, m.place, round(m.coverage, 9)) for m in r.matches}
        assert got == slow_matches(r.text, index)
        assert 0 <= r.score <= 1
        seen += bool(got)
    return seen


def test_brute_force(spark, frame):
    assert check(spark, frame([(i, t, None, None) for i, t in enumerate(TEXTS)])) >= 4


def test_driver_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert check(spark, docs) >= 1
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in li.op1_licenses(spark, sf).collect()}
    assert got == {r.doc_id: slow_base(r.text) for r in docs.collect()}


def altered():
    """(template, text): each template with a word inserted, and where its key phrases allow it changed or left out."""
    for t, (_, text, phrases) in enumerate(li.TEMPLATES):
        w = li.template_words(text)
        inside = {i + k for p in phrases for i in li._places(w, p.split()) for k in range(len(p.split()))}
        cut = {i for i in range(1, len(w)) if not (i in inside and i - 1 in inside)} or {0}
        i = min(cut, key=lambda i: abs(i - len(w) / 2))
        yield t, " ".join([*w[:i], "inserted", *w[i:]])
        if free := [i for i in range(len(w)) if i not in inside]:
            j = min(free, key=lambda i: abs(i - len(w) / 2))
            yield t, " ".join([*w[:j], "changed", *w[j + 1 :]])
            yield t, " ".join([*w[:j], *w[j + 1 :]])


def test_altered_notices(spark, frame):
    cases = list(altered())
    docs = frame([(i, f"some words before it {x} and some after", None, None) for i, (_, x) in enumerate(cases)])
    assert check(spark, docs) == len(cases)
    labels = {r.doc_id: {m.label for m in r.matches} for r in li.scan_licenses(docs).collect()}
    assert all(li.TEMPLATES[t][0] in labels[i] for i, (t, _) in enumerate(cases))


def test_odd_rows(odd):
    clash = odd.withColumnRenamed("n_chars", "score").withColumnRenamed("lang", "n_words").withColumnRenamed("source", "matches")
    assert {r.score for r in li.scan_licenses(clash).collect()} == {0.0}
    assert li.scan_licenses(odd.withColumnRenamed("n_chars", "label")).count() == 8
    assert li.scan_licenses(odd.where("false")).count() == 0
