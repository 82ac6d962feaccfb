"""License scans with a positional rare-token index.

The index holds, for each licence template, its rarest words (by inverse document frequency over all
documents and templates) with their positions. A file's words that the index knows are looked up, and the
postings are intersected by relative position (place in the file minus place in the template): the IDF
weight of the words that agree on one relative position, or stand up to SLACK words before it, is the coverage, so that
inserted and deleted words cost nothing but themselves. A template that reaches MIN_COVERAGE counts if all its mandatory
key phrases stand at their places, give or take SLACK words.

Everything but the document-frequency count is one narrow pass without a shuffle, so neither hot words nor
hot files gather rows anywhere; the count is pre-aggregated to at most one row a licence word and task.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, words

MIN_COVERAGE = 0.6
SLACK = 2
#: Share of a template's distinct words, rarest first, that the index holds.
RARE_SHARE = 0.6
#: The contract's phrases, whose words stand consecutively, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, template, mandatory key phrases) of public licence notices.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation", "version 3"),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation", "version 2"),
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    (
        "agpl-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ("gnu affero general public license",),
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses"),
    ),
    ("mit", "Released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
)


def template_words(text: str) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())


def _places(inside: list[str], phrase: list[str]) -> list[int]:
    return [i for i in range(len(inside) - len(phrase) + 1) if inside[i : i + len(phrase)] == phrase]


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of docs, and in how many of them each word of the (fixed) vocabulary stands.

    explode_outer, as explode would have Spark infer a filter that computes the array a second time.
    """
    known = F.array_distinct(F.filter(words(F.col("text")), lambda x: x.isin(vocabulary)))
    counts = docs.select(F.explode_outer(F.array_append(known, "")).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    return found.pop("", 0), found


def build_index(n_docs: int, frequency: dict[str, int], templates=TEMPLATES) -> list[tuple[str, int, int, float]]:
    """(word, template, place, weight); the weights of a template add up to 1."""
    tokens = [template_words(text) for _, text, _ in templates]
    seen: dict[str, int] = {}
    for t in tokens:
        for w in set(t):
            seen[w] = seen.get(w, 0) + 1
    idf = {w: math.log((1 + n_docs + len(tokens)) / (frequency.get(w, 0) + n)) for w, n in seen.items()}
    out = []
    for k, t in enumerate(tokens):
        rare = sorted(set(t), key=lambda w: (-idf[w], w))
        rare = set(rare[: math.ceil(len(rare) * RARE_SHARE)])
        total = sum(idf[w] for w in t if w in rare)
        out += [(w, k, p, idf[w] / total if total else 0.0) for p, w in enumerate(t) if w in rare]
    return out


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def base_places(w: Column) -> Column:
    """Array of (place, label) where the words of a base phrase stand; w: the file's words."""

    def at(x: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<place:int,label:string>")
        for phrase, label in BASE_PHRASES.items():
            first, *rest = phrase.split(" ")
            here = x == first
            for k, word in enumerate(rest, 1):
                here = here & F.coalesce(F.get(w, i + k) == word, F.lit(False))
            found = F.when(here, F.struct(i.cast("int").alias("place"), F.lit(label).alias("label"))).otherwise(found)
        return F.when(x.isin([p.split(" ")[0] for p in BASE_PHRASES]), found)

    return F.filter(F.transform(w, at), lambda s: s.isNotNull())


def template_matches(index: list[tuple[str, int, int, float]], templates=TEMPLATES, w: str = "_w") -> Column:
    """Array of (t, d, s): template, relative position and coverage of the verified matches; w: name of the words' column.

    A fold over the sorted postings proposes positions by the weight that lies within SLACK before them; coverage is then
    counted once a template word. Of positions within SLACK of each other the best covered, then the first, stands.
    """
    by_word: dict[str, list[str]] = {}
    by_template: dict[int, list[str]] = {}
    for word, t, p, weight in index:
        by_word.setdefault(word, []).append(f"named_struct('t', {t}, 'p', {p}, 'w', {weight!r}D)")
        by_template.setdefault(t, []).append(f"named_struct('p', {p}, 'x', {_sql(word)}, 'w', {weight!r}D)")
    postings = "map(" + ", ".join(f"{_sql(x)}, array({', '.join(p)})" for x, p in by_word.items()) + ")"
    rare = "array(" + ", ".join(f"array({', '.join(by_template[t])})" for t in range(len(templates))) + ")"
    known = ", ".join(map(_sql, by_word))
    phrases = []
    for _, text, needed in templates:
        t = template_words(text)
        at = [(_places(t, template_words(p)), template_words(p)) for p in needed]
        if not all(x for x, _ in at):
            raise ValueError(f"a key phrase of {needed} isn't in its template")
        phrases.append("array(" + ", ".join(f"named_struct('o', {x[0]}, 'x', array({', '.join(map(_sql, p))}))" for x, p in at) + ")")
    keys = "array(" + ", ".join(phrases) + ")"
    hits = f"filter(transform({w}, (x, i) -> IF(x IN ({known}), named_struct('i', i, 'x', x), NULL)), h -> h IS NOT NULL)"
    matches = f"array_sort(flatten(transform({hits}, h -> transform({postings}[h.x], q -> named_struct('t', q.t, 'd', h.i - q.p, 'p', q.p, 'w', q.w)))))"
    # the sums at the position, and at the two before it that the template has (e: place, r: sum)
    near = "a.s + " + " + ".join(f"IF(a.d - a.e{k} <= {SLACK}, a.r{k}, 0D)" for k in range(1, SLACK + 1))
    keep = f"IF({near} >= {MIN_COVERAGE - 1e-9}D, concat(a.out, array(named_struct('t', a.t, 'd', a.d))), a.out)"
    state = lambda t, d, total, shift, out: f"named_struct('t', {t}, 'd', {d}, 's', {total}, " + "".join(f"'e{k}', {e}, 'r{k}', {r}, " for k, (e, r) in enumerate(shift, 1)) + f"'out', {out})"
    none = [("-1000000000", "0D")] * SLACK
    now = [(f"a.e{k}", f"a.r{k}") for k in range(1, SLACK + 1)]
    folded = (
        f"aggregate({matches}, {state('-1', '0', '0D', none, 'CAST(array() AS array<struct<t:int,d:int>>)')}, "
        f"(a, m) -> IF(a.t = m.t AND a.d = m.d, {state('a.t', 'a.d', 'a.s + m.w', now, 'a.out')}, "
        f"IF(a.t = m.t, {state('m.t', 'm.d', 'm.w', [('a.d', 'a.s'), *now[:-1]], keep)}, {state('m.t', 'm.d', 'm.w', none, keep)})), a -> {keep})"
    )
    covered = f"aggregate({rare}[c.t], 0D, (s, q) -> s + IF(exists(sequence(0, {SLACK}), k -> get({w}, c.d + q.p - k) <=> q.x), q.w, 0D))"
    steps = f"sequence({-SLACK}, {SLACK})"
    phrased = f"forall({keys}[c.t], f -> exists({steps}, k -> c.d + f.o + k >= 0 AND slice({w}, greatest(c.d + f.o + k + 1, 1), size(f.x)) = f.x))"
    scored = f"filter(transform({folded}, c -> named_struct('t', c.t, 'd', c.d, 's', {covered})), c -> c.s >= {MIN_COVERAGE - 1e-9}D AND {phrased})"
    better = f"x.t = c.t AND abs(x.d - c.d) <= {SLACK} AND (x.s > c.s OR (x.s = c.s AND x.d < c.d))"
    return F.expr(f"transform(array({scored}), m -> filter(m, c -> NOT exists(m, x -> {better})))[0]")


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """docs with n_words, base (place, label), matches (label, place, coverage) and score as further columns.

    Reads text of all rows twice: once for the IDF of the licence words, once for the scan. A null text is an
    empty one: no words, no places, score 0. Each row is judged on its own, so repeated rows and null ids each
    give their row; further columns go along. An empty table gives an empty one.
    score: the best verified coverage, 0.5 at least where a base phrase stands, 1 at most.
    """
    vocabulary = sorted({w for _, text, _ in templates for w in template_words(text)})
    index = build_index(*document_frequencies(docs, vocabulary), templates)
    labels = F.array(*[F.lit(label) for label, _, _ in templates])
    scanned = docs.withColumn("_w", words(F.col("text"))).withColumn("base", base_places(F.col("_w"))).withColumn("_m", template_matches(index, templates))
    best = F.coalesce(F.array_max(F.transform("_m", lambda c: c["s"])), F.lit(0.0))
    return (
        scanned.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("matches", F.transform("_m", lambda c: F.struct(F.get(labels, c["t"]).alias("label"), c["d"].alias("place"), c["s"].alias("coverage"))))
        .withColumn("score", F.least(F.lit(1.0), F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0))))
        .drop("_w", "_m")
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, own = F.transform("base", lambda b: b["label"]), F.transform("matches", lambda m: m["label"])
    places = F.transform("base", lambda b: b["place"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        "score",
    )
