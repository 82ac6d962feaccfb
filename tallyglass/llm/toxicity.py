"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its distinct words and their first
letters; the document's is the noisy-or of its sentences, 1 - product(1 - p). Weights are learned from
document labels alone, by the likelihood of that noisy-or, and sentences with p of 0.5 or more are the
offending ones.

The model is fitted on about MAX_TRAIN labelled documents of MAX_CHARS characters in all (documented bounds, chosen by a
hash of the id), with at most the VOCABULARY most frequent features; scoring is one pass over all texts without a
shuffle, and its state is the weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, table, written

MAX_TRAIN, MAX_CHARS = 8_000, 60_000_000
_PARTS = 1 << 40
VOCABULARY = 60_000
MIN_DOCUMENTS = 4
PREFIX = 4
#: Passes that select features, and passes that then fit the selected ones without a penalty.
EPOCHS, REFIT = 80, 200
RATE = 0.3
#: What a toxic document counts against another when the selected features are fitted: a missed one costs more.
TOXIC_WEIGHT = 2.0
#: A feature stays out unless it is worth this many documents.
L1_DOCUMENTS = 0.4
#: Fixed values of the contract.
FOLDS, HELD_OUT = 5, 0
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
RESULT = "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"


def _features(word: str) -> tuple[str, ...]:
    return (word, "^" + word[:PREFIX]) if len(word) > PREFIX else (word,)


def sentence_words(text: str) -> Iterator[tuple[int, int, set[str]]]:
    for m in SENTENCE.finditer(text):
        if words := set(WORD.findall(m[0].lower())):
            yield m.start(), m.end(), words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n): in how many of the texts each feature stands."""
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update({f for _, _, words in sentence_words(text or "") for w in words for f in _features(w)})
        if len(seen) > 300_000:
            yield flush()
            seen.clear()
    yield flush()


def _encoder(number: dict[str, int]):
    """toxic, the feature numbers of all sentences one after the other, and the sentences' lengths, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for text in batch.column(1).to_pylist():
                own, lengths = [], []
                for _, _, words in sentence_words(text or ""):
                    here = [i for w in sorted(words) for f in _features(w) if (i := number.get(f)) is not None]
                    own += here
                    lengths.append(len(here))
                ids.append(np.array(own, np.int32))
                sizes.append(np.array(lengths, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), batch.column(2), pa.array([xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass")) - (1 << 63) for x in batch.column(1).to_pylist()], pa.int64())], ["toxic", "ids", "sizes", "doc_id", "h"])

    return run


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int) -> tuple[np.ndarray, float]:
    """(weights, bias) of `size` features, by proximal AdaGrad on the mean log-likelihood of the noisy-or.

    bags: of each document the features of its sentences, one after the other, and the sentences' lengths.
    """
    y, n = np.array(labels, bool), len(labels)
    lengths = np.concatenate([s for _, s in bags]) if bags else np.zeros(0, np.int32)
    if not y.any() or not len(lengths) or not size:
        return np.zeros(size), -50.0
    feature = np.concatenate([f for f, _ in bags])
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(s) for _, s in bags])
    w, b = np.zeros(size), -5.0
    for epochs, l1 in ((EPOCHS, L1_DOCUMENTS / n), (REFIT, 0.0)):
        keep = np.flatnonzero(w) if l1 == 0 else np.arange(size)
        place = np.full(size, -1, np.int32)
        place[keep] = np.arange(len(keep))
        inside = place[feature] >= 0
        f, s, v = place[feature[inside]], sentence[inside], w[keep]
        gv, gb = np.full(len(keep), 1e-8), 1e-8
        for _ in range(epochs):
            z = np.bincount(s, v[f], len(lengths)) + b
            log_no = -np.logaddexp(0, z)
            p = np.exp(z + log_no)
            none = np.exp(np.bincount(doc, log_no, n))
            push = none / np.maximum(1 - none, 1e-9) * (1.0 if l1 else TOXIC_WEIGHT)
            g = np.where(y, push, -1.0)[doc] * p / n
            step, up = np.bincount(f, g[s], len(keep)), g.sum()
            gv += step**2
            gb += up**2
            rate = RATE / np.sqrt(gv)
            v = v + rate * step
            v = np.sign(v) * np.maximum(np.abs(v) - rate * l1, 0)
            b += RATE / np.sqrt(gb) * up
        w = np.zeros(size)
        w[keep] = v
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> tuple[dict[str, float], float]:
    """(weights, bias) of about max_train documents of docs with a label in `labels` (doc_id, toxic).

    Null labels don't count, of several the highest does; null and empty texts are bags without a sentence. Every row of a
    repeated id is a document of its own; rows are put in order by id and text, so that reruns agree. Without labels nothing is toxic. The texts stay on the executors:
    the driver gets the VOCABULARY most frequent features and the sample's feature numbers, at most one for each word or
    prefix of MAX_CHARS characters. Other columns aren't read.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, max_train / total) if total else 0.0
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(_PARTS))
    chosen = known.where(place < int(share * _PARTS))
    sample = written(docs.select("doc_id", "text").join(broadcast_if_small(chosen, 2 * max_train), "doc_id").select("toxic", "text", "doc_id"))
    chars = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        sample = sample.where(place < int(share * max_chars / chars * _PARTS))
    counts = sample.select("text").mapInArrow(_count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    common = [r["feature"] for r in counts.where(F.col("n") >= MIN_DOCUMENTS).orderBy(F.desc("n"), "feature").limit(VOCABULARY).collect()]
    encode = _encoder({f: i for i, f in enumerate(common)})
    rows = sample.mapInArrow(encode, "toxic int, ids array<int>, sizes array<int>, doc_id long, h long").orderBy("doc_id", "h").toArrow()
    lists = [[rows.column(k)[i].values.to_numpy(zero_copy_only=False) for i in range(len(rows))] for k in (1, 2)]
    weights, bias = train(list(zip(*lists, strict=True)), rows.column(0).to_pylist(), len(common))
    return {common[i]: float(weights[i]) for i in np.flatnonzero(weights)}, bias


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score, n_sentences, offending) for each row of docs; offending: (start, end, score) of its offending sentences, in code points.

    A null or empty text, or one without a word, has no sentence: score 0. Repeated rows and null ids each give a
    row; other columns aren't read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}

        def weight(word: str) -> float:
            if len(memo) > 500_000:
                memo.clear()
            memo[word] = x = sum(weights.get(f, 0.0) for f in _features(word))
            return x

        get = memo.get
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in batch.column(1).to_pylist():
                z, at = [], []
                for start, end, words in sentence_words(text or ""):
                    z.append(sum([weight(x) if (v := get(x)) is None else v for x in sorted(words)]))
                    at.append((start, end))
                z = np.array(z) + bias
                p = 1 / (1 + np.exp(-z)) if len(z) else z
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0)
                counts.append(len(z))
                spans.append([{"start": at[i][0], "end": at[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= 0.5)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "n_sentences", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    found = score(docs, *fit(docs, known))
    first = F.get("offending", F.lit(0))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").alias("n_offending"),
        first["start"].alias("first_start"),
        first["end"].alias("first_end"),
    )
