"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1 drawn from its code point. A
trigram is bound from its letters' vectors, permuted by their place: V(abc) = rot2(a) * rot1(b) * c. A
text is the bundle (sum) of its trigrams, a language prototype the bundle of its texts' unit vectors, and a
text has the language whose prototype is nearest by cosine.

Prototypes are fitted on about SAMPLE_PER_LANGUAGE labelled texts of each language (a documented bound,
chosen by a hash of the id); each is DIM numbers, so what goes to the driver and to the executors is
DIM numbers a language. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

DIM = 512
SEED = 20240229
SAMPLE_PER_LANGUAGE = 2000
#: Fixed values of the contract: parts of the id's crc32 and the part held out.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
_CHUNK_CHARS = 200_000
#: Distinct trigrams whose vectors, and counts that, are in memory at once.
_TRIGRAMS, _COUNTS = 20_000, 2_000_000
#: Texts whose bundles are in memory at once.
_ROWS = 500
_DENSE = 3_000_000
_UNIT = 1_000_000


class _Letters:
    """Dense numbers and vectors of the letters met so far in this process; 0 is the gap between words."""

    def __init__(self) -> None:
        self.number = np.full(0x110000, -1, np.int32)
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.vectors = np.zeros((0, DIM), np.int8)
        self._add(0)

    def _add(self, code: int) -> None:
        self.number[code] = len(self.vectors)
        v = np.random.default_rng([SEED, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        self.vectors = np.vstack([self.vectors, v[None].astype(np.int8)])

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        out = self.number[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]):
                self._add(int(c))
            out = self.number[codes]
        return out


@lru_cache(1)
def _letters() -> _Letters:
    return _Letters()


def bundles(texts: list[str | None]) -> np.ndarray:
    """The bundle of each text, as rows; all zero for a text without letters."""
    letters, n = _letters(), len(texts)
    low = [f"\0{(t or '').lower()}\0" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, low), np.int64, n)
    first = np.cumsum(length) - length
    letter = letters.is_letter[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first] = True
    return _sums(letters.numbers(np.where(letter, codes, 0)[keep]), np.repeat(np.arange(n), length)[keep], n)


def _sums(s: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The sum of the vectors of each doc's trigrams, of n docs; s: letters' numbers, one doc after the other."""
    letters, s = _letters(), s.astype(np.int64)
    out = np.zeros((n, DIM), np.float32)
    if len(s) < 3:
        return out
    inside = doc[:-2] == doc[2:]
    size = len(letters.vectors)
    code, doc = ((s[:-2] * size + s[1:-1]) * size + s[2:])[inside], doc[:-2][inside]
    if size**3 <= _DENSE:
        present = np.flatnonzero(np.bincount(code, minlength=size**3))
        place = np.zeros(size**3, np.int64)
        place[present] = np.arange(len(present))
        place = place[code]
    else:
        present, place = np.unique(code, return_inverse=True)
    v = letters.vectors
    for first in range(0, len(present), _TRIGRAMS):
        part = present[first : first + _TRIGRAMS]
        bound = (np.roll(v, 2, 1)[part // size**2] * np.roll(v, 1, 1)[part // size % size] * v[part % size]).astype(np.float32)
        own, at = doc, place
        if len(part) < len(present):
            here = (place >= first) & (place < first + len(part))
            own, at = doc[here], place[here] - first
        step = max(1, _COUNTS // len(part))
        ends = np.searchsorted(own, np.arange(0, n + step, step))
        for k, row in enumerate(range(0, n, step)):
            x, y = ends[k], ends[k + 1]
            if x < y:
                rows = min(step, n - row)
                counts = np.bincount((own[x:y] - row) * len(part) + at[x:y], minlength=rows * len(part)).reshape(rows, -1)
                out[row : row + rows] += counts.astype(np.float32) @ bound
    return out


def _long_bundle(text: str) -> np.ndarray:
    """bundles() of one long text, _CHUNK_CHARS characters at a time; each part begins with the last two letters of the one before."""
    letters, low = _letters(), f"{text.lower()}\0"
    tail, after, out = np.zeros(1, np.int32), False, np.zeros(DIM, np.float64)
    for at in range(0, len(low), _CHUNK_CHARS):
        codes = np.frombuffer(low[at : at + _CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letters.is_letter[codes]
        s = np.r_[tail, letters.numbers(np.where(letter, codes, 0)[letter | np.r_[after, letter[:-1]]])]
        out += _sums(s, np.zeros(len(s), np.int64), 1)[0]
        tail, after = s[-2:], bool(letter[-1])
    return out


def whole_bundles(texts: list[str | None]) -> np.ndarray:
    """bundles() of texts of any length, some _CHUNK_CHARS characters at a time."""
    out = np.zeros((len(texts), DIM), np.float32)
    wait, chars = [], 0
    for i, t in enumerate(texts):
        if len(t or "") > _CHUNK_CHARS:
            out[i] = _long_bundle(t)
            continue
        wait.append(i)
        chars += len(t or "")
        if chars >= _CHUNK_CHARS:
            out[wait] = bundles([texts[k] for k in wait])
            wait, chars = [], 0
    if wait:
        out[wait] = bundles([texts[k] for k in wait])
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit bundles by language, in whole millionths so that their order doesn't matter."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(texts), _ROWS):
            units = np.rint(_unit(whole_bundles(texts[at : at + _ROWS])).astype(np.float64) * _UNIT).astype(np.int64)
            for lang, row in zip(langs[at : at + _ROWS], units, strict=True):
                total[lang] = total.get(lang, 0) + row
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def fit_prototypes(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) of (doc_id, text, lang); rows without lang or letters don't count."""
    known = labelled.where("lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, DIM), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    sums = chosen.select("lang", "text").mapInArrow(_profile, "lang string, bundle array<long>")
    rows = sums.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()
    langs = sorted({r["lang"] for r in rows})
    found = np.zeros((len(langs), DIM))
    for r in rows:
        found[langs.index(r["lang"]), r["pos"]] = r["x"]
    full = np.flatnonzero(np.abs(found).any(1))
    return [langs[i] for i in full], _unit(found[full]).astype(np.float32)


def classify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score: one row for each row of docs, of the whole text.

    lang_pred is UNKNOWN, with score 0, where the text is null or has no letter; null, with score 0, where no language
    was learned.
    Equal cosines go to the language first by name. score: the cosine, 0 if negative. Null ids and repeated rows
    each give a row; an empty table gives an empty one.
    """
    names = [*dict.fromkeys([*keep, "text"])]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            found, scores = [], []
            for at in range(0, len(texts), _ROWS):
                units = _unit(whole_bundles(texts[at : at + _ROWS]))
                cosine = units @ prototypes.T if langs else np.zeros((len(units), 1), np.float32)
                best, known = cosine.argmax(1), units.any(1)
                found += [(langs[b] if langs else None) if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores += np.where(known, np.clip(cosine[np.arange(len(units)), best], 0, 1), 0).astype(float).round(6).tolist()
            kept = [batch.column(names.index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    result = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*names).mapInArrow(predict, result)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """classify() by what the documents that aren't held out teach."""
    return classify(docs, *fit_prototypes(docs.where(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))), keep)


def op4_language(spark, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
