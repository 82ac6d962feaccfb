"""Document fingerprints by SpotSigs.

A signature is a chain of the CHAIN content words that follow a common word (the anchor). A text's
fingerprint is the sorted set of its signatures' 64-bit hashes, and likeness is the Jaccard resemblance of
two sets. Duplicates are searched for among sets whose lengths differ by a factor of the threshold at most, as others
can't reach it; rare-first prefixes and bitmaps prune there, and candidates are compared in full (resemblance.py).

A text whose anchors give no chain, or longer than SPARSE words with fewer chains from anchors than one in SPARSE, has
chains from every word; a text shorter than a chain is one chain, so that fingerprints are empty for texts without words
only. Two empty fingerprints are alike.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, table
from .components import connected_components
from .resemblance import resembling_components, share

CHAIN = 2
THRESHOLD = 0.8
#: A text of more words than this for each chain has chains from every word, as its anchors say too little of it.
SPARSE = 50
#: Common words of the corpus' languages, the anchors.
ANCHORS = frozenset(
    """the of and to a in is it that was for on are with as be by this at from or an
    der die das und ist nicht ein eine zu den von mit sich des auf für im dem
    le la les de des et un une est en du que dans pour qui au par il elle sur
    el los las y es del una por con se su para no lo al""".split()
)
WORD = re.compile(r"[^\W_]+")
#: Characters whose words are hashed at once.
CHUNK_CHARS = 1 << 18
#: Rows of a range, up to RANGES ranges; beyond those the session's shuffle partitions say how many there are.
ROWS_A_RANGE, RANGES = 4_000, 1 << 14
#: Where rows without an id stand in the order.
LAST = (1 << 63) - 1


class _Tables:
    """Of every code point: whether it is part of a word, and a random number; and the powers by which word hashes are computed."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.in_word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        self.number = np.random.default_rng(20080720).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        ones = np.ones(CHUNK_CHARS + 1, np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[ones[:1], ones[1:] * np.uint64(self.BASE)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[ones[:1], ones[1:] * np.uint64(self.INVERSE)], dtype=np.uint64)


@lru_cache(1)
def _tables() -> _Tables:
    return _Tables()


def _hashes(text: str) -> np.ndarray:
    """A hash of each word of a lower-cased text of up to CHUNK_CHARS characters: the same polynomial of its characters wherever it stands."""
    t = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = t.in_word[codes]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(t.number[codes] * t.power[: len(codes)], out=total[1:])
        h = (total[end] - total[start]) * t.inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a lower-cased text."""
    if len(text) <= CHUNK_CHARS:
        return _hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK_CHARS)
        while at < end < len(text) and text[end - 1].isalnum():
            end -= 1
        end = end if end > at else min(len(text), at + CHUNK_CHARS)  # a single word of so many characters counts as several
        parts.append(_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


@lru_cache(1)
def _anchors() -> np.ndarray:
    return np.sort(word_hashes(" ".join(sorted(ANCHORS))))


def _chained(*words: np.ndarray) -> np.ndarray:
    """A hash of each row's words, in order."""
    out = np.full(len(words[0]), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for x in words:
            out = (out ^ x) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return (out * np.uint64(0x94D049BB133111EB)).view(np.int64)


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's chains."""
    h, anchors = word_hashes((text or "").lower()), _anchors()
    anchor = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
    content = h[~anchor]
    # content words before each anchor: the place of the first that follows it
    at = np.cumsum(~anchor)[anchor]
    has = at + CHAIN <= len(content)
    at = at[has]
    found = _chained(h[anchor][has], *(content[at + k] for k in range(CHAIN)))
    if not len(found) or (len(h) > SPARSE and len(found) * SPARSE < len(h)):
        n = min(CHAIN, len(h))
        found = _chained(*(h[k : len(h) - n + 1 + k] for k in range(n))) if n else np.zeros(0, np.int64)
    return np.unique(found)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard resemblance of two fingerprints; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = share(a, b)
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs; null and empty texts have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint array<long>")


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): one row for each id of docs; class_id: the smallest doc_id reachable over texts that resemble each other by `threshold` or more.

    Equal texts are one class, those without words among them; of an id's several texts all count. Rows without an id
    have none. An empty table gives an empty one.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    same = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("h2")]
    first = known.groupBy(*same).agg(F.min("doc").alias("first"))
    by_text = checkpoint(known.select("doc", *same).join(first, ["h", "h2"]).select("doc", "first"))
    # an id's several texts are one class, and so what equals them
    several = connected_components(by_text, "doc", "first")
    start = checkpoint(by_text.select("doc").distinct().join(several.toDF("doc", "component"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component")))
    return resembling_components(known, start, signatures, threshold).toDF("doc_id", "class_id")


def _ranges(keys: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, ranges, first): bounds between ranges of keys, the ranges that have rows, and each one's first key; one number a range."""
    n = keys.count()
    k = max(1, partitions(keys.sparkSession), min(RANGES, -(-n // ROWS_A_RANGE))) if n else 1
    bounds = np.array(sorted({min(int(x), LAST) for x in keys.approxQuantile("key", [i / k for i in range(1, k)], 1 / (4 * k))} if k > 1 else []), np.int64)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            own = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            r, at = np.unique(np.searchsorted(bounds, own, "right"), return_index=True)
            for x, y in zip(r.tolist(), own[at].tolist(), strict=True):
                least[x] = min(y, least.get(x, y))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["r", "first"])

    found = sorted((x["r"], x["first"]) for x in keys.mapInArrow(firsts, "r int, first long").groupBy("r").agg(F.min("first").alias("first")).collect())
    return bounds, np.array([r for r, _ in found], np.int64), np.array([f for _, f in found], np.int64)


_PLACED = "r int, border int, key long, kind int, h long, doc_id long, z binary, class_id long"
_PLACED_NAMES = [x.split(" ")[0] for x in _PLACED.split(", ")]


def _place_texts(bounds: np.ndarray, ranges: np.ndarray, first: np.ndarray):
    """Rows of texts at their ranges; of those with a range's first key a task's least also goes to the range before, as its border."""
    before = {int(k): (i - 1) % len(first) for i, k in enumerate(first)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            key = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            h = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in texts]
            z = [zlib.compress(x, 1) for x in texts]
            for i, k in enumerate(key.tolist()):
                if k in before and (k not in border or h[i] < border[k][0]):
                    border[k] = h[i], z[i]
            n = len(key)
            r = np.searchsorted(ranges, np.searchsorted(bounds, key, "right")).astype(np.int32)
            zero, one = pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(r), zero, pa.array(key), one, pa.array(h, pa.int64()), batch.column(0), pa.array(z, pa.binary()), pa.nulls(n, pa.int64())], _PLACED_NAMES)
        rows = [{"r": before[k], "border": 1, "key": k, "kind": 1, "h": h, "z": z} for k, (h, z) in border.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(_PLACED_NAMES, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True))))

    return run


def _place_classes(bounds: np.ndarray, ranges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column(0).to_numpy(zero_copy_only=False), batch.num_rows
            r = np.searchsorted(ranges, np.searchsorted(bounds, key, "right")).astype(np.int32)
            zero = pa.array(np.zeros(n, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(r), zero, pa.array(key), zero, pa.nulls(n, pa.int64()), batch.column(0), pa.nulls(n, pa.binary()), batch.column(1)], _PLACED_NAMES)

    return run


def with_next_text(docs: DataFrame, classes: DataFrame, result: str, use) -> DataFrame:
    """use(doc_id, class_id, text, next_text) -> a result row, for each row of docs by ascending doc_id; the last row's next is the first.

    classes: (doc_id, class_id) of docs' ids. Rows of one id are ordered by a hash of their texts, rows without an id come last.
    One shuffle of the compressed texts by ranges of ids, each a task of its own: a range's first row also goes to the
    range before, so that every range holds its rows' successors, and tasks stream over their sorted rows.
    """
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"))
    bounds, ranges, first = _ranges(keys)
    if not len(first):
        return docs.sparkSession.createDataFrame([], result)
    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_place_texts(bounds, ranges, first), _PLACED)
    rows = texts.unionByName(classes.select("doc_id", "class_id").mapInArrow(_place_classes(bounds, ranges), _PLACED))
    schema = pa.schema(_ARROW[result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, named = None, (None, None)
        for batch in batches:
            out = []
            for r, border, key, kind, _, doc, z, class_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    named = key, class_id
                    continue
                text = zlib.decompress(z).decode("utf-8", "surrogatepass")
                if held and held[0] == r:
                    out.append(use(*held[1:], text))
                held = None if border else (r, doc, named[1] if doc is not None and named[0] == key else None, text)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.repartitionById(len(first), F.col("r")).sortWithinPartitions("r", "border", "key", "kind", "h").mapInArrow(run, result)


_OP6 = "doc_id long, n_chars long, edited_sha256 string, fingerprint array<long>, edited_fingerprint array<long>, near_edited double, near_next double, class_id long"
_ARROW = {
    _OP6: [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.list_(pa.int64())),
        ("edited_fingerprint", pa.list_(pa.int64())),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("class_id", pa.int64()),
    ]
}


def compare_edited(memo: dict[str, np.ndarray], doc: int | None, class_id: int | None, text: str, following: str) -> dict:
    """A row of op6: the text against its edited text and the next document's."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    own = memo.pop(text, None)
    own = signatures(text) if own is None else own
    other, new = signatures(following), signatures(edited)
    memo.clear()
    memo[following] = other
    return {
        "doc_id": doc,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": own,
        "edited_fingerprint": new,
        "near_edited": likeness(own, new),
        "near_next": likeness(own, other),
        "class_id": class_id,
    }


def op6_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and class_id: the smallest id of its near-duplicates by fingerprint, its own included (null without an id).

    Null and empty texts have empty fingerprints; repeated rows each give a row; a single row is its own next. Extra columns aren't read.
    """
    memo: dict[str, np.ndarray] = {}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next_text(docs, duplicates(docs), _OP6, lambda *row: compare_edited(memo, *row))
