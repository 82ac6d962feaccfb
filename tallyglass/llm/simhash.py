"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit in one of their
32-bit halves. In each half the anchors are the words of a perfect covering code: the [31,26] Hamming
code on the low 31 bits, times the free top bit (covering radius 1). A fingerprint is replicated to all
anchors within covering radius + 1 of each half (34 at most, whatever the data), so that any two linked
fingerprints meet at an anchor, where they are compared over all 64 bits. Equal fingerprints are one
class before that; within an anchor a search that takes each fingerprint out of the candidates once it
is reached yields at most one link a fingerprint, so dense groups never become all their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, partitions, table
from .components import connected_components
from .resemblance import resembling_components

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: Words of a shingle where resemblance counts.
RESEMBLING_WORDS = 5
BROADCAST_IDS = 500_000
#: Groups at an anchor up to this size are compared pair by pair, in vectors across groups.
SMALL_GROUP = 6
_CHUNK = 1 << 15
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of the whole text: 3-word shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        found = [b" ".join(words)]
    else:
        found = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _CHUNK):
        h = np.array([digest(x, SEED) for x in found[at : at + _CHUNK]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _flips() -> list[np.ndarray]:
    """For each syndrome of the [31,26] Hamming code: what to flip to reach the code words within 2."""
    out = [np.zeros(1, np.uint32)]
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out.append(np.array([1 << (s - 1), *pairs], np.uint32))
    return out


FLIPS = _flips()
_CHECKS = [np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors) of 32-bit halves: every anchor within distance 2 of each."""
    low, top = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    syndrome = np.zeros(len(half), np.int64)
    for k, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(low & mask).astype(np.int64) & 1) << k
    rows, out = [], []
    for s, flips in enumerate(FLIPS):
        at = np.flatnonzero(syndrome == s)
        if not at.size:
            continue
        near = (low[at, None] ^ flips[None, :]) | top[at, None]
        other = (low[at] ^ flips[0]) | (top[at] ^ np.uint32(0x80000000))
        rows += [np.repeat(at, len(flips)), at]
        out += [near.ravel(), other]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.uint32)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        doc = batch.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            row, anchor = anchors((fp >> np.uint64(32 * k)).astype(np.uint32))
            key = anchor.astype(np.int64) | (k << 32)
            for at in range(0, len(row), _CHUNK):
                r = row[at : at + _CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + _CHUNK]), pa.array(fp[r].view(np.int64)), pa.array(doc[r])], ["anchor", "fp", "doc"])


def _spanning(fp: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one anchor's fingerprints."""
    left = np.arange(len(fp))
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            p = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[p]) <= THRESHOLD
            if near.any():
                hit, left = left[near], left[~near]
                yield np.full(len(hit), doc[p]), doc[hit]
                todo.extend(hit)


def _compare(key: np.ndarray, fp: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    for s, n in zip(start[size > SMALL_GROUP], size[size > SMALL_GROUP], strict=True):
        yield from _spanning(fp[s : s + n], doc[s : s + n])
    small = np.repeat((size > 1) & (size <= SMALL_GROUP), size)
    key, fp, doc = key[small], fp[small], doc[small]
    for k in range(1, SMALL_GROUP):
        if len(key) <= k:
            break
        hit = np.flatnonzero((key[k:] == key[:-k]) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= THRESHOLD))
        if hit.size:
            yield doc[hit], doc[hit + k]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by anchor; a group that goes on in the next batch waits for it."""
    wait: list[list[np.ndarray]] = []

    def done(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, fp, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        for a, b in _compare(key, fp.view(np.uint64), doc):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (wait and wait[-1][0][-1] != now[0][0]):
            yield from done([*wait, [x[:cut] for x in now]])
            wait = []
        wait.append([x[cut:] for x in now])
    if wait:
        yield from done(wait)


def near_duplicate_links(classes: DataFrame) -> DataFrame:
    """(a, b) over (fp, doc), one row for each fingerprint: links that connect exactly what chains of at most 3 differing bits connect."""
    n = partitions(classes.sparkSession)
    at_anchors = classes.select("fp", "doc").mapInArrow(_replicate, "anchor long, fp long, doc long")
    return at_anchors.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long")


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of RESEMBLING_WORDS words; of fewer words, of the whole sequence; empty without words."""
    found = WORD.findall(text.lower())
    if len(found) < RESEMBLING_WORDS:
        runs = {" ".join(found)} if found else set()
    else:
        runs = set(map(" ".join, zip(*(found[k:] for k in range(RESEMBLING_WORDS)), strict=False)))
    digest = xxhash.xxh64_intdigest
    out = np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in runs), np.uint64, len(runs)).view(np.int64)
    out = np.unique(out)
    return out


def near_duplicates(docs: DataFrame, resemblance: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id: the smallest doc_id reachable over links.

    resemblance: with it, texts are linked too if their sets of five-word shingles resemble each other by so much or more;
    such pairs are searched exactly, whatever their fingerprints.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows each give a row.
    A null doc_id is never a representative: its row gets its class's component, or null where only null
    ids have that fingerprint. Other columns of docs are not read. An empty table gives an empty one.
    """
    fps = checkpoint(fingerprints(docs))
    classes = checkpoint(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc")))
    parts = connected_components(near_duplicate_links(classes))
    named = classes.join(parts.withColumnRenamed("node", "doc"), "doc", "left").select(F.col("fp"), F.coalesce("component", "doc").alias("component_id"))
    found = fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")
    if resemblance is None:
        return found
    found = checkpoint(found)
    known = checkpoint(found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component")))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), "text")
    whole = resembling_components(texts, known.toDF("doc", "component"), shingles, resemblance)
    merged = known.join(whole.toDF("doc_id", "whole"), "doc_id").where("component <> whole").select("component", "whole").distinct()
    merged = broadcast_if_small(checkpoint(merged), BROADCAST_IDS).toDF("component_id", "whole")
    return found.join(merged, "component_id", "left").select("doc_id", "fp", F.coalesce("whole", "component_id").alias("component_id"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
