"""Exact search for texts whose sets resemble each other, as components of what resembles.

A text is a set of hashes. Two sets that share at least `threshold` of their union have lengths within that factor,
and meet in the first 1 - threshold of both in any one order of all hashes: here rare ones come first. A hash's
texts are sorted by length, so what is compared lies within one length and the next; a place bound prunes
further, and what remains is compared in full. Pairs that are connected already are never compared: the first rounds
compare neighbours by length, then each text with those that have fewest rare hashes of their own, then with the nearest texts
of other components, so that dense groups are one component before the last round takes every pair that is still apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, partitions
from .components import connected_components

BROADCAST_IDS = 500_000
#: Texts, and hashes found in two of them, that say which hashes are common; on these only the number of candidates depends.
COMMON_TEXTS, COMMON = 8_000, 200_000
#: Neighbours by length that the first round compares.
NEIGHBOURS = 3
#: Texts with the fewest rare hashes of their own that all others of a hash are compared with.
FIRSTS = 8
#: Rows before and after that a text outside its hash's largest component is compared with.
NEAREST = 8
#: Rows of a hash up to which all pairs are looked at in vectors across hashes.
SMALL = 8
ROWS = "sig long, doc long, h long, n int, place int"
_NAMES = ("sig", "doc", "h", "n", "place")
#: What a hash's rows are sorted by, so that equal texts and near lengths are neighbours.
ORDER = ("sig", "n", "h", "doc")
Sets = Callable[[str], np.ndarray]


def _common(texts: DataFrame, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of hashes that several of about COMMON_TEXTS texts share, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sets(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["sig"])

    share = min(1.0, COMMON_TEXTS / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64("doc", F.lit("common")), F.lit(1 << 30)) < share * (1 << 30))
    counts = sample.select("text").mapInArrow(run, "sig long").groupBy("sig").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "sig").limit(COMMON).collect()
    sig, often = np.array([r["sig"] for r in top], np.int64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(sig)
    return sig[order], often[order]


def prefix_rows(texts: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """ROWS: each text's rarest hashes, as many as must meet those of any text that resembles it; of equal texts (h) one a task."""
    sig, often = _common(texts, sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for doc, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                own = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 33
                if own in seen:
                    continue
                seen.add(own)
                h = sets(text)
                if not (n := len(h)):
                    continue
                k = n - math.ceil(n * threshold - 1e-9) + 1
                if len(sig):
                    at = np.minimum(np.searchsorted(sig, h), len(sig) - 1)
                    rank = np.where(sig[at] == h, often[at], 0)
                    h = h[np.argsort(rank, kind="stable")]
                parts.append([h[:k], np.full(k, doc), np.full(k, own), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)])
                if len(parts) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], _NAMES)
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], _NAMES)

    return texts.select("doc", "text").mapInArrow(run, ROWS)


def _possible(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Of pairs of rows of one hash, those of different components whose lengths and places allow the threshold with this as the first hash they share."""
    _, _, component, n, place = rows
    left = np.minimum(n[i] - place[i], n[j] - place[j])
    needed = (n[i].astype(np.int64) + n[j]) * (threshold / (1 + threshold)) - 1e-6
    return (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * threshold - 1e-6) & (left >= needed)


PAIRS = "a long, b long, ca long, cb long"
_PAIR_NAMES = ("a", "b", "ca", "cb")


def _pairs(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(a, b, ca, cb) with a < b: docs and their components."""
    i, j = np.where(rows[1][i] <= rows[1][j], i, j), np.where(rows[1][i] <= rows[1][j], j, i)
    return pa.RecordBatch.from_arrays([pa.array(rows[k][x]) for k in (1, 2) for x in (i, j)], _PAIR_NAMES)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in ORDER, those whose hash another text has, one a text."""
    last: list[np.ndarray] | None = None
    twice = False
    for batch in batches:
        rows = _arrays(batch) if last is None else [np.concatenate(x) for x in zip(last, _arrays(batch), strict=True)]
        again = (rows[0][1:] == rows[0][:-1]) & (rows[2][1:] == rows[2][:-1]) & (rows[3][1:] == rows[3][:-1])
        rows = [x[np.r_[True, ~again]] for x in rows] if len(rows[0]) else rows
        if not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        keep = np.r_[twice, same] | np.r_[same, False]
        twice = bool(same[-1]) if len(same) else twice
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in rows], _NAMES)
        last = [x[-1:] for x in rows]
    if last is not None and twice:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], _NAMES)


def _neighbours(threshold: float):
    """Pairs of rows at most NEIGHBOURS apart, of rows sorted by hash and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        for batch in batches:
            old = 0 if last is None else len(last[0])
            rows = _arrays(batch) if last is None else [np.concatenate(x) for x in zip(last, _arrays(batch), strict=True)]
            for k in range(1, NEIGHBOURS + 1):
                j = np.arange(max(k, old), len(rows[0]))
                j = j[rows[0][j] == rows[0][j - k]]
                j = j[_possible(rows, j - k, j, threshold)]
                if j.size:
                    yield _pairs(rows, j - k, j)
            last = [x[-NEIGHBOURS:] for x in rows]

    return run


def _whole_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The rows in arrays that never part those of a hash."""
    wait: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _arrays(batch)
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield [np.concatenate(x) for x in zip(*wait, [x[:cut] for x in now], strict=True)]
            wait = []
        elif wait and wait[-1][0][-1] != now[0][0]:
            yield [np.concatenate(x) for x in zip(*wait, strict=True)]
            wait = []
        wait.append([x[cut:] for x in now])
    if wait:
        yield [np.concatenate(x) for x in zip(*wait, strict=True)]


def _firsts(threshold: float):
    """Pairs of each row and its hash's FIRSTS, of rows sorted by hash and place: what many resemble has the fewest rare hashes of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_hashes(batches):
            new = np.r_[True, rows[0][1:] != rows[0][:-1]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            every = np.arange(len(first))
            for k in range(FIRSTS):
                j = every[first + k < every]
                i = first[j] + k
                near = _possible(rows, i, j, threshold)
                if near.any():
                    yield _pairs(rows, i[near], j[near])

    return run


def _nearest(threshold: float):
    """Pairs of each row outside its hash's largest component and the NEAREST rows before and after its component's stretch, of rows sorted by hash and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_hashes(batches):
            sig, component = rows[0], rows[2]
            first = np.r_[True, sig[1:] != sig[:-1]]
            of = np.cumsum(first) - 1
            order = np.lexsort((component, of))
            own = np.flatnonzero(np.r_[True, (of[order][1:] != of[order][:-1]) | (component[order][1:] != component[order][:-1])])
            size = np.diff(np.r_[own, len(sig)])
            by = np.lexsort((size, of[order][own]))  # the last of a hash is its largest component
            last = np.r_[np.flatnonzero(np.diff(of[order][own][by])), len(by) - 1]
            main = component[order][own][by][last]
            new = first | np.r_[True, component[1:] != component[:-1]]
            start, which = np.flatnonzero(new), np.cumsum(new) - 1
            end = np.r_[start[1:], len(sig)]
            outside = np.flatnonzero(component != main[of])
            for k in range(NEAREST):
                for j in (start[which[outside]] - 1 - k, end[which[outside]] + k):
                    i = outside[(j >= 0) & (j < len(sig))]
                    j = j[(j >= 0) & (j < len(sig))]
                    i, j = i[sig[i] == sig[j]], j[sig[i] == sig[j]]
                    near = _possible(rows, i, j, threshold)
                    if near.any():
                        yield _pairs(rows, i[near], j[near])

    return run


def _apart(threshold: float):
    """All possible pairs of different components, of rows sorted by hash and length; a hash with one component gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_hashes(batches):
            start = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            size = np.diff(np.r_[start, len(rows[0])])
            few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
            for k in range(1, SMALL):
                i, j = few[:-k], few[k:]
                here = rows[0][i] == rows[0][j]
                i, j = i[here], j[here]
                near = _possible(rows, i, j, threshold)
                if near.any():
                    yield _pairs(rows, i[near], j[near])
            for s, e in zip(start[size > SMALL].tolist(), (start + size)[size > SMALL].tolist(), strict=True):
                component, n = rows[2][s:e], rows[3][s:e]
                if (component == component[0]).all():
                    continue
                own, at, count = np.unique(component, return_inverse=True, return_counts=True)
                main, here = int(np.argmax(count)), np.arange(s, e)
                for i in np.flatnonzero(at != main).tolist():
                    # rows lie by length: only a stretch of them is near enough; each two small ones meet once
                    low, high = np.searchsorted(n, n[i] * threshold - 1e-6), np.searchsorted(n, n[i] / threshold + 1e-6, "right")
                    j = np.arange(low, high)
                    j = here[j[(at[j] == main) | (j > i)]]
                    j = j[_possible(rows, np.full(len(j), s + i), j, threshold)]
                    if j.size:
                        yield _pairs(rows, np.full(len(j), s + i), j)

    return run


def _bitmap(h: np.ndarray) -> bytes:
    """A bit for each of the set's hashes by its low bits; 4 to 8 bits a hash."""
    bits = np.zeros(max(512, 1 << (4 * len(h) - 1).bit_length()), np.uint8)
    bits[h & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _may_resemble(na: int, x: np.ndarray, nb: int, y: np.ndarray, threshold: float) -> bool:
    """False only where bitmaps prove that two sets share too little: a bit that only one has is a hash that only one has."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    only_a, only_b = (int(np.bitwise_count(v).sum(dtype=np.int64)) for v in (x & ~y, y & ~x))
    return min(na - only_a, nb - only_b) >= (na + nb) * threshold / (1 + threshold) - 1e-6


def share(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _compared(texts: DataFrame, pairs: DataFrame, pack, near) -> DataFrame:
    """The pairs (PAIRS) of which near(of a, of b) holds, by what pack(text) gives: (n, bytes)."""
    ids = checkpoint(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, packed = zip(*map(pack, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], ["doc", "n", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = [near(n, x.as_buffer(), m, y.as_buffer()) for n, x, m, y in zip(na, batch.column(6), nb, batch.column(7), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(4)], _PAIR_NAMES)

    wanted = texts.select("doc", "text").join(broadcast_if_small(ids, BROADCAST_IDS), "doc", "left_semi")
    packed = checkpoint(wanted.mapInArrow(encode, "doc long, n int, s binary"))
    wide = pairs.join(packed.toDF("a", "na", "sa"), "a").join(packed.toDF("b", "nb", "sb"), "b")
    return wide.select(*_PAIR_NAMES, "na", "nb", "sa", "sb").mapInArrow(compare, PAIRS)


def verified(texts: DataFrame, pairs: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """Of pairs (PAIRS), checkpointed, those whose sets resemble each other by the threshold or more.

    Bitmaps of half a byte to a byte a hash are compared first; whole sets travel only for the few pairs these leave.
    """

    def bitmap(text: str) -> tuple[int, bytes]:
        return len(h := sets(text)), _bitmap(h)

    def whole(text: str) -> tuple[int, bytes]:
        return len(h := sets(text)), h.tobytes()

    def may(n: int, x: pa.Buffer, m: int, y: pa.Buffer) -> bool:
        return _may_resemble(n, np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8), threshold)

    def is_near(n: int, x: pa.Buffer, m: int, y: pa.Buffer) -> bool:
        both = share(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))
        return both > 0 and both >= threshold * (n + m - both) - 1e-9

    return _compared(texts, checkpoint(_compared(texts, pairs, bitmap, may)), whole, is_near)


def resembling_components(texts: DataFrame, known: DataFrame, sets: Sets, threshold: float) -> DataFrame:
    """(doc, component): known, with the components that pairs at `threshold` or more connect merged into their smallest.

    texts: (doc, text) without nulls, cheap to read again (text is read several times). known: (doc, component), one row a doc; docs of
    equal texts have one component. sets gives a text's sorted distinct hashes; an empty set resembles nothing. All texts of a
    repeated doc count. An empty table gives an empty one.
    """
    n = partitions(texts.sparkSession)
    sort = lambda rows, order: rows.repartition(n, "sig").sortWithinPartitions(*order)
    found = sort(prefix_rows(texts, sets, threshold), ORDER).mapInArrow(_shared, ROWS)
    shared = checkpoint(found.join(known, "doc").select("sig", "doc", F.col("component").alias("h"), "n", "place"))
    tried = None  # (a, b) that were compared
    merged = None  # (component, whole) of the components that are part of another by now

    def now(rows: DataFrame, name: str) -> DataFrame:
        if merged is None:
            return rows
        return rows.join(merged.toDF(name, "_whole"), name, "left").withColumn(name, F.coalesce("_whole", name)).drop("_whole")

    by_place = ("sig", "place", "n", "doc")
    for order, pairs in ((ORDER, _neighbours), (by_place, _firsts), (ORDER, _nearest), (ORDER, _apart)):
        rows = now(shared, "h").select("sig", "doc", "h", "n", "place")
        left = sort(rows, order).mapInArrow(pairs(threshold), PAIRS).distinct()
        left = checkpoint(left if tried is None else left.join(tried, ["a", "b"], "left_anti").select(*_PAIR_NAMES))
        tried = left.select("a", "b") if tried is None else tried.unionByName(left.select("a", "b"))
        links = verified(texts, left, sets, threshold)
        new = connected_components(links, "ca", "cb").where("node <> component").toDF("component", "whole")
        if merged is not None:
            moved = merged.join(new.toDF("whole", "_further"), "whole", "left").select("component", F.coalesce("_further", "whole").alias("whole"))
            new = moved.unionByName(new)
        merged = broadcast_if_small(checkpoint(new), BROADCAST_IDS)
    return now(known, "component").select("doc", "component")
