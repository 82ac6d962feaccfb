"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are words and runs of punctuation, each numbered by a 63-bit hash: the vocabulary is open, no word shares
its counts with another. Texts are kept in blocks; n-grams are 64-bit hashes, dealt into shards by their top bits (a
triple by those of its first pair), and travel as sorted packed lists, a row for each block and shard. Counts of all
trusted text are a table bucketed by shard, one model a language. To score, each block's distinct n-grams meet the
shards; what is found comes back in the order of the questions, so without keys, and the block's texts are read from it.

Counting goes through the shards and scoring through the texts in rounds, whose shuffle files and tables are removed
before the next, so that the disk holds the model and one round. Texts are kept up to a quantile of the perplexity of
their language's trusted texts that weren't counted.

Bounds: a block closes at BLOCK_TOKENS tokens. Vocabulary, counts, scores and quantiles cover all texts; rounds leave none out.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, new_path, partitions, remove_written, table, temporary, written

BLOCK_TOKENS = 2_000_000
#: Rows that a round takes, up to so many rounds of counting and of scoring: more rounds need less disk and more time.
ROUND_ROWS, COUNT_ROUNDS, SCORE_ROUNDS = 16_000, 16, 16
#: Words whose numbers a task remembers.
REMEMBERED = 300_000
#: One in CALIBRATE trusted texts is kept out of the counts; the thresholds are quantiles of their perplexity, as
#: texts that were counted have less than others like them.
CALIBRATE = 5
#: Share of these texts that a threshold keeps.
QUANTILE = 0.99
BROADCAST_ROWS = 200_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Start, end; words have the numbers from FIRST_WORD.
START, END, FIRST_WORD = 0, 1, 2
#: Spark's seed of xxhash64.
SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class _Numbers(dict):
    """Numbers of words, by hash where none is given."""

    def __missing__(self, word: str) -> int:
        self[word] = n = max(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1, FIRST_WORD)
        return n


def numbers(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """The text's tokens by number: that of `vocabulary` where it has one, else the token's hash."""
    found = TOKEN.findall(text or "")
    known = vocabulary if isinstance(vocabulary, _Numbers) else _Numbers(vocabulary)
    return np.fromiter(map(known.__getitem__, found), "<i8", len(found))


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<i8").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8")


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: low bytes as they are, what is above them as a bit a key and a bit a step."""
    if not len(keys):
        return b""
    n, rest = len(keys), keys - keys[0]
    low = min(range(8), key=lambda b: n * b + (int(rest[-1]) >> 8 * b) / 8)
    high = (rest >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(high[-1] + 1, bool)
    bits[high] = True
    return struct.pack("<QQB", n, int(keys[0]), low) + _low_bytes(rest, low) + np.packbits(bits).tobytes()


def _unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    n, first, low = struct.unpack_from("<QQB", packed)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=17 + n * low)))[:n] - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(8 * low)) + _from_low_bytes(packed[17 : 17 + n * low], low, n) + np.uint64(first)


def _low_bytes(x: np.ndarray, low: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()


def _from_low_bytes(packed: bytes, low: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(packed, np.uint8).reshape(n, low)
    return out.view("<u8")[:, 0]


def _pack_ints(x: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + zlib.compress(x.astype(kind.newbyteorder("<")).tobytes(), 1)


def _unpack_ints(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(starts, append=n)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place there of each value."""
    order = np.argsort(x)
    own = x[order]
    first = np.ones(len(x), bool)
    first[1:] = own[1:] != own[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(first) - 1
    return own[first], at


def _padded(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate([[START, START], tokens, [END]]).astype(np.int64)


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _hashed(seed: np.ndarray | int, x: np.ndarray) -> np.ndarray:
    """xxhash64 of a column of longs after those hashed into `seed`, as Spark has it."""
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.int64).view(np.uint64) + _P5 + np.uint64(8)
        h = h ^ (_rotl(np.asarray(x, np.int64).view(np.uint64) * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def keys(lang: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (hashes of 64 bits) of the language, and of the padded text's words (all but the first), pairs and triples; the last of each three are of token k and the end."""
    s = _padded(tokens)
    own = _hashed(np.full(1, SEED, np.int64), np.full(1, lang, np.int64))
    k1 = _hashed(np.full(len(s), own[0]), s)
    k2 = _hashed(k1[:-1], s[1:])
    return own, k1[1:], k2, _hashed(k2[:-1], s[2:])


def language_key(lang: str | None) -> int:
    """The language's number; 0 for null."""
    return 0 if lang is None else (xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) >> 1) | 1


def encode(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, lang, lang_id, tokens): one row for each row of docs."""
    remembered = REMEMBERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers(vocabulary)
        for batch in batches:
            packed = []
            for text in batch.column(2).to_pylist():
                packed.append(_pack(numbers(text, known)))
                if len(known) > remembered:
                    known = _Numbers(vocabulary)
            ids = [language_key(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "lang", "lang_id", "tokens"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, lang_id long, tokens binary")


def blocks(texts: DataFrame) -> DataFrame:
    """(block, ids, langs, lang_ids, sizes, words, at): a row for each BLOCK_TOKENS tokens; the tokens of all its texts are words[at]. Written. texts: encoded, or (doc_id, lang, text)."""
    limit, remembered, columns = BLOCK_TOKENS, REMEMBERED, ("doc_id", "lang", "tokens" if "tokens" in texts.columns else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, wait, known = TaskContext.get().partitionId() << 32, 0, [], _Numbers()

        def flush() -> pa.RecordBatch:
            ids, langs, lang_ids, tokens = zip(*wait, strict=True)
            words, at = _distinct(np.concatenate(tokens).view(np.uint64))
            row = {"block": [block], "ids": [ids], "langs": [langs], "lang_ids": [lang_ids], "sizes": [[len(t) for t in tokens]], "words": [_pack_keys(words)], "at": [_pack_ints(at)]}
            return pa.RecordBatch.from_pydict(row, _BLOCK)

        for batch in batches:
            for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = _unpack(text) if columns[2] == "tokens" else numbers(text, known)
                wait.append((doc, lang, language_key(lang), tokens))
                filled += len(tokens)
                if len(known) > remembered:
                    known = _Numbers()
                if filled >= limit:
                    yield flush()
                    block, filled = block + 1, 0
                    wait.clear()
        if wait:
            yield flush()

    return written(texts.select(*columns).mapInArrow(run, "block long, ids array<long>, langs array<string>, lang_ids array<long>, sizes array<long>, words binary, at binary"))


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("lang_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("at", pa.binary())])
#: Bits of a triple's key that are those of its first pair.
_TOP = 16


def _grams(block: dict) -> tuple[np.ndarray, ...]:
    """Of a block's padded texts, one after the other: the tokens; keys of the languages by text, of words and of pairs by place; whether a triple begins at a pair's place; the texts' sizes."""
    sizes, lang_ids = (np.array(block[k], np.int64) for k in ("sizes", "lang_ids"))
    ends = np.cumsum(sizes + 3)
    s = np.full(ends[-1], START, np.int64)
    s[np.arange(sizes.sum()) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes)] = _unpack_keys(block["words"]).view(np.int64)[_unpack_ints(block["at"])]
    s[ends - 1] = END
    k0 = _hashed(np.full(len(sizes), SEED, np.int64), lang_ids)
    k1 = _hashed(np.repeat(k0, sizes + 3), s)
    k2 = _hashed(k1[:-1], s[1:])
    begins = np.ones(len(k2), bool)
    begins[ends - 2] = begins[ends[:-1] - 1] = False
    return s, *(k.view(np.uint64) for k in (k0, k1, k2)), begins, sizes


def _triples(s: np.ndarray, k2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the triples that begin at these places."""
    return _of_pair(k2[at], _hashed(k2[at].view(np.int64), s[at + 2]).view(np.uint64))


def _of_pair(pair: np.ndarray, triple: np.ndarray) -> np.ndarray:
    top = np.uint64(64 - _TOP)
    return (pair >> top << top) | (triple >> np.uint64(_TOP))


def _shard_bits(n: int) -> int:
    return min(max(4, (2 * n - 1).bit_length()), _TOP)


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys, and the end."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    wait = []
    for row in rows:
        wait.append(row)
        if len(wait) == 200:
            yield pa.RecordBatch.from_pylist(wait, schema)
            wait = []
    if wait:
        yield pa.RecordBatch.from_pylist(wait, schema)


_COUNTED = pa.schema([("shard", pa.int64()), *((k, pa.binary()) for k in ("triples", "pairs", "counts", "keys", "runs", "firsts", "middles", "lasts", "langs"))])
_MODEL = pa.schema([("shard", pa.int64()), ("triples", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("values", pa.list_(pa.binary())), ("langs", pa.binary()), ("kind", pa.int64()), ("times", pa.list_(pa.int64()))])
_MODEL_SQL = "shard long, triples binary, counts binary, keys binary, values array<binary>, langs binary, kind long, times array<long>"


def _classes(n: np.ndarray, most: int) -> list[np.ndarray]:
    """Whether n is 1, 2 and so on; the last, at least `most`."""
    return [n == k if k < most else n >= k for k in range(1, most + 1)]


def _summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys, sums of the values, and a place of each key."""
    order = np.argsort(keys)
    at = _starts(keys[order])
    return keys[order][at], [np.add.reduceat(v[order].astype(np.int64), at) if len(at) else v[:0] for v in values], order[at]


def _shard_model(shard: int, rows: list[dict]) -> Iterator[dict]:
    """Counts of a shard's triples and pairs (kind 0), and what the pairs give their words (kind 1; to be summed over shards).

    values: n (how many words stand before it), total, n1, n2, n3 (of what follows it: all, and how many once, twice, more often).
    """
    triples = [_unpack_keys(r["triples"]) for r in rows]
    top = np.uint64(64 - _TOP)
    pairs = np.concatenate([(t >> top << top) | _from_low_bytes(r["pairs"], 6, len(t)) for t, r in zip(triples, rows, strict=True)])
    triples, (c,), one = _summed(np.concatenate(triples), [np.concatenate([_unpack_ints(r["counts"]) for r in rows])])
    contexts, follow, _ = _summed(pairs[one], [c, *_classes(c, 3)])
    runs = [_unpack_ints(r["runs"]) for r in rows]
    keys = np.concatenate([np.repeat(_unpack_keys(r["keys"]), n) for r, n in zip(rows, runs, strict=True)])
    first = np.concatenate([_from_low_bytes(r["firsts"], 6, int(n.sum())) for r, n in zip(rows, runs, strict=True)])
    order = np.lexsort((first, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (first[order][1:] != first[order][:-1])
    keys, (n,), _ = _summed(keys[order][new], [np.ones(int(new.sum()), np.int64)])
    all_keys, values, _ = _summed(np.concatenate([keys, contexts]), [np.concatenate([a, b]) for a, b in zip([n, *[0 * n] * 4], [0 * contexts.astype(np.int64), *follow], strict=True)])
    times = [int(x.sum()) for t in (c, n) for x in [t == k for k in (1, 2, 3, 4)]]
    empty = {"triples": b"", "counts": _pack_ints(c[:0])}
    yield {"shard": shard, "triples": _pack_keys(triples), "counts": _pack_ints(c), "keys": _pack_keys(all_keys), "values": [_pack_ints(v) for v in values], "langs": b"", "kind": 0, "times": times}
    own, _, at = _summed(np.concatenate([_unpack_keys(r["keys"]) for r in rows]), [])
    middle, last, lang = (np.concatenate(x)[at] for x in ([np.frombuffer(r["middles"], "<u8") for r in rows], [np.frombuffer(r["lasts"], "<u8") for r in rows], [_unpack_ints(r["langs"]) for r in rows]))
    assert len(own) == len(n)
    none, before = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    words, values, at = _summed(np.concatenate([middle, last]), [np.concatenate([a, b]) for a, b in zip([none, n, *_classes(n, 3)], [before, *[none] * 4], strict=True)])
    yield {"shard": shard, **empty, "keys": _pack_keys(words), "values": [_pack_ints(v) for v in values], "langs": _pack_ints(np.concatenate([lang, lang])[at].view(np.uint64)), "kind": 1, "times": [0] * 8}


def model(texts: DataFrame, name: str, path: str, rounds: int = 1) -> DataFrame:
    """The model of blocks of texts: a table `name` bucketed by shard, of rows as _shard_model has them; kind 2 are words and languages, with their counts of counts and the bits of a shard in `times`."""
    spark = texts.sparkSession
    n = partitions(spark)
    bits = _shard_bits(n)
    words_path = new_path(spark, "words")

    def append(rows: DataFrame) -> None:
        rows.write.bucketBy(n, "shard").option("path", path).mode("append").saveAsTable(name)

    def counted(number: int):
        def rows(block: dict) -> Iterator[dict]:
            s, k0, k1, k2, begins, sizes = _grams(block)
            mine = (k2 >> np.uint64(64 - bits)) % np.uint64(rounds) == number
            at = np.flatnonzero(begins & mine)
            t, pair = _triples(s, k2, at), k2[at]
            order = np.argsort(t)
            t, pair = t[order], pair[order]
            start = _starts(t)
            t, pair, c = t[start], pair[start], _lengths(start, len(t))
            at = np.flatnonzero(begins[:-1] & mine[1:])
            key, first = k2[at + 1], _triples(s, k2, at)
            order = np.lexsort((first, key))
            key, first = key[order], first[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1])
            order, key, first = order[new], key[new], first[new]
            start = _starts(key)
            run, place = _lengths(start, len(key)), order[start]
            key = key[start]
            at = at[place]
            middle, last, lang = k1[at + 1], k1[at + 2], np.repeat(k0, sizes + 3)[at]
            begin = np.append(start, len(first))
            cut_t, cut_k = _edges(t, bits), _edges(key, bits)
            for shard in range(number, 1 << bits, rounds):
                a, b = slice(cut_t[shard], cut_t[shard + 1]), slice(cut_k[shard], cut_k[shard + 1])
                if a.start < a.stop or b.start < b.stop:
                    yield {
                        "shard": shard, "triples": _pack_keys(t[a]), "pairs": _low_bytes(pair[a], 6), "counts": _pack_ints(c[a]),
                        "keys": _pack_keys(key[b]), "runs": _pack_ints(run[b]), "firsts": _low_bytes(first[begin[b.start] : begin[b.stop]], 6),
                        "middles": middle[b].tobytes(), "lasts": last[b].tobytes(), "langs": _pack_ints(lang[b]),
                    }

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches((r for batch in batches for block in batch.to_pylist() for r in rows(block)), _COUNTED)

        return run

    def reduce(key: tuple, found: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_shard_model(key[0].as_py(), found.to_pylist())), _MODEL)

    for number in range(rounds):
        with temporary(spark):
            kinds = ", ".join(f"{f.name} {'long' if f.name == 'shard' else 'binary'}" for f in _COUNTED)
            part = written(texts.mapInArrow(counted(number), kinds).groupBy("shard").applyInArrow(reduce, _MODEL_SQL))
            append(part.where("kind = 0"))
            part.where("kind = 1").select("keys", "values", "langs").write.mode("append").parquet(words_path)
            del part

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                columns = [_unpack_keys(r["keys"]).view(np.int64), _unpack_ints(r["langs"]), *map(_unpack_ints, r["values"])]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["key", "lang", "n", "total", "n1", "n2", "n3"])

    def pack(key: tuple, found: pa.Table) -> pa.Table:
        x = {c: found[c].to_numpy() for c in ("key", "n", "total", "n1", "n2", "n3")}
        order = np.argsort(x["key"].view(np.uint64))
        row = {"shard": key[0].as_py(), "triples": b"", "counts": _pack_ints(order[:0]), "keys": _pack_keys(x["key"].view(np.uint64)[order]), "langs": b"", "kind": 2}
        return pa.Table.from_pylist([row | {"values": [_pack_ints(x[c][order]) for c in ("n", "total", "n1", "n2", "n3")], "times": found["times"][0].as_py()}], _MODEL)

    columns = ("n", "total", "n1", "n2", "n3")
    with temporary(spark):
        words = spark.read.schema("keys binary, values array<binary>, langs binary").parquet(words_path).mapInArrow(flat, "key long, lang long, n long, total long, n1 long, n2 long, n3 long")
        words = written(words.groupBy("key", "lang").agg(*[F.sum(c).alias(c) for c in columns]))
        remove_written(spark, {words_path})
        times = [int(x or 0) for x in words.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()]
        langs = words.where("n > 0").groupBy("lang").agg(F.lit(0).cast("long").alias("n"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") >= 3).alias("n3"))
        entries = words.select("key", *columns).unionByName(langs.withColumnRenamed("lang", "key")).withColumn("shard", F.expr(f"shiftrightunsigned(key, {64 - bits})")).withColumn("times", F.array(*[F.lit(t).cast("long") for t in (*times, bits)]))
        append(entries.groupBy("shard").applyInArrow(pack, _MODEL_SQL))
        del words, langs, entries
    return spark.table(name)


def _name() -> str:
    return f"tallyglass_{uuid.uuid4().hex}"


def count_trigrams(encoded: DataFrame) -> DataFrame:
    """The model of encoded texts."""
    return model(blocks(encoded), _name(), new_path(encoded.sparkSession, "model"))


def distinct_words(texts: DataFrame) -> int:
    """How many different tokens the texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpack_keys(words).view(np.int64))], ["word"])

    return texts.select("words").mapInArrow(run, "word long").distinct().count()


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0 (none), 1, 2 and from 3, from how often the counts 1 to 4 occur; 0.75 where those are missing."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.75 for k in range(3)]
    return np.array([0.0] + [min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)])


def all_discounts(counts: DataFrame) -> tuple[list[np.ndarray], int]:
    """Those of triples, pairs and words, and the bits of a shard."""
    times = counts.where("kind = 0").agg(*[F.sum(F.col("times")[k]) for k in range(8)]).first()
    words = counts.where("kind = 2").agg(*[F.max(F.col("times")[k]) for k in range(5)]).first()
    return [discounts([int(x or 0) for x in n]) for n in (times[:4], times[4:], words[:4])], words[4] or 4


_ASKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("triples", pa.binary()), ("keys", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("known", pa.binary()), ("counts", pa.binary()), ("known_keys", pa.binary()), ("values", pa.list_(pa.binary()))])
_SCORED_SQL = "doc_id long, lang string, n_tokens long, perplexity double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("perplexity", pa.float64())])


def _answers(asked: list[dict], shards: list[dict]) -> Iterator[dict]:
    """For each row of questions, which of them the model has, and the counts of these, in the order of the questions."""
    have = [(_unpack_keys(m["triples"]), [_unpack_ints(m["counts"])], _unpack_keys(m["keys"]), [_unpack_ints(v) for v in m["values"]]) for m in shards]

    def look(ask: np.ndarray, tables: list[tuple[np.ndarray, list[np.ndarray]]], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        known, out = np.zeros(len(ask), bool), [np.zeros(len(ask), np.int64) for _ in range(width)]
        for own, values in tables:
            if len(own):
                at = np.minimum(np.searchsorted(own, ask), len(own) - 1)
                hit = own[at] == ask
                known |= hit
                for o, v in zip(out, values, strict=True):
                    o[hit] = v[at[hit]]
        return known, [o[known] for o in out]

    for r in asked:
        known, (c,) = look(_unpack_keys(r["triples"]), [x[:2] for x in have], 1)
        known_keys, values = look(_unpack_keys(r["keys"]), [x[2:] for x in have], 5)
        yield {"block": r["block"], "shard": r["shard"], "known": _pack_known(known), "counts": _pack_ints(c), "known_keys": _pack_known(known_keys), "values": [_pack_ints(v) for v in values]}


def _pack_known(known: np.ndarray) -> bytes:
    return struct.pack("<Q", len(known)) + np.packbits(known).tobytes()


def _unpack_known(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8, offset=8), count=struct.unpack_from("<Q", packed)[0]).astype(bool)


def _asked(grams: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of triples and of pairs; keys of the triples, and of pairs, words and languages."""
    s, k0, k1, k2, begins, _ = grams
    at, pairs = np.flatnonzero(begins), begins.copy()
    pairs[1:] |= begins[:-1]
    return at, pairs, _triples(s, k2, at), np.concatenate([k2[pairs], k1, k0])


def _sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_starts(x)]


def _perplexity(block: dict, answers: list[dict], off: list[np.ndarray], words: int) -> np.ndarray:
    """Of each text; NaN without tokens."""
    grams = _grams(block)
    at, pairs, triples, keys = _asked(grams)
    (triples, here), (keys, place) = _distinct(triples), _distinct(keys)
    _, _, k1, _, _, sizes = grams
    of_pair = np.cumsum(pairs) - 1
    inside = of_pair[-1] + 1
    of_word = place[inside : inside + len(k1)]
    pair, later, middle, last = place[of_pair[at]], place[of_pair[at + 1]], of_word[at + 1], of_word[at + 2]
    lang = np.repeat(place[inside + len(k1) :], sizes + 1)
    answers = sorted(answers, key=lambda r: r["shard"])

    def column(known: str, get, n: int) -> np.ndarray:
        mask, out = np.concatenate([_unpack_known(r[known]) for r in answers]), np.zeros(n, np.int64)
        out[mask] = np.concatenate([_unpack_ints(get(r)) for r in answers])
        return out

    c = column("known", lambda r: r["counts"], len(triples))
    n, total, n1, n2, n3 = (column("known_keys", lambda r, k=k: r["values"][k], len(keys)) for k in range(5))

    def p(count: np.ndarray, context: np.ndarray, d: np.ndarray, lower: np.ndarray | float) -> np.ndarray:
        of, rest = total[context], (n1 * d[1] + n2 * d[2] + n3 * d[3])[context]
        return np.where(of > 0, (count - d[np.minimum(count, 3)] + rest * lower) / np.maximum(of, 1), lower)

    d3, d2, d1 = off
    logs = np.log(p(c[here], pair, d3, p(n[later], middle, d2, p(n[last], lang, d1, 1.0 / words))))
    mean = np.add.reduceat(logs, np.cumsum(sizes + 1) - sizes - 1) / (sizes + 1)
    return np.where(sizes > 0, np.exp(-mean), np.nan)


def perplexities(encoded: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity) for each row, encoded or (doc_id, lang, text); perplexity is null without tokens. words: how many a word is one of where nothing is known of it."""
    (off, bits), texts = all_discounts(counts), blocks(encoded)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: dict) -> Iterator[dict]:
            triples, keys = map(_sorted, _asked(_grams(block))[2:])
            cut_t, cut_k = _edges(triples, bits), _edges(keys, bits)
            for shard in range(1 << bits):
                a, b = slice(cut_t[shard], cut_t[shard + 1]), slice(cut_k[shard], cut_k[shard + 1])
                if a.start < a.stop or b.start < b.stop:
                    yield {"shard": shard, "block": block["block"], "triples": _pack_keys(triples[a]), "keys": _pack_keys(keys[b])}

        yield from _batches((r for batch in batches for block in batch.to_pylist() for r in rows(block)), _ASKED)

    def answer(asked: pa.Table, shards: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_answers(asked.to_pylist(), shards.to_pylist())), _FOUND)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for block in texts.to_pylist():
            p = _perplexity(block, answers.to_pylist(), off, words)
            out.append(pa.Table.from_arrays([pa.array(block["ids"], pa.int64()), pa.array(block["langs"], pa.string()), pa.array(block["sizes"], pa.int64()), pa.array(p, pa.float64(), from_pandas=True)], schema=_SCORED))
        return pa.concat_tables(out) if out else _SCORED.empty_table()

    asked = texts.mapInArrow(ask, "shard long, block long, triples binary, keys binary")
    known = counts.select("shard", "triples", "counts", "keys", "values")
    found = written(asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block long, shard long, known binary, counts binary, known_keys binary, values array<binary>"))
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, _SCORED_SQL)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep) for each row of docs.

    Trusted are the documents whose labels all have quality 1. threshold: the QUANTILE of the perplexities
    of the language's uncounted trusted texts, of all its texts where it has none; a null lang is a language of its own. keep:
    perplexity up to the threshold; a text without tokens has null perplexity and isn't kept. Repeated rows and null
    ids each give a row; other columns aren't read. An empty table gives an empty one. docs is read again in each round:
    rows go to rounds by a hash of their values.
    """
    spark = docs.sparkSession
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.count_if(F.col("quality").isNull()).alias("none")).where("q = 1 and none = 0").select("doc_id")
    trusted = checkpoint(trusted)
    known = broadcast_if_small(trusted, BROADCAST_ROWS)
    counted = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) > 0
    rounds = 1 + docs.count() // ROUND_ROWS
    docs = docs.select("doc_id", "lang", "text")
    path, name = new_path(spark, "scores"), _name()
    with temporary(spark):
        model_path = new_path(spark, "model")
        with temporary(spark):
            texts = blocks(docs.where(counted).join(known, "doc_id", "left_semi"))
            words = distinct_words(texts) + len(texts.select("block").head(1)) + 1
            counts = model(texts, name, model_path, min(rounds, COUNT_ROUNDS))
            del texts
        rounds = min(rounds, SCORE_ROUNDS)
        for number in range(rounds):
            with temporary(spark):
                mine = docs.where(F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(rounds)) == number)
                perplexities(mine, counts, words).write.mode("append").parquet(path)
        spark.sql(f"DROP TABLE {name}")
    scored = spark.read.schema(_SCORED_SQL).parquet(path)
    marked = scored.join(known.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("own", F.when(F.col("trusted") & ~counted, F.col("perplexity")))
    limits = marked.groupBy("lang").agg(F.coalesce(F.percentile_approx("own", QUANTILE, 10_000), F.percentile_approx("perplexity", QUANTILE, 10_000)).alias("threshold"))
    limits = broadcast_if_small(checkpoint(limits), BROADCAST_ROWS)
    joined = scored.alias("s").join(limits.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")), "left")
    return joined.select("doc_id", F.col("s.lang").alias("lang"), "n_tokens", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
