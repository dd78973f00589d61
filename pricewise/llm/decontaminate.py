"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are reduced to words (A-Z lower-cased, ASCII punctuation and white space
separate), joined by single spaces.  A pattern is a window of ``WINDOW`` consecutive item
words, or a whole shorter item, with a space on both sides.  Per length group the search
keeps the classic tables: a shift table over hashed blocks that says how far no pattern can
start, buckets by suffix block narrowed by the prefix block, and a direct comparison.  The
cursors of all text segments of a batch move together, as numpy arrays.

Cases: null text or no words: no hits; items that are null or have no words give no
pattern; an item with a null id is searched for and hits words, but is not counted or listed;
repeated item ids count once; empty tables give empty results or no hits.  Patterns go out in
blocks of at most ``BLOCK_BYTES`` bytes, one pass over the documents per block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import map_rows, text_bytes, texts

WINDOW = 10
#: Bytes of pattern text in one broadcast block, and the bits of a shift table.
BLOCK_BYTES = 16_000_000
TABLE_BITS = 20
#: Alignments one cursor walks over.
SEGMENT = 2_048

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    n = len(words)
    if not n:
        return []
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(max(1, n - size + 1))]


class Group:
    """Tables for patterns of similar length: ``m`` is the length of the shortest."""

    def __init__(self, patterns: list[bytes], bits: int = TABLE_BITS):
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << 8 * b) - 1)
        self.drop = np.uint64(64 - bits)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        padded = np.zeros((len(patterns), m + 8), np.uint8)
        padded[:, :m] = heads
        self.shift = np.full(1 << bits, m - b + 1, np.int32)
        for at in range(m - b + 1):  # the last block wins: the smallest shift
            np.minimum.at(self.shift, self.slot(self.words(padded, at)), m - b - at)
        suffix, prefix = self.words(padded, m - b), self.words(padded, 0)
        keys = self.pair(suffix, prefix)
        self.keys = np.unique(keys)
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        for k, p in zip(keys.tolist(), patterns):
            self.buckets[k].append(p)

    def words(self, rows: np.ndarray, at: int) -> np.ndarray:
        return np.ascontiguousarray(rows[:, at:at + 8]).view("<u8").ravel() & self.mask

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _MIX) >> self.drop).astype(np.int64)

    @staticmethod
    def pair(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return suffix * _MIX + (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def occurrences(self, data: bytes, n: int) -> list[tuple[int, bytes]]:
        """(position, pattern) of every occurrence in ``data[:n]``; ``data`` has 8 spare bytes."""
        last = n - self.m  # the last alignment
        if last < 0:
            return []
        view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        at = np.arange(0, last + 1, SEGMENT, dtype=np.int64)
        end = np.minimum(at + SEGMENT, last + 1)
        found: list[tuple[int, bytes]] = []
        tail = self.m - self.block
        while at.size:
            suffix = view[at + tail] & self.mask
            jump = self.shift[self.slot(suffix)]
            stop = np.flatnonzero(jump == 0)
            if stop.size:
                here = at[stop]
                keys = self.pair(suffix[stop], view[here] & self.mask)
                place = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
                for i in np.flatnonzero(self.keys[place] == keys).tolist():
                    p = int(here[i])
                    found += [(p, x) for x in self.buckets[int(keys[i])] if data.startswith(x, p) and p + len(x) <= n]
                jump[stop] = 1
            at = at + jump
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        return found


class Matcher:
    """Pattern groups by length, so one short pattern does not shorten every shift."""

    def __init__(self, patterns: list[bytes]):
        by_length = defaultdict(list)
        for p in patterns:
            by_length[min(len(p) // 8, 6)].append(p)
        self.groups = [Group(ps) for _, ps in sorted(by_length.items())]

    def occurrences(self, data: bytes, n: int) -> list[tuple[int, bytes]]:
        return [x for g in self.groups for x in g.occurrences(data, n)]


def patterns(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct patterns of the items with the sorted ids of the items that hold each."""
    def run(batch):
        rows = [(i, w) for i, t in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text"))) for w in set(windows_of(words_of(t), window))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "pattern"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_rows(items, run, "item_id string, pattern binary") \
        .groupBy("pattern").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Blocks of {pattern: items}, each of bounded size; rows come one partition at a time."""
    block, held = {}, 0
    for r in patterns(benchmark, window).toLocalIterator():
        p = bytes(r["pattern"])
        if block and held + len(p) > block_bytes:
            yield block
            block, held = {}, 0
        block[p] = r["items"]
        held += len(p) + 16 * len(r["items"])
    yield block


def search_batch(batch_texts: list[bytes], matcher: Matcher | None, items: dict) -> list[tuple[int, list[tuple[int, int]], set]]:
    """Per text: its number of words, the hit word intervals (start, end) and the item ids."""
    words = [words_of(t) for t in batch_texts]
    out = [(len(w), [], set()) for w in words]
    if matcher is None:
        return out
    joined = [b" " + b" ".join(w) + b" " for w in words]
    data = b"\x00".join(joined)
    n = len(data)
    data += bytes(16)
    found = matcher.occurrences(data, n)
    if found:
        begins = np.cumsum([0] + [len(j) + 1 for j in joined])
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8, n) == _SPACE)
        for p, pattern in found:
            d = int(np.searchsorted(begins, p, "right")) - 1
            first = int(np.searchsorted(spaces, p) - np.searchsorted(spaces, begins[d]))
            out[d][1].append((first, first + pattern.count(b" ") - 1))
            out[d][2].update(items[pattern])
    return out


def covered(intervals) -> int:
    total, upto = 0, 0
    for a, b in sorted(intervals):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items (sorted ids) and contaminated."""
    parts = []
    for block in pattern_blocks(benchmark, window, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(_hits_of_block(docs, sent))
    if len(parts) == 1:
        return _summary(parts[0])
    # Several blocks: the same rows of `docs` come back once per block; they meet by row key.
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.groupBy("doc_id", "key", "n_words").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        (F.count("*") / len(parts)).cast("int").alias("copies"))
    return _summary(merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))))


def _matcher(sent) -> Matcher | None:
    """The tables of a broadcast block, built once per worker process."""
    if sent.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[sent.id] = Matcher(list(sent.value)) if sent.value else None
    return _MATCHERS[sent.id]


_MATCHERS: dict = {}


class _Sent:
    """A broadcast with a name that survives pickling."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else None

    @property
    def value(self):
        return self.broadcast.value


def _hits_of_block(docs: DataFrame, broadcast) -> DataFrame:
    sent = _Sent(broadcast)

    def run(batch):
        data = text_bytes(batch.column("text"))
        rows = search_batch(data, _matcher(sent), sent.value)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([hashlib.md5(t).digest() for t in data], pa.binary()), pa.array([r[0] for r in rows], pa.int64()),
             pa.array([[{"a": a, "b": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
             pa.array([sorted(x for x in r[2] if x is not None) for r in rows], pa.list_(pa.string()))],
            names=["doc_id", "key", "n_words", "spans", "items"])

    return map_rows(texts(docs), run, "doc_id long, key binary, n_words long, spans array<struct<a:long,b:long>>, items array<string>")


def _summary(found: DataFrame) -> DataFrame:
    """Union of the word intervals, counted in the row."""
    ordered = F.array_sort("spans")
    step = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
                       lambda s, x: F.struct((s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, s.upto))).alias("n"),
                                             F.greatest(s.upto, x.b).alias("upto")))
    return found.select("doc_id", "n_words", step["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.array_sort("items").alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without any benchmark window (one pass per block)."""
    for block in pattern_blocks(benchmark, window, block_bytes):
        sent = _Sent(docs.sparkSession.sparkContext.broadcast(block))

        def run(batch, sent=sent):
            rows = search_batch(text_bytes(batch.column("text")), _matcher(sent), sent.value)
            return batch.filter(pa.array([not r[1] for r in rows], pa.bool_()))

        docs = map_rows(docs, run, docs.schema)
    return docs
