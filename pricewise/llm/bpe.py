"""Byte-level BPE encoding and decoding over distinct words.

Tasks cut whole texts into words and write them once, a slice of some megabytes of text at a time:
every document as numbers of distinct words.  The slices' distinct words are shuffled, and each is
folded once: Spark higher-order functions apply ranked merges (lowest rank first, leftmost first) to
its bytes.  The rank map is the value of a scalar subquery: an array of small maps, addressed by the hash
of the piece, so a lookup costs the same whatever the vocabulary's size and no plan holds its text.  The ids
go back to the slices that hold the word, where documents are put together and decoded.

A word is shuffled once per slice, however often it occurs, and the most frequent words of a
bounded sample not at all: they are folded first and sent to all tasks.  That only saves time and disk;
both ways give the same ids.  Words and ids travel in packets, one a slice and bucket of words; the documents
are written in buckets of their slices and not shuffled.  Words of more than ``LONG_BYTES`` bytes are merged
where they occur, by a heap of ranks: the fold rewrites its arrays with every merge, which is quadratic in the length.

Bytes and pieces are written as hex strings inside the expressions (a piece is a string key).

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows, also of one doc_id,
are encoded alike and each has its row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm.common import ship, slices, texts
from pricewise.session import materialize, materialize_by

#: Characters of text whose distinct words are numbered together, and the longest word that is shuffled and folded.
SLICE_CHARS = 32_000_000
LONG_BYTES = 128
#: Documents that the dictionary of common words is taken from, and its entries.
SAMPLE_DOCUMENTS = 10_000
COMMON_WORDS = 32_768
#: Buckets of words for each shuffle partition, and the mentions of words whose ids a task packs together.
BUCKETS = 16
PACKED_MENTIONS = 250_000
#: Packed documents that are put together at once.
PART_BYTES = 500_000
#: Between the words of a packet; a word that holds it is merged where it occurs.
BETWEEN = "\x00"

SPLIT = ("slice long, doc_id long, numbers binary, packets array<struct<bucket: int, numbers: array<int>, words: string>>, "
         "far array<struct<number: int, ids: array<int>>>")
CODED = "doc_id long, ids array<int>, id_bytes binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _buckets(ranks: dict[bytes, int]) -> list[list[tuple[str, int]]]:
    """The rank map by hex strings, as a list of maps of an entry or two, addressed by bits of the key's hash."""
    rows: list[list] = [[] for _ in range(1 << max(1, len(ranks).bit_length() - 1))]
    for k, v in ranks.items():
        key = k.hex().upper()
        rows[xxhash.xxh64_intdigest(key.encode(), 42) & (len(rows) - 1)].append((key, v))
    return rows


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as the value of a scalar subquery, for a projection below the fold (subqueries may not stand in
    higher-order functions; the optimizer puts it there).  A literal would stand in the text of every plan that Spark keeps."""
    one = pa.table({"ranks": pa.array([_buckets(ranks)], pa.list_(pa.map_(pa.string(), pa.int32())))})
    return materialize(spark.createDataFrame(one), "ranks").scalar()


def _find(table: Column, key: Column) -> Column:
    """The entry of ``key``, null if absent."""
    return F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(F.size(table) - 1).cast("int")), key)


def _state(pieces: Column, ranks: Column) -> Column:
    return F.struct(pieces.alias("p"), ranks.alias("r"), F.array_min(ranks).alias("best"))


def _merge_first(rank, s: Column) -> Column:
    """Merge the leftmost place of the best rank; only its two neighbours' ranks change."""
    def at(i):
        joined = F.concat(F.get(s.p, i - 1), F.get(s.p, i))

        def merged(t):
            n = F.size(s.p)
            left, right = rank(F.concat(F.get(s.p, i - 2), t)), rank(F.concat(t, F.get(s.p, i + 1)))
            p = F.transform(F.slice(s.p, F.lit(1), n - 1), lambda x, k: F.when(k < i - 1, x).when(k == i - 1, t).otherwise(F.get(s.p, k + 1)))
            r = F.transform(F.slice(s.r, F.lit(1), n - 2), lambda x, k: F.when(k < i - 2, x).when(k == i - 2, left)
                            .when(k == i - 1, right).otherwise(F.get(s.r, k + 1)))
            return _let(r, lambda r: _state(p, r))

        return _let(joined, merged)

    return _let(F.array_position(s.r, s.best).cast("int"), at)


def fold(word: Column, ranks: dict[bytes, int] | Column) -> Column:
    """Ids of one word: its own rank, or the ranked merges of its bytes.  ``ranks`` is the map, which becomes a literal, or
    a column of ``rank_table``.  It is bound once, as a lambda variable: each mention would be another copy of it."""
    if isinstance(ranks, dict):
        ranks = F.from_json(F.lit(json.dumps([dict(x) for x in _buckets(ranks)])), "array<map<string,int>>")

    def folded(t):
        rank = lambda key: _find(t, key)

        def of_bytes(b):
            n = F.length(b)
            pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.hex(F.substring(b, i, F.lit(1))))
            pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda x, y: rank(F.concat(x, y)))
            start = _let(pieces, lambda p: _let(pairs(p), lambda r: _state(p, r)))
            step = lambda s, _: F.when(s.best.isNull(), s).otherwise(_merge_first(rank, s))
            return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.transform(s.p, rank))

        whole = F.transform(F.array(rank(F.hex(word))), lambda x: F.when(x.isNotNull(), F.array(x)))[0]
        return F.coalesce(whole, _let(F.encode(word, "UTF-8"), of_bytes))

    return _let(ranks, folded)


def merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word, by the same merges in the same order: a heap of (rank, place) over linked pieces."""
    if data in ranks:
        return [ranks[data]]
    n = len(data)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    end.append(0)

    def rank(i: int) -> int | None:
        j = after[i]
        return ranks.get(data[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != upto:
            continue  # one of the two has been merged since
        end[i], end[j] = upto, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:end[i]]])
        i = after[i]
    return out


class Common(NamedTuple):
    """The ids of the dictionary's words, end to end, and where each word's begin."""
    words: list[str]
    ids: np.ndarray
    starts: np.ndarray


def learn_common(docs: DataFrame, ranks: dict[bytes, int], pattern: str, documents: int = SAMPLE_DOCUMENTS, words: int = COMMON_WORDS) -> Common:
    """Fold the most frequent words of the ``documents`` with the smallest hash of doc_id, at most ``words``
    of at most ``LONG_BYTES`` bytes, so that they need no shuffle.  Other words get the same ids later."""
    ship(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]):
        import regex
        find = regex.compile(pattern).findall
        for batch in batches:
            for part in slices(batch):
                found = Counter()
                for text in part.column("text"):
                    found.update(find(text.as_py() or ""))
                kept = [w for w in found if len(w.encode()) <= LONG_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([found[w] for w in kept], pa.int64())], names=["word", "n"])

    one = texts(docs)
    ids = one.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    top = one.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(tally, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    # dealt out by word: the limit leaves one partition
    top = top.repartition("word").withColumn("ranks", rank_table(docs.sparkSession, ranks))
    rows = top.select("word", "n", fold(F.col("word"), F.col("ranks")).alias("ids")).collect()
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    return Common([r["word"] for r in rows], np.array([i for r in rows for i in r["ids"]], np.int32), np.cumsum([0] + [len(r["ids"]) for r in rows]))


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, the bytes of one weight together, compressed."""
    return zstandard.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1).T).view("<u4").ravel()


def split(docs: DataFrame, ranks: dict[bytes, int], pattern: str, common: list[str]) -> DataFrame:
    """``SPLIT`` rows, written in buckets of their slices: each document as numbers of words.  The first numbers are
    ``common`` words, the others the further distinct words of its slice, which stand in the slice's last row: in packets
    of those to be folded, by bucket, or ``far`` with their ids."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, common))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packet = pa.struct([("bucket", pa.int32()), ("numbers", pa.list_(pa.int32())), ("words", pa.string())])
    merged = pa.struct([("number", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def number(batches: Iterator[pa.RecordBatch]):
        import regex
        find = regex.compile(pattern).findall
        ranks, common = sent.value
        known = {w: i for i, w in enumerate(common)}
        empty = lambda: defaultdict(count(len(common)).__next__, known)
        seen, name, held = empty(), uuid.uuid4().int >> 65, 0

        def rows(ids: list, cells: list, words: list[str]) -> pa.RecordBatch:
            packets, far = defaultdict(lambda: ([], [])), []
            for i, w in enumerate(words, len(common)):
                data = w.encode()
                if not data or len(data) > LONG_BYTES or BETWEEN in w:
                    far.append((i, merge_long(data, ranks)))
                else:
                    numbers, listed = packets[xxhash.xxh64_intdigest(data, 42) % buckets]
                    numbers.append(i)
                    listed.append(w)
            last = lambda values, kind: pa.ListArray.from_arrays(pa.array([0] * len(ids) + [len(values)], pa.int32()), pa.array(values, kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(cells, pa.binary()),
                 last([(b, n, BETWEEN.join(w)) for b, (n, w) in packets.items()], packet), last(far, merged)],
                names=["slice", "doc_id", "numbers", "packets", "far"])

        pending = None  # the newest documents, whose last row will get the slice's words if it ends there
        for batch in batches:
            for part in slices(batch):
                if pending is not None:
                    if held >= SLICE_CHARS:
                        yield rows(*pending, list(islice(seen, len(common), None)))
                        seen, name, held = empty(), uuid.uuid4().int >> 65, 0
                    else:
                        yield rows(*pending, [])
                cells = []
                for text in part.column("text"):
                    text = text.as_py() or ""
                    words = find(text)
                    held += len(text)
                    cells.append(packed(np.fromiter(map(seen.__getitem__, words), np.int64, len(words))))
                pending = part.column("doc_id").to_pylist(), cells
        if pending is not None:
            yield rows(*pending, list(islice(seen, len(common), None)))

    # a slice's rows come from one task: they lie in one file, and nothing is shuffled
    return materialize_by(texts(docs).mapInArrow(number, SPLIT), "bpe-words", ["slice"], gather=False)[0]


def word_ids(parts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(of, numbers, sizes, ids) packets for the slices: the numbers of words to be folded, how many ids each has, and
    the ids.  All slices' packets of a bucket meet in one shuffle; a word is folded once there for all its mentions."""
    shuffled = parts.select("slice", F.explode("packets").alias("p")).select("slice", "p.*") \
        .repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    mentions = shuffled.select("slice", "bucket", F.explode(F.arrays_zip("numbers", F.split("words", BETWEEN, -1).alias("words"))).alias("m"))
    words = mentions.groupBy("bucket", F.col("m.words").alias("word")).agg(F.collect_list(F.struct("slice", F.col("m.numbers").alias("number"))).alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []

        def rows() -> pa.RecordBatch:
            values, sizes, mentioned, of, numbers = (np.concatenate(x) for x in zip(*held))
            starts, word = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), mentioned)
            order = np.lexsort((numbers, of))
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            cells = [[int(of[at[0]]), packed(np.diff(numbers[at], prepend=0)), packed(sizes[word[at]]), packed(gather(values, starts, sizes, word[at]))]
                     for at in np.split(order, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), [pa.int64()] + [pa.binary()] * 3)], names=["of", "numbers", "sizes", "ids"])

        for batch in batches:
            ids, places = batch.column("ids"), batch.column("places")
            if not batch.num_rows:
                continue
            place = places.flatten()
            held.append((ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64), places.value_lengths().to_numpy(),
                         place.field("slice").to_numpy(), place.field("number").to_numpy().astype(np.int64)))
            if sum(len(x[3]) for x in held) >= PACKED_MENTIONS:
                yield rows()
                held = []
        if held:
            yield rows()

    words = words.withColumn("ranks", rank_table(parts.sparkSession, ranks))
    return words.select(fold(F.col("word"), F.col("ranks")).alias("ids"), "places").mapInArrow(pack, "of long, numbers binary, sizes binary, ids binary")


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that ``chosen`` names, one after the other."""
    n = sizes[chosen]
    ends = np.cumsum(n)
    return values[np.repeat(starts[chosen] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def assemble(parts: DataFrame, found: DataFrame, ranks: dict[bytes, int], common: Common) -> DataFrame:
    """``CODED`` rows: the ids of every document's words, and the pieces that these ids stand for."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    sent = parts.sparkSession.sparkContext.broadcast((pieces, common))

    def join(docs: pa.Table, words: pa.Table) -> pa.Table:
        of, common = sent.value
        far = [x for row in docs.column("far").to_pylist() for x in row]
        lists = {c: [unpacked(x).astype(np.int64) for x in words.column(c).to_pylist()] for c in ("numbers", "sizes", "ids")}
        order = np.argsort(np.concatenate([np.array([x["number"] for x in far], np.int64), *map(np.cumsum, lists["numbers"])]))
        sizes = np.concatenate([np.diff(common.starts), np.array([len(x["ids"]) for x in far], np.int64), *lists["sizes"]])
        values = np.concatenate([common.ids, np.array([i for x in far for i in x["ids"]], np.int32), *[x.astype(np.int32) for x in lists["ids"]]])
        starts = np.cumsum(sizes) - sizes
        n = len(common.words)
        starts, sizes = (np.concatenate([x[:n], x[n:][order]]) for x in (starts, sizes))

        def rows(part: pa.Table) -> pa.RecordBatch:
            coded = [gather(values, starts, sizes, unpacked(cell)) for cell in part.column("numbers").to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in coded])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*coded, np.zeros(0, np.int32)]), pa.int32()))
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), lists, pa.array([x.astype("<u4").tobytes() for x in coded], pa.binary()),
                 pa.array([b"".join(map(of.__getitem__, x.tolist())) for x in coded], pa.binary())], names=["doc_id", "ids", "id_bytes", "decoded"])

        # small batches: working arrays and what the JVM takes at once stay small
        return pa.Table.from_batches([rows(pa.Table.from_batches([part])) for batch in docs.to_batches() for part in slices(batch, "numbers", PART_BYTES)])

    # a slice of empty texts has no words, but rows on the left
    return parts.select("slice", "doc_id", "numbers", "far").groupBy("slice").cogroup(found.groupBy("of")).applyInArrow(join, CODED)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids, id_bytes, decoded): the ids of every whole text, the same as little-endian unsigned
    32-bit integers, and the bytes decoded from them."""
    common = learn_common(docs, ranks, pattern)
    parts = split(docs, ranks, pattern, common.words)
    return assemble(parts, word_ids(parts, ranks), ranks, common)
