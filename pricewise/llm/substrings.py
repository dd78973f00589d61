"""Removal of repeated substrings: every byte covered by a ``LENGTH``-byte string that also starts
earlier (by doc_id, then position) goes.

Sorting every suffix of a corpus would move each byte ``LENGTH`` times, so suffixes are sparse
first.  Each ``LENGTH``-byte string has an anchor, its ``KMER``-byte piece of smallest hash
(leftmost of equals), so equal strings have equal anchors at equal places, and a run of strings shares
one.  Runs are shuffled by anchor.  A run whose context (all bytes of its strings) is equal to
an earlier one's is a copy as a whole; runs with another context at the same anchor, and an equal
neighbourhood on one side, may share some strings: only their contexts are fetched, and all
their strings are ordered by deep-shallow suffix sorting; of equal strings all but the first go.

Equal contexts meet in every task before the shuffle, where all but the first are settled at once, so
a group of copies sends one run per task.  Documents whose text is needed again are picked by a filter of
fixed size (false positives cost time only) before they are joined.

Cases: a null text is empty, a text shorter than ``LENGTH`` keeps all its bytes.  Rows that share a
doc_id are ordered by the checksum of their text, equal rows are one document and get equal
results; a null doc_id comes first.  Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import ship, slices, text_bytes, texts
from pricewise.llm.suffixes import sort_strings
from pricewise.session import materialize

LENGTH = 100
KMER = 32
#: Bits of the document filter (its words come to the driver: 2 MB).
FILTER_BITS = 24
#: Bytes of text whose anchors are found at once, and strings that one sort holds.
SLICE = 1_000_000
SORTED = 400_000

#: One run of strings with a common anchor: hashes of anchor and context, hashes of the bytes on either
#: side, the document, the anchor's place, strings that start before it, strings after the first.
RUN = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("left", "<u4"), ("right", "<u4"), ("known", "u1"), ("doc_id", "<i8"), ("crc", "<u4"),
                ("at", "<u4"), ("before", "<u2"), ("more", "<u2")])
_MIX = np.uint64(0x9E3779B97F4A7C15)
SPAN = "known boolean, doc_id long, crc long, a long, b long"
KEY = ["known", "doc_id", "crc"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of the ``size`` bytes from every offset, by doubling."""
    have, out, done = _mixed(data.astype(np.uint64) + np.uint64(1)), None, 0
    base, span = int(_MIX) | 1, 1
    while span <= size:
        if size & span:
            if out is None:
                out, done = have, span
            else:  # pieces in the order of low bits first
                n = len(data) - done - span + 1
                out = out[:n] * np.uint64(pow(base, span, 1 << 64)) + have[done:done + n]
                done += span
        n = len(data) - 2 * span + 1
        if n > 0:
            have = have[:n] * np.uint64(pow(base, span, 1 << 64)) + have[span:span + n]
        span *= 2
    return _mixed(out)


def anchors(data: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k-mer at every offset, for every string its anchor's offset)."""
    h = rolling(data, kmer)
    width = length - kmer + 1
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return h, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(data: list[bytes], ids: list, length: int = LENGTH, kmer: int = KMER) -> np.ndarray:
    """All runs of some documents."""
    joined = b"".join(data)
    if len(joined) < length:
        return np.zeros(0, RUN)
    buf = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in data], np.int64)
    begins = np.cumsum(sizes) - sizes
    h, at = anchors(buf, length, kmer)
    doc = np.repeat(np.arange(len(data)), sizes)
    inside = doc[:len(at)] == doc[length - 1:length - 1 + len(at)]
    change = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:len(at)] != doc[:len(at) - 1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(at)] - 1
    first, last = first[inside[first]], last[inside[first]]
    out = np.zeros(len(first), RUN)
    a, d = at[first], doc[first]
    out["anchor"] = h[a]
    digest = xxhash.xxh3_64_intdigest
    out["context"] = np.fromiter((digest(joined[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first))
    # Of the bytes beside the anchor, any string holds a half of the rest on one side at least.
    half = (length - kmer + 1) // 2
    side = rolling(buf, half) if 0 < half <= len(buf) else np.zeros(0, np.uint64)
    low, high = begins[d], begins[d] + sizes[d]
    has_left, has_right = (a - half >= low) & (half > 0), (a + kmer + half <= high) & (half > 0)
    take = lambda i, ok: np.where(ok, side[np.clip(i, 0, len(side) - 1)] >> np.uint64(33) | np.uint64(1 << 31), 0) if len(side) else 0
    out["left"], out["right"] = take(a - half, has_left), take(a + kmer, has_right)
    out["known"], out["doc_id"] = np.array([x is not None for x in ids])[d], np.array([x or 0 for x in ids], np.int64)[d]
    out["crc"] = np.array([zlib.crc32(t) for t in data], np.uint32)[d]
    out["at"], out["before"], out["more"] = a - low, a - first, last - first
    return out


def _ordered(runs: np.ndarray, *keys: str) -> np.ndarray:
    """Sorted by ``keys``, then by document order and place."""
    return runs[np.lexsort([runs[k] for k in ("at", "crc", "doc_id", "known", *reversed(keys))])]


def _same(runs: np.ndarray, *keys: str) -> np.ndarray:
    """Whether a row has the ``keys`` of the one before it."""
    same = np.ones(len(runs), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= runs[k][1:] == runs[k][:-1]
    return same


def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first runs of every context, later runs): equal rows of one document count once."""
    runs = _ordered(runs, "anchor", "context")
    runs = runs[~_same(runs, "anchor", "context", "known", "doc_id", "crc", "at")]
    later = _same(runs, "anchor", "context")
    return runs[~later], runs[later]


def undecided(firsts: np.ndarray) -> np.ndarray:
    """Runs of which another context has the anchor and the bytes on one side."""
    need = np.zeros(len(firsts), bool)
    for side in ("left", "right"):
        order = np.lexsort((firsts[side], firsts["anchor"]))
        s = firsts[order]
        same = _same(s, "anchor", side) & (s[side] != 0)
        need[order] |= same | np.r_[same[1:], False]
    return firsts[need]


def _spans(known, doc_id, crc, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(known.astype(bool)), pa.array(doc_id.astype(np.int64)), pa.array(crc.astype(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))],
                                      names=["known", "doc_id", "crc", "a", "b"])


def _run_spans(runs: np.ndarray, length: int) -> pa.RecordBatch:
    """The bytes of whole runs, adjoining ones of a document joined."""
    r = runs[np.lexsort([runs[k] for k in ("at", "crc", "doc_id", "known")])]
    a = r["at"].astype(np.int64) - r["before"]
    b = a + r["more"] + length
    new = ~_same(r, "known", "doc_id", "crc")
    new[1:] |= a[1:] > b[:-1]
    head = np.flatnonzero(new)
    return _spans(r["known"][head], r["doc_id"][head], r["crc"][head], a[head], np.maximum.reduceat(b, head) if len(head) else b)


def _document_filter(keys: DataFrame, bits: int = FILTER_BITS):
    """Bitmap of the keys of ``keys``, of fixed size; ORed in Spark by words."""
    slot = F.xxhash64(*KEY).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(KEY)}) & 63 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():
        table[r["word"]] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little"))


def _marked(docs: DataFrame, sent, bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``maybe``: false only if the document is not in the filter."""
    @F.pandas_udf("boolean")
    def maybe(slot):
        return slot.map(lambda x: bool(sent.value[x]))

    return docs.withColumn("maybe", maybe(F.xxhash64(*KEY).bitwiseAND(F.lit((1 << bits) - 1))))


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                              F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), "text")


def removed_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """(known, doc_id, crc, a, b): byte spans that go, perhaps overlapping."""
    spark = docs.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * tasks

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                firsts, later = settle(runs_of(text_bytes(part.column("text")), part.column("doc_id").to_pylist(), length, kmer))
                bucket = (firsts["anchor"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                firsts, bucket = firsts[order], bucket[order]
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
                rows = [_packed(firsts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])] or [_packed(firsts)]
                settled = _run_spans(later, length)
                buckets_of = [int(bucket[a]) for a in cuts[:-1]] or [0]
                # what is settled here goes along with the first bucket
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets_of, pa.int32()), pa.array(rows, pa.binary()), pa.array([_ipc(settled)] + [None] * (len(rows) - 1), pa.binary())],
                    names=["bucket", "runs", "spans"])

    def meet(batches: Iterator[pa.RecordBatch]):
        held = []
        for batch in batches:
            held += [_unpacked(x) for x in batch.column("runs").to_pylist()]
            for x in batch.column("spans").to_pylist():
                if x is not None:
                    yield _wide(_of_ipc(x), np.zeros(0, RUN))
        if held:
            runs = np.concatenate(held)
            held.clear()
            firsts, later = settle(runs)
            yield _wide(_run_spans(later, length), np.zeros(0, RUN))
            yield _wide(_run_spans(later[:0], length), undecided(firsts))

    emitted = texts(docs).mapInArrow(emit, "bucket int, runs binary, spans binary")
    met = materialize(emitted.repartition(tasks, "bucket").select("runs", "spans")
                      .mapInArrow(meet, f"{SPAN}, at long, before int, more int, anchor long"), "settled")
    spans = met.filter("at IS NULL").select(*KEY, "a", "b")
    open_ = met.filter("at IS NOT NULL").groupBy(*KEY).agg(F.collect_set(F.struct("at", "before", "more", "anchor")).alias("runs"))
    open_ = materialize(open_, "undecided")

    def contexts(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for known, doc_id, crc, text, runs in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "runs"))):
                data = (text or "").encode()
                for r in runs:
                    a = r["at"] - r["before"]
                    out.append((r["anchor"], known, doc_id, crc, a, data[a:a + r["more"] + length]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if out else
                                             [pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())],
                                             names=["anchor", *KEY, "a", "data"])

    def order(batches: Iterator[pa.RecordBatch]):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _first_of_equal(pa.Table.from_batches(held), length)

    keyed = _marked(_keyed(docs), _document_filter(open_)).filter("maybe").drop("maybe").dropDuplicates(KEY)
    fetched = keyed.join(open_, KEY).mapInArrow(contexts, f"anchor long, known boolean, doc_id long, crc long, a long, data binary")
    partial = fetched.repartition(tasks, "anchor").mapInArrow(order, SPAN)
    return spans.unionByName(partial)


def _packed(runs: np.ndarray) -> bytes:
    """Columns one after the other: they compress better than rows."""
    return len(runs).to_bytes(4, "little") + b"".join(runs[k].tobytes() for k in RUN.names)


def _unpacked(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 4
    out = np.empty(n, RUN)
    for k in RUN.names:
        size = n * RUN[k].itemsize
        out[k] = np.frombuffer(data[at:at + size], RUN[k])
        at += size
    return out


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _of_ipc(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as found:
        return next(iter(found))


def _wide(spans: pa.RecordBatch, runs: np.ndarray) -> pa.RecordBatch:
    """Spans and undecided runs as rows of one schema."""
    n, m = spans.num_rows, len(runs)
    blank = _spans(runs["known"], runs["doc_id"], runs["crc"], np.zeros(m), np.zeros(m))
    cols = [pa.concat_arrays([spans.column(k), blank.column(k)]) for k in range(5)]
    more = [pa.concat_arrays([pa.nulls(n, t), pa.array(v.astype(np.int64), pa.int64()).cast(t) if t != pa.int64() else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64))])
            for v, t in ((runs["at"], pa.int64()), (runs["before"], pa.int32()), (runs["more"], pa.int32()), (np.ascontiguousarray(runs["anchor"]), pa.int64()))]
    return pa.RecordBatch.from_arrays(cols + more, names=["known", "doc_id", "crc", "a", "b", "at", "before", "more", "anchor"])


def _first_of_equal(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the strings that equal an earlier one, sorted anchor by anchor in blocks."""
    import pyarrow.compute as pc
    table = table.take(pc.sort_indices(table, [("anchor", "ascending")])).combine_chunks()
    anchor = table.column("anchor").to_numpy()
    strings = pc.binary_length(table.column("data")).to_numpy().astype(np.int64) - length + 1
    heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    ends, upto = np.r_[heads[1:], len(anchor)], np.cumsum(strings)
    begin = 0
    for k, end in enumerate(ends.tolist()):
        following = ends[k + 1] if k + 1 < len(ends) else None
        if following is None or upto[following - 1] - (upto[begin - 1] if begin else 0) > SORTED:
            yield _block(table.slice(begin, end - begin), strings[begin:end], length)
            begin = end


def _block(table: pa.Table, strings: np.ndarray, length: int) -> pa.RecordBatch:
    data = table.column("data").to_pylist()
    sizes = np.array([len(x) for x in data], np.int64)
    flat = b"".join(data) + bytes(8)
    row = np.repeat(np.arange(len(data)), strings)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    starts = (np.cumsum(sizes) - sizes)[row] + inside
    order, group = sort_strings(flat, starts, length)
    known, doc_id, crc = (table.column(c).to_numpy(zero_copy_only=False) for c in KEY)
    place = table.column("a").to_numpy()[row] + inside
    r, p = row[order], place[order]
    by = np.lexsort((p, crc[r], doc_id[r], known[r], group))
    r, p, g = r[by], p[by], group[by]
    head = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
    later = (p != p[head]) | (doc_id[r] != doc_id[r[head]]) | (crc[r] != crc[r[head]]) | (known[r] != known[r[head]])
    r, p = r[later], p[later]
    # consecutive strings of one context are one span
    by = np.lexsort((p, r))
    r, p = r[by], p[by]
    new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)][:len(r)]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(r)][:len(head)] - 1
    return _spans(known[r[head]], doc_id[r[head]], crc[r[head]], p[head], p[last] + length)


def dedup(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the bytes ``kept``."""
    spans = materialize(removed_spans(docs, length, kmer).groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for known, doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("known", "doc_id", "text", "spans"))):
                data, runs = (text or "").encode(), union([(s["a"], s["b"]) for s in found or []])
                out, upto = [], 0
                for a, b in runs:
                    out.append(data[upto:a])
                    upto = b
                kept = b"".join([*out, data[upto:]])
                rows.append((doc_id if known else None, len(data), len(data) - len(kept), len(runs), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    marked = _marked(_keyed(docs), _document_filter(spans))
    whole = marked.filter("NOT maybe").select(*KEY, "text", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans"))
    joined = marked.filter("maybe").drop("maybe").join(spans, KEY, "left")
    return whole.unionByName(joined.select(*KEY, "text", "spans")).mapInArrow(cut, schema)


def union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


