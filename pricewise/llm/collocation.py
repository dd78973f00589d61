"""Phrase collocations per language, counted on a weighted de Bruijn graph.

Nodes are three-word sequences, edges the four-word sequences between overlapping nodes, weighted
by their occurrences.  Every word position of the corpus gives one row: its longest gram, which is
an edge of four words, or fewer at the end of a piece (a correction).  The count of a shorter phrase
is the flow out of its node (all longer grams that begin with it) plus the corrections that end
there; nothing is counted twice and no shorter gram is shuffled from the texts.  Frequent
edges are compacted into unary paths before the node flows are taken from them.

A first pass hashes grams of all lengths into ``2 ** bits`` counters, in ranges spread over the
tasks.  A gram under ``min_count`` in its counter is neither a candidate nor a part of one, so a position's
gram also ends there, like at the end of a piece: counts of phrases that matter stay exact whatever the
counters share.  Only one bit a counter is sent to the tasks (16 MB at 27 bits, at any corpus size).

Cases: a null text has no words; a null lang is ``und`` (with documents that say ``und``); words are
separated by blanks and tabs only, pieces by ``. , ; : ! ?`` and line ends; repeated documents count each time; a very long text
is read in overlapping chunks; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import ship, slices, text_bytes, texts
from pricewise.session import materialize

WORDS = 4                 # words of an edge, and of the longest phrase
BITS = 27                 # counters of the gram filter: 2 ** BITS bits are broadcast
RANGE_BITS = 16           # counters of one range
CHUNK = 1 << 20           # bytes of text per vectorised step
HELD = 600_000            # distinct grams a task holds before it sends them on
PATH_EDGES = 4096         # edges per row of a path; longer paths take several rows

BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_AHEAD = re.compile(rb"(?:[ \t.,;:!?\n\x0b\x0c\r]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,3}")
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a chunk: places, and whether the next word is in the same piece."""

    def __init__(self, buf: bytes, limit: int):
        self.buf, a = buf, np.frombuffer(buf, np.uint8)
        kind = _KIND[a]
        edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])
        self.joined = breaks[self.starts[1:]] == breaks[self.ends[:-1]]
        #: Words from ``limit`` on belong to the next chunk and are only looked at.
        self.own = int(np.searchsorted(self.starts, limit))
        self.plain = (self.starts[1:] - self.ends[:-1] == 1) & (a[self.ends[:-1]] == 32)

    def hashes(self, lang: str, bits: int) -> list[np.ndarray]:
        """Counters of the grams of 1, 2, ... words from every word on, whether or not they are in one piece."""
        power, inverse = _powers(len(self.buf) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(self.buf, np.uint8).astype(np.uint64) + np.uint64(1)) * power[: len(self.buf)])])
        seed = np.uint64(int.from_bytes(lang.encode()[:64], "little") * _BASE % (1 << 64))
        one = _mix(((sums[self.ends] - sums[self.starts]) * inverse[self.starts]) ^ seed)
        grams = [one]
        for k in range(1, WORDS):
            grams.append(_mix(grams[-1][:-1] * np.uint64(3) + one[k:] + np.uint64(k)))
        return [(g >> np.uint64(64 - bits)).astype(np.uint32) for g in grams]

    def runs(self) -> list[np.ndarray]:
        """Whether the gram of 1, 2, ... words from every word on is in one piece."""
        out = [np.ones(len(self.starts), bool)]
        for k in range(1, WORDS):
            out.append(out[-1][:-1] & self.joined[k - 1:])
        return out


def _chunks(batches) -> Iterator[tuple[str, Words]]:
    """Chunks of the texts of one language each."""
    for whole in batches:
        for batch in slices(whole):
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                if text:
                    by_lang[lang].append(text)
            for lang, parts in by_lang.items():
                buf = b"\n".join(parts).translate(LOWER)
                start = 0
                while len(buf) - start > CHUNK:
                    gap = _GAP.search(buf, start + CHUNK)
                    if gap is None:
                        break
                    cut = gap.start()
                    yield lang, Words(buf[start:_AHEAD.match(buf, cut).end()], cut - start)
                    start = cut
                yield lang, Words(buf[start:], len(buf) - start)


def _counter_blobs(bits: int, range_bits: int, least: int):
    """Counts of hashed grams, packed per range of counters; ``least`` is as good as more."""
    def run(batches):
        seen, held, totals = [], 0, Counter()

        def packed():
            at, n = np.unique(np.concatenate(seen), return_counts=True)
            n = np.minimum(n, least).astype(np.uint8)
            cuts = np.flatnonzero(np.diff(at >> range_bits)) + 1
            ranges, places, counts = [], [], []
            for i, c in zip(np.split(at, cuts), np.split(n, cuts)):
                ranges.append(int(i[0] >> range_bits))
                places.append((i & ((1 << range_bits) - 1)).astype("<u2").tobytes())
                counts.append(c.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary()),
                                               pa.nulls(len(ranges), pa.string()), pa.nulls(len(ranges), pa.int64())], names=["range", "places", "counts", "lang", "n"])

        for lang, w in _chunks(batches):
            totals[lang] += w.own
            for gram, inside in zip(w.hashes(lang, bits), w.runs()):
                seen.append(gram[: w.own][inside[: w.own]])
                held += len(seen[-1])
            if held > 3_000_000:
                yield packed()
                seen, held = [], 0
        if held:
            yield packed()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(totals), pa.int32()), pa.nulls(len(totals), pa.binary()), pa.nulls(len(totals), pa.binary()),
                                              pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["range", "places", "counts", "lang", "n"])
    return run


def _sum_ranges(range_bits: int, least: int):
    """One packed bit a counter: whether it reached ``least``.  A task holds its ranges only, a byte a counter."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held = sums.setdefault(r, np.zeros(1 << range_bits, np.uint8))
                at = np.frombuffer(places, "<u2")
                held[at] = np.minimum(held[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), least)
        for r, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(held >= least).tobytes()], pa.binary())], names=["range", "bits"])
    return run


def _grams(may_be: list, bits: int, range_bits: int):
    """The longest gram of every position, added up within the task."""
    def run(batches):
        flags = np.zeros(1 << (bits - 3), np.uint8)
        for r, packed in may_be:
            at = r << (range_bits - 3)
            flags[at:at + len(packed)] = np.frombuffer(packed, np.uint8)

        def frequent(at):
            return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

        found: dict[tuple[str, int], Counter] = defaultdict(Counter)

        def rows():
            while found:
                (lang, size), c = found.popitem()
                entries = iter(c.items())
                while part := list(islice(entries, 50_000)):
                    gram, n = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(part), np.int8))), pa.array(np.full(len(part), size, np.int32)),
                                                      pa.array(gram, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "gram", "n"])

        for lang, w in _chunks(batches):
            size = np.zeros(len(w.starts), np.int64)
            longer = None
            for k, (gram, inside) in enumerate(zip(w.hashes(lang, bits), w.runs())):
                ok = frequent(gram) & inside
                if k:       # both parts of one word less are frequent too
                    ok &= longer[:-1] & longer[1:]
                longer = ok
                size[: len(ok)] += ok
            size = size[: w.own]
            odd = np.concatenate([np.cumsum(np.concatenate([[0], ~w.plain])), [0]])
            for k in range(1, WORDS + 1):
                at = np.flatnonzero(size == k)
                last = at + k - 1
                grams = [w.buf[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[last].tolist())]
                for i in np.flatnonzero(odd[last] != odd[at]):
                    grams[i] = b" ".join(re.split(rb"[ \t]+", grams[i]))
                found[lang, k].update(grams)
            if sum(map(len, found.values())) > HELD:
                yield from rows()
        yield from rows()
    return run


def longest_grams(docs: DataFrame, min_count: int, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, size, gram, n): how often each gram is the longest one of its position, edges having
    ``WORDS`` words; (lang, n): all words of each language)."""
    one = texts(docs, "lang").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    ship(docs.sparkSession)
    spark = docs.sparkSession
    if min_count > 255:
        raise ValueError("counters of the gram filter hold a byte")
    range_bits = min(RANGE_BITS, bits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = materialize(one.mapInArrow(_counter_blobs(bits, range_bits, min_count), "range int, places binary, counts binary, lang string, n long"), "gram-counters")
    totals = blobs.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    summed = blobs.filter("range is not null").select("range", "places", "counts").repartition(parts, "range").mapInArrow(_sum_ranges(range_bits, min_count), "range int, bits binary")
    # 2 ** bits bits in all, whatever the corpus
    may_be = spark.sparkContext.broadcast([(r["range"], bytes(r["bits"])) for r in summed.collect()])
    found = one.mapInArrow(lambda batches: _grams(may_be.value, bits, range_bits)(batches), "lang string, size int, gram string, n long")
    return materialize(found.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams"), totals


def _head(gram: str, k: int) -> F.Column:
    return F.substring_index(gram, " ", k)


def _tail(gram: str, k: int) -> F.Column:
    return F.substring_index(gram, " ", -k)


def compact(edges: DataFrame) -> DataFrame:
    """Unary paths of the graph: (lang, path, part, words, weights), ``words`` holding the words of the
    path's edges in order (the first three belong to its first node), ``weights`` each edge's.

    An edge continues the path of the edge before it if the node between them has no other edge.
    Places are found by pointer doubling.  Edges on a cycle of such nodes have no first edge; each is
    a path of its own.  A path of more than ``PATH_EDGES`` edges takes several parts."""
    e = edges.select("lang", "gram", "n", _head("gram", WORDS - 1).alias("src"), _tail("gram", WORDS - 1).alias("dst"))
    inward = e.groupBy("lang", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("gram").alias("before"))
    outward = e.groupBy("lang", F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    unary = inward.join(outward, ["lang", "node"]).filter("n_in = 1 and n_out = 1").select("lang", F.col("node").alias("src"), "before")
    state = e.join(unary, ["lang", "src"], "left").select("lang", "gram", "n", F.coalesce("before", "gram").alias("head"),
                                                         F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("before").isNull().alias("ended"))
    state, before = materialize(state, "paths"), None
    while (left := state.filter("not ended").count()) and left != before:
        before = left
        to = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"), F.col("ended").alias("over"))
        stepped = state.filter("not ended").join(to, ["lang", "head"]).select("lang", "gram", "n", F.col("next").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("over").alias("ended"))
        state = materialize(state.filter("ended").unionByName(stepped), "paths")
    state = state.select("lang", "gram", "n", F.when(F.col("ended"), F.col("head")).otherwise(F.col("gram")).alias("path"),
                         F.when(F.col("ended"), F.col("place")).otherwise(F.lit(0)).alias("place"))
    rows = state.groupBy("lang", "path", F.floor(F.col("place") / PATH_EDGES).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "gram", "n"))).alias("e"))
    last = F.transform("e", lambda x: F.substring_index(x.gram, " ", -1))
    first = F.split(F.substring_index(F.col("e")[0].gram, " ", WORDS - 1), " ")
    return rows.select("lang", "path", "part", F.concat(first, last).alias("words"),
                       F.transform("e", lambda x: x.n).alias("weights"))


def flows(grams: DataFrame, min_count: int) -> dict[int, DataFrame]:
    """(lang, phrase, f) per number of words, of the phrases that reach ``min_count``."""
    heavy = (F.col("size") == WORDS) & (F.col("n") >= min_count)
    edges = grams.filter(heavy).select("lang", "gram", "n")
    paths = materialize(compact(edges), "unary-paths")
    along = paths.select("lang", F.explode(F.zip_with(F.sequence(F.lit(1), F.size("weights")), "weights", lambda i, n: F.struct(i.alias("i"), n.alias("n")))).alias("x"), "words")
    out = {WORDS: along.select("lang", F.array_join(F.slice("words", F.col("x.i"), F.lit(WORDS)), " ").alias("phrase"), F.col("x.n").alias("f"))}
    flow = along.select("lang", F.array_join(F.slice("words", F.col("x.i"), F.lit(WORDS - 1)), " ").alias("phrase"), F.col("x.n").alias("f"))
    flow = flow.unionByName(grams.filter((F.col("size") == WORDS) & ~heavy).select("lang", _head("gram", WORDS - 1).alias("phrase"), F.col("n").alias("f")))
    for k in range(WORDS - 1, 0, -1):
        # what flows out of the node, and the grams that end in it
        ends = grams.filter(F.col("size") == k).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))
        counted = materialize(flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), f"flow-{k}")
        out[k] = counted.filter(F.col("f") >= min_count)
        flow = counted.select("lang", _head("phrase", k - 1).alias("phrase"), "f")
    return out


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, inside_percent: int = 80, bits: int = BITS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words by the lowest-scoring cut: (lang, rank, phrase,
    a, l, r, n, score).  A phrase whose words stand in a phrase one word longer with ``inside_percent`` of its
    count or more goes; a still longer one implies one of these, as counts only fall with length."""
    grams, totals = longest_grams(docs, min_count, bits)
    f = flows(grams, min_count)
    longer = None
    for k in range(3, WORDS + 1):
        both = f[k].select("lang", "f", F.explode(F.array(_head("phrase", k - 1), _tail("phrase", k - 1))).alias("phrase"))
        longer = both if longer is None else longer.unionByName(both)
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    found = f[2].unionByName(f[3]).unionByName(f[4]).withColumnRenamed("f", "a").join(longer, ["lang", "phrase"], "left")
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of counts may pass 64 bits
    found = found.filter(F.col("most").isNull() | (whole(F.lit(100)) * whole(F.col("most")) < whole(F.lit(inside_percent)) * whole(F.col("a"))))
    words = F.size(F.split("phrase", " "))
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), words - 1)).alias("k"), words.alias("m"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - m)").alias("right"))
    parts = f[1].unionByName(f[2]).unionByName(f[3])
    scored = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    scored = scored.withColumn("score", F.expr("cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0)) div (l + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
