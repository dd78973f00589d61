"""Ranked lexical search of a set of query items over all documents, by dense blocked products.

A first pass keeps of every document its length and the counts of the items' terms, written once.
The scores of a tile of items against a tile of documents are one float64 matrix product: item
weights over the tile's own terms, times the documents' impacts on them.  Weights and
impacts are whole numbers, and a product never spans more terms than keep every partial sum below
2 ** 53, so it is exact in any order of summation; partial products of further terms are added as 64-bit
integers.  Each task keeps the best of every item, ties included by ``doc_id``, and sends on at most
``k`` rows an item; a last window ranks those.

Items come through the driver in blocks of ``BLOCK_TERMS`` distinct terms, each one pass over
the documents, so what is broadcast does not grow with the number of items.

Cases: a null text has no term and is not counted; a document or item without a known term scores
nothing; rows of one ``item_id`` (null included) are one item holding the terms of all of them; each row of a repeated
``doc_id`` is a document of its own, a null ``doc_id`` sorts last; equal scores go by ``doc_id``; texts are read whole;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import map_rows, ship, text_bytes, texts
from pricewise.session import materialize

BLOCK_TERMS = 65_536      # distinct terms of the items of one block (one item may have more)
BLOCK_ITEMS = 4_096       # items of one block
TILE_ITEMS = 32
TILE_DOCUMENTS = 512
TILE_TERMS = 8_192        # rows of one product
EXACT = 1 << 53
TOP_IMPACT = 1_000_000    # (10**9 * tf) div (1000 * tf + 8 * m) stays below 10**6

#: A-Z become a-z, other letters, digits and bytes of longer characters stay, all else separates terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of every item, in order."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(terms_of(t))) for t in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    one = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = one.schema["item_id"].dataType.simpleString()
    rows = map_rows(one, run, f"item_id {kind}, terms array<binary>")
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def blocks(items: DataFrame, block_terms: int, block_items: int) -> Iterator[list[tuple]]:
    """Runs of items [(item_id, terms)] with few enough distinct terms together."""
    held, seen = [], set()
    for row in item_terms(items).orderBy("item_id").toLocalIterator(prefetchPartitions=False):
        terms = [bytes(t) for t in row["terms"]]
        if held and (len(held) == block_items or len(seen.union(terms)) > block_terms):
            yield held
            held, seen = [], set()
        held.append((row["item_id"], terms))
        seen.update(terms)
    if held:
        yield held


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length, and its counts of the
    terms of ``vocabulary`` (a broadcast dict of term numbers)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        known = vocabulary.value
        keep, lengths, numbers, counts = [], [], [], []
        for i, text in enumerate(text_bytes(batch.column("text"))):
            found = terms_of(text)
            if found:
                tf = Counter(x for x in map(known.get, found) if x is not None)
                keep.append(i)
                lengths.append(len(found))
                numbers.append(list(tf.keys()))
                counts.append(list(tf.values()))
        if not keep:
            return None
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep)), pa.array(lengths, pa.int64()),
                                           pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return map_rows(texts(docs), run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _tile_scores(weights: np.ndarray, here: np.ndarray, number: np.ndarray, column: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
    """Whole-number scores of a tile's items against ``width`` documents.  ``weights`` has a column for
    every term of ``here``; (number, column, impact) are the documents' postings, sorted by term number.
    A product spans so few terms that all its partial sums stay below 2 ** 53."""
    heaviest = max(int(weights.max(initial=0)), 1)
    step = max(1, min(TILE_TERMS, EXACT // (heaviest * TOP_IMPACT) - 1))
    total = np.zeros((len(weights), width), np.int64)
    for at in range(0, len(here), step):
        run = here[at:at + step]
        some = slice(np.searchsorted(number, run[0]), np.searchsorted(number, run[-1], "right"))
        row = np.minimum(np.searchsorted(run, number[some]), len(run) - 1)
        known = run[row] == number[some]
        impacts = np.zeros((len(run), width))
        impacts[row[known], column[some][known]] = impact[some][known]
        total += (weights[:, at:at + step] @ impacts).astype(np.int64)
    return total


class _Best:
    """The best ``k`` documents of every item of a tile: highest score, then lowest doc_id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.absent = np.zeros(0, bool)
        self.least = np.ones(items, np.int64)      # a score of 0 is no hit

    def add(self, scores: np.ndarray, docs: np.ndarray, absent: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, at]])
        doc, gone = np.concatenate([self.doc, docs[at]]), np.concatenate([self.absent, absent[at]])
        order = np.lexsort((doc, gone, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.least[item[place == self.k - 1]] = score[full]
        self.item, self.score, self.doc, self.absent = item[place < self.k], score[keep], doc[keep], gone[keep]


def _score(block, k: int):
    """Rows (item, doc_id, score) of a task's best documents for every item of the block."""
    def run(batches):
        tiles, documents, length = block.value
        best = [_Best(len(w), k) for _, w in tiles]
        for batch in batches:
            ids = batch.column("doc_id")
            absent = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            m = np.array([10 + (90 * n * documents) // length for n in batch.column("n").to_pylist()], dtype=np.int64)
            terms, tfs = batch.column("terms"), batch.column("tfs")
            for at in range(0, batch.num_rows, TILE_DOCUMENTS):
                some = slice(at, at + TILE_DOCUMENTS)
                part = terms[some]
                sizes = np.diff(np.asarray(part.offsets))
                number, tf = np.asarray(part.flatten()), np.asarray(tfs[some].flatten())
                column = np.repeat(np.arange(len(sizes)), sizes)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[some][column])
                order = np.argsort(number, kind="stable")
                number, column, impact = number[order], column[order], impact[order]
                present = np.unique(number)
                for (known, weights), held in zip(tiles, best):
                    here = np.intersect1d(known, present, assume_unique=True)
                    if len(here):
                        scores = _tile_scores(weights[:, np.searchsorted(known, here)], here, number, column, impact, len(sizes))
                        held.add(scores, ids[some], absent[some])
        first = 0
        for (_, weights), held in zip(tiles, best):
            if len(held.item):
                yield pa.RecordBatch.from_arrays([pa.array(held.item + first, pa.int64()), pa.array(held.doc, pa.int64(), mask=held.absent), pa.array(held.score, pa.int64())],
                                                 names=["item", "doc_id", "score"])
            first += len(weights)
    return run


def _tiles(block: list[tuple], number: dict[bytes, int], weight: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of items with the sorted numbers of their own terms and the dense weights over those."""
    out = []
    for at in range(0, len(block), TILE_ITEMS):
        group = [[number[t] for t in terms if number[t] in weight] for _, terms in block[at:at + TILE_ITEMS]]
        known = np.array(sorted(set().union(*group)), np.int32)
        weights = np.zeros((len(group), len(known)))
        for i, numbers in enumerate(group):
            weights[i, np.searchsorted(known, numbers)] = [weight[x] for x in numbers]
        out.append((known, weights))
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Every item's ``k`` highest-scoring documents: (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for block in blocks(items, block_terms, block_items):
        number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        vocabulary = spark.sparkContext.broadcast(number)
        found = materialize(postings(docs, vocabulary), "postings")
        size = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = df.select("term", F.floor(1000 * F.log((F.lit(2.0 * size["documents"] + 2)) / (2 * F.col("df") + 1))).cast("long").alias("w"))
        # one row a term of the block
        weights = {r["term"]: r["w"] for r in weight.collect() if r["w"] > 0}
        if weights:
            tiles = spark.sparkContext.broadcast((_tiles(block, number, weights), size["documents"], size["length"]))
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, item_id {kind}")
            best = materialize(found.mapInArrow(_score(tiles, k), "item long, doc_id long, score long"), "best")
            w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            kept = best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
            out = out.unionByName(materialize(kept.join(names, "item").select("item_id", "doc_id", "score"), "block-best"))
            tiles.unpersist()
        vocabulary.unpersist()
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.select("item_id", F.row_number().over(w).alias("rank"), "doc_id", "score")
