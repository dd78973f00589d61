"""Language ID by hyperdimensional profiles.

Every letter has a random +-1 vector; an n-gram's vector is the product (binding) of its
letters' vectors, each permuted by its place; a text's vector is the sum (bundle) of its
n-gram vectors.  Prototypes are the bundles of all training documents of a language, a
document goes to the prototype of the highest cosine.

Every letter of every script has a vector of its own, drawn from its code point.  The sum over
a text is taken by n-gram: counts times the vectors of the n-grams that occur, which is the
same bundle.  Sums are of integers, so prototypes do not depend on the order of rows.

Cases: a null text, an empty one or one without a letter is ``und`` with score 0, as is any text
when nothing was learned; a null lang teaches nothing; a null doc_id counts as a training row
(remainder of the empty string); repeated rows each count; ties go to the first language by
name.  lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import map_rows, ship, slices, texts

DIMENSIONS = 512
ORDER = 3
SEED = 7
#: Bits of a symbol in an n-gram's code: 0 is a break, a letter is its lower-case code point.
BITS = 18
#: Code points of one text that are turned into n-grams at once.
BLOCK = 1_000_000
#: N-grams of a language that are held before they are bundled.
HELD = 1 << 20

_SYMBOLS: list[np.ndarray] = []
_LETTERS: dict[tuple[int, int], dict[int, np.ndarray]] = {}


def symbols() -> np.ndarray:
    """Symbol of every code point of the first planes that have letters; others are breaks."""
    if not _SYMBOLS:
        table = np.zeros(0x110000, np.int64)
        for cp in range(1 << BITS):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _SYMBOLS.append(table)
    return _SYMBOLS[0]


def letter(symbol: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The random +-1 vector of one symbol, which depends on its code point and the seed only."""
    known = _LETTERS.setdefault((dimensions, seed), {})
    if symbol not in known:
        known[symbol] = (np.random.default_rng([seed, symbol]).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)
    return known[symbol]


def vectors(grams: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Vectors of n-grams, one row each: permuted letter vectors, bound."""
    bound = np.ones((len(grams), dimensions), np.int8)
    for place in range(ORDER):
        used, at = np.unique((grams >> (BITS * (ORDER - 1 - place))) & ((1 << BITS) - 1), return_inverse=True)
        own = np.stack([letter(x, dimensions, seed) for x in used.tolist()])
        bound *= np.roll(own, ORDER - 1 - place, axis=1)[at]
    return bound


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts with the sums of their counts."""
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return grams, counts


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(n-grams, counts, whether there is a letter); a run of other characters is one break."""
    letters, tail, parts = False, np.zeros(1, np.int64), []
    for i in range(0, max(1, len(text)), BLOCK):
        s = symbols()[np.frombuffer(text[i:i + BLOCK].encode("utf-32-le", "replace"), np.uint32)]
        letters |= bool(s.any())
        s = np.concatenate([tail, s, np.zeros(int(i + BLOCK >= len(text)), np.int64)])
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
        tail = s[-(ORDER - 1):]
        parts.append(np.unique((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:], return_counts=True))
    return *(parts[0] if len(parts) == 1 else _merged(parts)), letters


def bundle_of(grams: np.ndarray, counts: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Sum of the n-grams' vectors, exact for counts below 2 ** 53."""
    out = np.zeros(dimensions)
    for i in range(0, len(grams), 4096):
        out += counts[i:i + 4096].astype(np.float64) @ vectors(grams[i:i + 4096], dimensions, seed).astype(np.float64)
    return out


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, list[int]]:
    """Language -> bundle of all its training documents: bundled per batch, summed in Spark.
    One vector per language comes to the driver."""
    ship(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(dimensions))
            parts: dict[str, list] = defaultdict(list)
            held: dict[str, int] = defaultdict(int)

            def flush(lang: str) -> None:
                sums[lang] += bundle_of(*_merged(parts.pop(lang)), dimensions, seed)
                held[lang] = 0

            for part in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    grams, counts, _ = ngram_counts(text)
                    parts[lang].append((grams, counts))
                    held[lang] += len(grams)
                    if held[lang] > HELD:
                        flush(lang)
            for lang in list(parts):
                flush(lang)
            langs = sorted(sums)
            rows = [[int(x) for x in sums[g]] for g in langs]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["lang", "bundle"])

    train = texts(docs, "lang").filter("lang IS NOT NULL AND text IS NOT NULL") \
        .filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)
    sums = train.mapInArrow(bundle, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("d", "x")) \
        .groupBy("lang", "d").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", "v.x").collect()
    return {r["lang"]: r["x"] for r in rows}


def identify(docs: DataFrame, learned: dict[str, list[int]] | None = None, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and score (cosine, at least 0)."""
    learned = prototypes(docs, dimensions, seed) if learned is None else learned
    langs = sorted(learned)
    matrix = np.array([learned[g] for g in langs], np.float64).reshape(len(langs), dimensions)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms == 0, 1, norms)

    def predict(text: str | None) -> tuple[str, float]:
        grams, counts, letters = ngram_counts(text or "")
        if not letters or not langs:
            return "und", 0.0
        own = bundle_of(grams, counts, dimensions, seed)
        cosines = matrix @ (own / max(np.linalg.norm(own), 1e-12))
        best = int(np.argmax(cosines))
        return langs[best], float(min(1.0, max(0.0, cosines[best])))

    def run(batch):
        found = [predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_()),
             pa.array([g for g, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"])

    return map_rows(texts(docs), run, "doc_id long, held_out boolean, lang_pred string, score double")
