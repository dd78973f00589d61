"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are compared with those of its
language (built from all documents) by Jensen-Shannon distance.  Histograms of short
documents are noise, so each comparison has a minimum length below which it passes.
The limit of the word distance comes from the reference itself (``word_limit``): it lies between
the distances of short texts drawn from the reference and that of a text without common words.

Cases: a null text has no words (``base_failed``); a null language is compared with the nearest
reference; a language without a reference of its own passes the divergence rules, as does every text
where there is no reference at all; repeated rows get
equal verdicts; an empty table gives an empty result.  Extra columns are ignored by
``quality`` and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import WORD_SPACE, map_rows, slices, ship, text_bytes, texts

#: Reference size and guards (production parameters).
COMMON_WORDS = 64
MIN_REFERENCE_WORDS = 2_000
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.30
#: Never more than this, whatever the reference's own limit is.
MAX_WORD_DISTANCE = 0.62
#: Texts drawn from a reference for its own limit, and the share of them that it must keep.
DRAWS = 1_000
DRAWN_KEPT = 0.99

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Byte classes: lower, upper, digit, white space, other ASCII, non-ASCII.
CLASSES = 6
_CLASS = np.full(256, 4, dtype=np.int64)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[ord(c) for c in WORD_SPACE]] = 3
_CLASS[128:] = 5

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside ``size``-word windows that occur at least twice in ``words``."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    starts = [i for i, w in enumerate(windows) if counts[w] > 1]
    return size + sum(min(size, b - a) for a, b in pairwise(starts))


def base_stats(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    code_points = len(text.decode("utf-8", "replace"))
    word_chars = code_points - sum(text.count(c.encode()) for c in WORD_SPACE)
    n_symbols = sum(text.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated_window_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits (0 to 1) of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def kl(a):
        use = a > 0
        return float((a[use] * np.log2(a[use] / m[use])).sum())

    return max(0.0, (kl(p) + kl(q)) / 2) ** 0.5


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``js_distance`` of every row of ``p`` to ``q``."""
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum()
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


def word_limit(ref: np.ndarray, min_words: int = MIN_WORDS) -> tuple[int, float]:
    """(words, limit): from that many words on, texts further than the limit from ``ref`` (counts of
    the common words, then of all others) use the common words unlike the language.  The limit is
    halfway between the distance that ``DRAWN_KEPT`` of the texts drawn from ``ref`` keep and the
    distance of a text without a common word; where common words are so rare that short texts
    drawn from ``ref`` get near the latter, more words are asked for."""
    none = js_distance(np.array([0.0] * (len(ref) - 1) + [1.0]), ref)
    words, rng = min_words, np.random.default_rng(7)
    while words < 1 << 30:
        drawn = float(np.quantile(js_distances(rng.multinomial(words, ref / ref.sum(), size=DRAWS), ref), DRAWN_KEPT))
        if drawn < 0.9 * none:
            return words, (drawn + none) / 2
        words *= 2
    return words, 1.0


def references(docs: DataFrame, common: int = COMMON_WORDS,
               min_words: int = MIN_REFERENCE_WORDS) -> dict[str, tuple[list[float], dict[bytes, float], float]]:
    """Per language: byte-class counts, counts of its most common words, and the count of
    all other words.  Counted over all documents with a language (partial counts per Arrow
    batch, then a sum); languages with fewer than ``min_words`` words have no reference.
    One reference per language comes to the driver: 6 numbers, and ``common`` words with counts."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                words: dict[str, Counter] = defaultdict(Counter)
                classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, dtype=np.int64))
                for lang, text in zip(part.column("lang").to_pylist(), text_bytes(part.column("text"))):
                    if lang is not None:
                        words[lang].update(text.lower().split())
                        classes[lang] += np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES)
                rows = [(g, w, n) for g, c in words.items() for w, n in c.items()]
                rows += [(g, None, int(n) * 8 + k) for g, c in classes.items() for k, n in enumerate(c)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                     pa.array([r[2] if r[1] is not None else r[2] >> 3 for r in rows], pa.int64()),
                     pa.array([-1 if r[1] is not None else r[2] & 7 for r in rows], pa.int32())],
                    names=["lang", "word", "n", "klass"])

    counts = texts(docs, "lang").mapInArrow(count, "lang string, word binary, n long, klass int") \
        .groupBy("lang", "klass", "word").agg(F.sum("n").alias("n"))
    # One ranked list per language and kind; the rank filter is applied in every task first.
    best = Window.partitionBy("lang", "klass").orderBy(F.desc("n"), F.asc("word"))
    counts = counts.persist()
    try:
        totals = counts.filter("klass = -1").groupBy("lang").agg(F.sum("n").alias("words")) \
            .filter(F.col("words") >= min_words)
        total = {r["lang"]: r["words"] for r in totals.collect()}
        top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= common) \
            .join(totals.select("lang"), "lang")
        out = {g: ([0.0] * CLASSES, {}, 0.0) for g in total}
        for r in top.collect():
            if r["klass"] >= 0:
                out[r["lang"]][0][r["klass"]] = float(r["n"])
            else:
                out[r["lang"]][1][bytes(r["word"])] = float(r["n"])
    finally:
        counts.unpersist()
    return {g: (c, w, float(total[g] - sum(w.values()))) for g, (c, w, _) in out.items()}


class Judge:
    """Distances of a document to the references; holds plain lists so it travels to tasks."""

    def __init__(self, refs: dict, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
                 min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS):
        self.max_char, self.max_word, self.min_chars, self.min_words = max_char, max_word, min_chars, min_words
        self.refs = {g: (np.array(c), list(w), np.array([*w.values(), other])) for g, (c, w, other) in sorted(refs.items())}
        self.limits = {g: word_limit(ref, max(1, min_words)) for g, (_, _, ref) in self.refs.items()}

    def distances(self, lang: str | None, text: bytes, words: list[bytes]) -> tuple[float | None, float | None, float]:
        """(character distance, word distance, limit of the latter); None where the document is
        too short or there is nothing to compare with."""
        langs = list(self.refs) if lang is None else [lang] if lang in self.refs else []
        chars, word, limit = None, None, self.max_word
        if langs and len(text) >= self.min_chars:
            own = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES).astype(float)
            chars = min(js_distance(own, self.refs[g][0]) for g in langs)
        if langs and len(words) >= self.min_words:
            seen = Counter(w.lower() for w in words)
            found = []
            for g in langs:
                _, common, ref = self.refs[g]
                own = np.array([seen[w] for w in common] + [0.0])
                own[-1] = len(words) - own.sum()
                least, most = self.limits[g]
                found.append((js_distance(own, ref), min(self.max_word, most) if len(words) >= least else self.max_word))
            word, limit = min(found)
        return chars, word, limit

    def evaluate(self, lang: str | None, text: bytes) -> tuple:
        words = text.split()
        stats = base_stats(text, words)
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        chars, word, limit = self.distances(lang, text, words)
        kept = not failed and (chars is None or chars <= self.max_char) and (word is None or word <= limit)
        return (*stats, failed, kept, chars, word)


def quality(docs: DataFrame, refs: dict | None = None, **limits) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and the two distances."""
    judge = Judge(references(docs) if refs is None else refs, **limits)

    def run(batch):
        rows = [judge.evaluate(g, t) for g, t in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")))]
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "base_failed", "kept", "char_distance", "word_distance"])

    return map_rows(texts(docs, "lang"), run,
                    f"doc_id long, {STATS}, base_failed boolean, kept boolean, char_distance double, word_distance double")


def kept_documents(docs: DataFrame, refs: dict | None = None, **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep (one pass, no join)."""
    judge = Judge(references(docs) if refs is None else refs, **limits)

    def run(batch):
        kept = [judge.evaluate(g, t)[6] for g, t in zip(batch.column("lang").cast(pa.string()).to_pylist(), text_bytes(batch.column("text")))]
        return batch.filter(pa.array(kept, pa.bool_()))

    return map_rows(docs, run, docs.schema)
