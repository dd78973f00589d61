import random
import zlib

import numpy as np
import pytest

from pricewise.llm import langid as G
from pricewise.llm.queries import QUERIES
from tests.llm.data import documents, odd_rows

LETTERS = {"aa": "etaoinshr", "bb": "ñáóciedlz", "cc": "漢字仮名交"}


def rows(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(list(LETTERS))
        out.append((i, " ".join("".join(rng.choice(LETTERS[g]) for _ in range(rng.randrange(2, 8))) for _ in range(30)) + " 12.", g))
    return out


def brute_bundle(text):
    """Bind and bundle one n-gram at a time."""
    letters = {x: G.letter(x).astype(int) for x in {0, *(int(G.symbols()[ord(c)]) for c in text)}}
    s = [0]
    for c in text:
        x = int(G.symbols()[ord(c)])
        if x or s[-1]:
            s.append(x)
    if s[-1]:
        s.append(0)
    total = np.zeros(G.DIMENSIONS, int)
    for a, b, c in zip(s, s[1:], s[2:]):
        total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_prototypes_and_predictions_match_brute_force(spark):
    data = rows(1)
    docs = documents(spark, data, "held_out score")
    learned = G.prototypes(docs)
    train = [(t, g) for i, t, g in data if zlib.crc32(str(i).encode()) % 3 != 1]
    want = {g: sum(brute_bundle(t) for t, h in train if h == g) for g in LETTERS}
    assert {g: list(v) for g, v in learned.items()} == {g: v.tolist() for g, v in want.items()}
    got = {r.doc_id: r for r in G.identify(docs, learned).collect()}
    for i, t, g in data:
        own = brute_bundle(t)
        cosines = {h: float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)) for h, v in want.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].lang_pred == best == g and got[i].score == pytest.approx(cosines[best])
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_odd_rows(spark):
    data = [(*r, "en") for r in odd_rows()] + [(900, "123 ...", "en"), (901, "words without language", None)]
    got = G.identify(documents(spark, data)).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (23, 24, 25, 900)) and by[901].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert G.identify(documents(spark)).count() == 0
    assert {r.lang_pred for r in G.identify(documents(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = "some words, 漢字 and more words; " * 50
    whole = G.ngram_counts(text)
    monkeypatch.setattr(G, "BLOCK", 97)
    parts = G.ngram_counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_languages_of_one_script_are_told_apart_by_their_letters(spark):
    """Two Cyrillic languages that share all letters but two; any two letters have vectors of their own."""
    rng = random.Random(3)
    letters = {"ru": "аеинострвлыэ", "uk": "аеинострвліє"}
    word = lambda g: "".join(rng.choice(letters[g]) for _ in range(rng.randrange(3, 8)))
    data = [(i, " ".join(word(g) for _ in range(rng.randrange(40, 80))), g) for i, g in enumerate(["ru", "uk"] * 60)]
    got = {r.doc_id: r for r in G.identify(documents(spark, data)).collect()}
    assert all(got[i].lang_pred == g for i, _, g in data)
    both = [int(G.symbols()[ord(c)]) for c in "ыіЫßёж漢"]
    assert both[0] == both[2] and len(set(both)) == 6
    assert all(abs(int(G.letter(a).astype(int) @ G.letter(b))) < 150 for a in set(both) for b in set(both) if a != b)


def test_bundles_do_not_depend_on_how_many_ngrams_are_held(spark, monkeypatch):
    data = rows(4, 20)
    texts = [t for _, t, _ in data]
    parts = [G.ngram_counts(t)[:2] for t in texts]
    whole = G.bundle_of(*G._merged(parts), G.DIMENSIONS, G.SEED)
    assert whole.tolist() == sum(G.bundle_of(*p, G.DIMENSIONS, G.SEED) for p in parts).tolist()


def test_held_out_accuracy(spark):
    from tests.conftest import SF_SMALL
    found = QUERIES["op10_language_id"](spark, SF_SMALL)
    truth = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    test = found.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(test) > 30 and sum(r.lang_pred == r.lang for r in test) >= 0.95 * len(test)
