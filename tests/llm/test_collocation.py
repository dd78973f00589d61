"""Collocations against counting every phrase by hand."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pricewise.llm import collocation
from tests.llm.data import documents, odd_rows


def by_hand(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        gone = {p[i:i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i:i + k]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for i, x in enumerate(sorted(best)[:top])]
    return sorted(out)


def rows_of(n=150, seed=3):
    rng = random.Random(seed)
    fixed = ["the quick brown Fox jumps over the lazy dog", "all rights reserved by the owner of this page today", "a a a a a a", "é è  ü\tö ñ"]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < .4 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 6))]
        out.append((rng.choice([". ", ", ", "\n", "! "]).join(parts), rng.choice(["en", "en", "fr", None])))
    return out


@pytest.mark.parametrize("least,bits", [(3, 17), (8, 20)])
def test_equals_hand_count(spark, least, bits):
    rows = rows_of()
    docs = documents(spark, [(i, *r) for i, r in enumerate(rows)])
    got = sorted(tuple(r) for r in collocation.collocations(docs, min_count=least, bits=bits).collect())
    want = by_hand(rows, least)
    assert len(want) > 20
    assert got == want


def test_a_full_filter_changes_nothing(spark):
    """With 32 counters for everything most pairs pass the filter."""
    rows = rows_of(60)
    docs = documents(spark, [(i, *r) for i, r in enumerate(rows)])
    grams, totals = collocation.longest_grams(docs, 3, bits=5)
    assert {r["lang"]: r["n"] for r in totals.collect()}["en"] > 0
    f = collocation.flows(grams, 3)
    want = {(r[0], r[2]): r[3] for r in by_hand(rows, 3)}
    got = {(r["lang"], r["phrase"]): r["f"] for k in (2, 3, 4) for r in f[k].collect()}
    assert want.items() <= got.items()


def test_odd_texts_and_top(spark):
    rows = [(t, lang) for (_, t), lang in zip(odd_rows(), ["en", "de", None] * 20)] + [("x y z w " * 3000, "en")]
    docs = documents(spark, [(i, *r) for i, r in enumerate(rows)], extra="gram n size phrase")
    got = sorted(tuple(r) for r in collocation.collocations(docs, min_count=2, top=15, bits=17).collect())
    assert got == by_hand(rows, 2, 15)


def test_long_texts_are_read_in_chunks():
    import pyarrow as pa
    text = " ".join(f"w{i % 7}" for i in range(900_000)) + ". end"
    batch = pa.record_batch({"lang": ["en"], "text": [text]})
    seen = list(collocation._chunks([batch]))
    assert len(seen) > 1
    assert sum(w.own for _, w in seen) == 900_001
    assert all(len(w.starts) - w.own == 3 for _, w in seen[:-1])


def test_empty_and_nulls(spark):
    assert collocation.collocations(documents(spark, []), min_count=2, bits=17).count() == 0
    assert collocation.collocations(documents(spark, [(1, None), (None, ""), (2, " . ")]), min_count=2, bits=17).count() == 0


def test_paths(spark):
    """A repeated passage is one path; a cycle's edges stay apart."""
    words = [f"w{i}" for i in range(40)]
    edges = [("en", " ".join(words[i:i + 4]), 30) for i in range(37)] + [("fr", g, 30) for g in ("a b c a", "b c a b", "c a b c")]
    got = collocation.compact(spark.createDataFrame(edges, "lang string, gram string, n long")).collect()
    assert [r["words"] for r in got if r["lang"] == "en"] == [words]
    assert sorted(r["path"] for r in got if r["lang"] == "fr") == ["a b c a", "b c a b", "c a b c"]
