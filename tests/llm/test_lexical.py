"""Search against scoring every document for every item by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pricewise.llm import lexical
from tests.llm.data import documents, odd_rows

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_hand(rows, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    merged = {}
    for item, text in items:
        merged.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in merged.items():
        scored = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if gone else d, -s) for i, (s, gone, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def some_rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(i // 2, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("block_terms,block_items,step", [(65536, 4096, 8192), (6, 4096, 2), (65536, 2, 8192)])
def test_equals_hand_scores(spark, monkeypatch, block_terms, block_items, step):
    rows = some_rows() + odd_rows()
    items = [(1, "A bb c"), (2, "bb! dd-ee, the of"), (3, None), (4, "zzzz nothing here"), (5, "it's we'll 123 456é"), (5, "jj"), (None, "漢字 of"), (6, " ".join("abcdefghij"))]
    got = lexical.search(documents(spark, rows, extra="item term n"), spark.createDataFrame(items, ITEMS), block_terms=block_terms, block_items=block_items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, items)


def test_products_stay_exact(monkeypatch):
    """Runs of few terms and one of all give the same sums, also above 2 ** 53 in total."""
    rng = np.random.default_rng(5)
    number = np.sort(np.tile(np.arange(500), 3))
    column, impact = np.tile(np.arange(3), 500), rng.integers(1, 10**6, 1500)
    weights = rng.integers(0, 2**31, (2, 500)).astype(float)
    want = [[sum(int(weights[i, t]) * int(impact[(number == t) & (column == d)][0]) for t in range(500)) for d in range(3)] for i in range(2)]
    assert max(map(max, want)) > lexical.EXACT
    assert lexical._tile_scores(weights, np.arange(500), number, column, impact, 3).tolist() == want


def test_ties_and_empty(spark):
    docs = documents(spark, [(9 - i, "same words here") for i in range(9)] + [(20, "other text")])
    got = lexical.search(docs, spark.createDataFrame([(1, "words")], ITEMS), k=4).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    none = spark.createDataFrame([], ITEMS)
    assert lexical.search(docs, none).count() == 0
    assert lexical.search(documents(spark, [(1, None)]), spark.createDataFrame([(1, "x")], ITEMS)).count() == 0
