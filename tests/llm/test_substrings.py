import random

import numpy as np
import pytest

from pricewise.llm import substrings as D
from pricewise.llm import suffixes as S
from tests.llm.data import documents, odd_rows, prose


def brute(rows, length):
    """(doc_id, bytes, removed, runs, kept) per row; rows in document order, equal rows once."""
    import zlib
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))
    seen, out = set(), {}
    for r in sorted(rows, key=key):
        if key(r) in out:
            continue
        data = (r[1] or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key(r)] = (r[0], len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept)
    return sorted((out[key(r)] for r in rows), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    rows = odd_rows(seed)
    passage = prose(rng, 60, 5000)
    for d in range(100, 160):
        t = prose(rng, rng.randrange(0, 80), 5000)
        if rng.random() < .5:
            t += " " + passage[rng.randrange(200):len(passage) - rng.randrange(200)] + " " + prose(rng, 5, 5000)
        if rng.random() < .3:
            t = t + t
        if rng.random() < .3:
            t = rows[rng.randrange(12)][1] + t
        rows.append((d, t))
    near = prose(rng, 120, 5000)
    for d in range(200, 215):
        cut = rng.randrange(len(near) - 9)
        rows.append((d, near[:cut] + rng.choice(["", "zz"]) + near[cut + rng.randrange(4):]))
    line = "A very common line that stands in many of these documents, whatever is around it."
    rows += [(d, prose(rng, 9, 5000) + "\n" + line + "\n" + prose(rng, 9, 5000)) for d in range(300, 320)]
    return rows


@pytest.mark.parametrize("length,kmer", [(100, 32), (40, 13), (20, 20)])
def test_kept_bytes_match_brute_force(spark, length, kmer):
    rows = rows_of(length)
    got = D.dedup(documents(spark, rows, "known crc spans kept").repartition(6), length, kmer).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, length)


def test_small_slices_settle_the_same(spark, monkeypatch):
    rows = [(i, "abcdefghij" * 30 + str(i)) for i in range(40)] + [(50, "ab" * 400), (51, "q" * 99), (52, "q" * 100), (53, "q" * 101)]
    got = D.dedup(documents(spark, rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 100)
    assert D.dedup(documents(spark)).count() == 0


def test_deep_shallow_sort_orders_and_groups():
    rng = random.Random(3)
    for length, letters in ((5, b"ab"), (40, b"ab"), (100, b"aab"), (64, bytes(range(256)))):
        data = bytes(rng.choice(letters) for _ in range(600))
        data += data[100:400] + data[:250]
        starts = np.array([rng.randrange(len(data) - length) for _ in range(900)])
        order, group = S.sort_strings(data + bytes(8), starts, length)
        strings = [data[s:s + length] for s in starts[order].tolist()]
        assert strings == sorted(strings) and sorted(order.tolist()) == list(range(900))
        assert [a == b for a, b in zip(strings, strings[1:])] == [a == b for a, b in zip(group, group[1:])]


def test_anchors_are_leftmost_least_and_rolling_is_by_content():
    data = np.frombuffer(bytes(random.Random(4).choice(b"abc") for _ in range(3000)), np.uint8)
    for size in (1, 7, 13, 32):
        h = D.rolling(data, size)
        by = {}
        for i in range(len(data) - size + 1):
            by.setdefault(bytes(data[i:i + size]), set()).add(int(h[i]))
        assert len(h) == len(data) - size + 1 and all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
    h, at = D.anchors(data, 100, 32)
    top = (h >> np.uint64(32)).tolist()
    assert at.tolist() == [min(range(s, s + 69), key=lambda i: (top[i], i)) for s in range(len(data) - 99)]
