import random
import re

import xxhash

from pricewise.llm import simhash as S
from pricewise.llm.components import components
from tests.llm.data import documents, odd_rows, prose


def brute_fp(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_rows(seed):
    rng = random.Random(seed)
    rows = odd_rows(seed)
    for d in range(100, 130):
        t = rows[d % 12][1].split()
        t[rng.randrange(len(t))] = "changed"
        rows.append((d, " ".join(t * 12)))
        rows.append((d + 100, " ".join(t * 12) + " tail"))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows(1)
    got = S.near_duplicates(documents(spark, rows, "fingerprint component_id fp root")).collect()
    fps = [brute_fp(t) for _, t, *_ in rows]
    pairs = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 3]
    assert pairs
    roots = brute_components(pairs, set(fps))
    least = {}
    for (d, *_), f in zip(rows, fps):
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted([(d, f"{f:016x}", least.get(roots[f])) for (d, *_), f in zip(rows, fps)], key=key)


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(2)
    for radius in (2, 3):
        fps = {rng.getrandbits(64) for _ in range(150)} | {0}
        for f in list(fps):
            for _ in range(3):
                g = f
                for b in rng.sample(range(64), rng.randrange(1, 5)):
                    g ^= 1 << b
                fps.add(g)
        signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
        edges = S.links(spark.createDataFrame(signed, "fp long"), radius)
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in found)
        want = brute_components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius], fps)
        assert brute_components(found, fps) == want
        got = {r.node: r.root for r in components(edges).collect()}
        signed_root = {}
        for f in fps:
            s = f - (1 << 64) if f >> 63 else f
            signed_root.setdefault(want[f], []).append(s)
        for group in signed_root.values():
            assert {got.get(s, s) for s in group} == {min(group)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(100)} == {1000}


def test_one_row_of_each_group_stays(spark):
    rows = near_rows(3)
    docs = documents(spark, rows, "root fp row")
    kept = S.one_per_group(docs)
    assert kept.columns == docs.columns
    got = S.near_duplicates(docs).collect()
    want = sorted({r.component_id for r in got if r.component_id is not None})
    have = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert have == want
    empty = documents(spark)
    assert S.near_duplicates(empty).count() == 0 and S.one_per_group(empty).count() == 0
    assert S.near_duplicates(documents(spark, [(None, prose(random.Random(1), 9))])).collect()[0].component_id is None
