import random
import re
from collections import Counter

from pricewise.llm import decontaminate as D
from tests.llm.data import documents, odd_rows, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(rows, items, size=10):
    pats = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            pats.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(p) for p in pats}:
                if k + n <= len(w) and tuple(w[k:k + n]) in pats:
                    hit.update(range(k, k + n))
                    found |= pats[tuple(w[k:k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), tuple(ids), bool(hit)))
    return Counter(out)


def case(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(1, 40), 200)) for i in range(25)] + [(90, None), (91, "-- "), (None, prose(rng, 14)), (7, prose(rng, 11)), (92, "w1")]
    rows = odd_rows(seed)
    for d in range(100, 140):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        cut = words(a)[rng.randrange(3):]
        rows.append((d, prose(rng, 30, 400) + ", " + "  ".join(cut).upper() + "; " + b + ". " + prose(rng, 3, 400)))
    return rows, items


def run(spark, rows, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.hits(documents(spark, rows, "n_words items"), bench, **more).collect()
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got)


def test_hits_match_brute_force(spark):
    for seed in (1, 2):
        rows, items = case(seed)
        assert run(spark, rows, items) == brute(rows, items)


def test_pattern_blocks_and_empty_tables(spark):
    rows, items = case(3)
    assert run(spark, rows, items, block_bytes=1500) == brute(rows, items)
    assert run(spark, rows, []) == brute(rows, [])
    assert not run(spark, [], items)


def test_clean_documents(spark):
    rows, items = case(4)
    items = [x for x in items if len(words(x[1])) > 5]
    docs = documents(spark, rows, "items")
    got = D.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in brute(rows, items).elements() if not r[5])


def test_wu_manber_finds_every_occurrence():
    rng = random.Random(5)
    for _ in range(30):
        data = bytes(rng.choice(b"ab ") for _ in range(6000))
        pats = list({data[i:i + n] for i, n in ((rng.randrange(5900), rng.randrange(1, 30)) for _ in range(12))})
        want = sorted((m, p) for p in pats for m in range(len(data) - len(p) + 1) if data.startswith(p, m))
        assert sorted(D.Matcher(pats).occurrences(data + bytes(16), len(data))) == want
