import hashlib
import random
import re
from collections import Counter

import numpy as np

from pricewise.llm import pii as X
from tests.llm.data import documents, odd_rows, prose


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd, even = [int(c) for c in d[::-1][::2]], [int(c) for c in d[::-1][1::2]]
        if 12 <= len(d) <= 19 and (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(X.KINDS[k], a, b) for a, k, b in sorted(out)]


def noise(rng):
    return "".join(rng.choice("01239.@+-( )a%b_é. 5555") for _ in range(rng.randrange(120)))


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if X.luhn(d + c))


def corpus(rng, n):
    rows = []
    for i in range(n):
        number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        bits = [f"{prose(rng, 2).replace(' ', '.')}@mail{i}.example.com", f"+1 ({number(3)}) 555-{number(4)}", card(rng), f"10.{i % 250}.3.4",
                number(7), number(16), f"2024-0{1 + i % 9}-11", f"{number(3)}.{number(2)}"]
        rng.shuffle(bits)
        rows.append((i, " ".join(prose(rng, 6) + " " + b for b in bits)))
    return rows


def test_base_spans_match_brute_force():
    rng = random.Random(1)
    texts = [noise(rng) for _ in range(4000)] + [t for _, t in corpus(rng, 50)] + ["a@b.cc@d.ee", "x@y.z.", "1.2.3.4.5.6.7.8", "+1+1 222 333 444 55", "1" * 3000, "999999.1.1.1", "00000001.1.1.1"]
    for t in texts:
        assert X.base_spans(t) == brute(t), t


def test_query_rows_match_brute_force(spark):
    rows = odd_rows() + [(700 + i, t) for i, t in corpus(random.Random(2), 20)]
    got = X.find(documents(spark, rows, "spans n_ip"), None).collect()
    want = Counter()
    for d, t in rows:
        s = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want[(d, *(sum(x[0] == k for x in s) for k in X.KINDS), hashlib.sha256(text.encode()).hexdigest(), text, 0)] += 1
    assert Counter(map(tuple, got)) == want
    assert X.find(documents(spark), None).count() == 0


def test_trees_add_other_formats_and_leave_clean_text(spark):
    docs = documents(spark, corpus(random.Random(3), 300), "label x")
    trees = X.train(docs)
    assert set(trees.thresholds) == set(X.KINDS)
    rng = random.Random(4)
    hidden = [f"call me at ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} now", "write to some.name (at) mail3 (dot) example (dot) com today"]
    clean = [prose(rng, 50) + " 2024-03-11 and 1234567 then " + "".join(rng.choice("123456789") for _ in range(5)) for _ in range(20)]
    decoys = [d for d in ("".join(rng.choice("0123456789") for _ in range(16)) for _ in range(40)) if not X.luhn(d)]
    assert all(X.spans(t, trees)[1] for t in hidden)
    wrong = [(t, X.spans(t, trees)[1]) for t in clean + [f"the {d} of" for d in decoys]]
    assert not [w for w in wrong if w[1]]
    for t in hidden + clean:
        base, added = X.spans(t, trees)
        assert base == brute(t) and not any(a < e and s < b for _, a, b in added for _, s, e in base)
    out = X.redacted_documents(documents(spark, [(1, hidden[0]), (2, None), (3, "mail a@b.cd, ok")], "label"), trees).collect()
    assert {r.doc_id: r.text for r in out} == {1: "call me at [PHONE] now", 2: None, 3: "mail [EMAIL], ok"}
    assert X.train(documents(spark)) is None and X.train(documents(spark, odd_rows())) is None


def test_exported_trees_score_as_mllib(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    trees = X.Trees([X.parse_tree(t.toDebugString) for t in model.trees], list(model.treeWeights), {})
    want = [r.probability[1] for r in model.transform(df).collect()]
    assert np.allclose(trees.probability(x), want)


def test_loose_formats_in_the_corpus_are_not_negatives(spark):
    rng = random.Random(6)
    n = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    rows = []
    for i, t in corpus(rng, 300):
        c = card(rng)
        real = [f"({n(3)}) 555-{n(4)}", f"some.name at mail{i} dot example dot com", f"n{i} (at) mail{i}.example.com", ".".join(c[k:k + 4] for k in (0, 4, 8, 12))]
        rows.append((i, t + " " + " ".join(prose(rng, 6) + " " + x + " " + prose(rng, 2) for x in real)))
    trees = X.train(documents(spark, rows))
    c = card(rng)
    hidden = [f"call me at ({n(3)}) 555-{n(4)} now", "write to some.name at mail3 dot example dot com today", "the " + ".".join(c[k:k + 4] for k in (0, 4, 8, 12)) + " of"]
    assert [[k for k, _, _ in X.spans(t, trees)[1]] for t in hidden] == [["phone"], ["email"], ["card"]]
    assert not any(X.spans(prose(rng, 50) + " 2024-03-11 and 1234567 then " + n(5), trees)[1] for _ in range(20))


def test_rewritten_formats_are_loose_and_proposed():
    rng = random.Random(7)
    for kind, span in (("email", "a.b@mail.example.com"), ("card", card(rng)), ("phone", "+1 (212) 555-1234"), ("ip", "10.1.2.3")):
        for form in X.rewritten(kind, span, rng):
            assert X.loose(kind, form), form
            assert (kind, 2, 2 + len(form)) in X.candidates(f". {form}, end"), form
        assert not any(X.loose(kind, f) for f in X.broken(kind, rng))
    assert not X.loose("card", "1234.1234.1234.1234") and not X.loose("ip", "1-2-3-4") and not X.loose("ip", "1 . 2 . 3 . 300")
    assert ("email", 0, 18) in X.candidates("joe (at) mail3.com")


def test_look_alikes_stay_and_other_formats_go(spark):
    """No date, price or number of another kind stands in the sampled documents."""
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 9)} a.b{i}@mail.example.com {prose(rng, 6)} +1 ({200 + i % 700}) 555-{1000 + i} {prose(rng, 5)} {card(rng)} {prose(rng, 4)} 10.{i % 250}.3.4 x") for i in range(400)]
    trees = X.train(documents(spark, rows))
    assert set(trees.thresholds) == set(X.KINDS)
    other = random.Random(10)
    wrong = [f for k in X.KINDS for _ in range(30) for f in X.broken(k, other) if X.spans(f"the w1 {f} w2 of", trees)[1]]
    assert len(wrong) <= 15, wrong
    caught = Counter()
    for i in range(20):
        for kind, span in (("email", f"jo.doe{i}@host{i}.example.org"), ("card", card(other)), ("phone", f"+1 ({other.randrange(200, 999)}) 555-{9000 + i}"), ("ip", f"172.{i}.4.{other.randrange(256)}")):
            for k, form in enumerate(X.rewritten(kind, span, other)):
                caught[kind, k] += [s[0] for s in X.spans(f"the w1 {form} w2 of", trees)[1]] == [kind]
    # loose addresses of hosts and numbers with 00 are caught less often, as the README says
    sure = [("email", k) for k in range(5)] + [("card", k) for k in range(3)] + [("phone", k) for k in (0, 1, 3)]
    assert min(caught[f] for f in sure) >= 18, caught
    long = "a" * 500 + " @ mail.example.com"
    assert X.spans(long, trees)[1] == [("email", 0, len(long))]


def test_threshold_looks_past_a_single_high_negative():
    scores, labels = np.r_[.99, np.full(999, .9), np.full(50, .1)], np.r_[0., np.ones(999), np.zeros(50)]
    assert X.threshold(scores, labels, .995) == .9


def test_every_document_is_trained_on(spark):
    """More documents than any sample held; equal candidates are one row with their number."""
    docs = documents(spark, [(None if i == 7 else i, f"mail someone{i % 900 + 100}@host.example.com now") for i in range(10_300)])
    got = [r for r in X.labelled(docs).filter("kind = 'email' AND label = 1 AND NOT rewritten").collect()]
    assert sum(r["n"] for r in got) == 10_300 and len(got) < 10


def test_thresholds_of_weighted_rows_equal_those_of_one_array(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(s), float(rng.random() < s ** p), int(n)) for k, p in (("email", 0.05), ("ip", 0.2), ("card", 9.0)) for s, n in zip(rng.integers(0, 400, 900) / 400, rng.integers(1, 4, 900))]
    rows += [("phone", 0.9, 1.0, 29)]
    got = X.thresholds(spark.createDataFrame(rows, "kind string, score double, label double, n long"), 0.95)
    for kind in X.KINDS:
        own = [r for r in rows for _ in range(r[3]) if r[0] == kind]
        assert got.get(kind, 2.0) == X.threshold(np.array([r[1] for r in own]), np.array([r[2] for r in own]), 0.95), kind
    assert "email" in got and "phone" not in got
