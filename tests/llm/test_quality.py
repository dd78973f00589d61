import math
import re
from collections import Counter

import pytest

from pricewise.llm import quality as Q
from tests.llm.data import documents, odd_rows


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts_match_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] != 33]
    got = Q.quality(documents(spark, rows, "n_words kept")).collect()
    assert len(got) == len(rows)
    want = Counter((d, *brute(t)) for d, t in rows)
    assert Counter(tuple(r[:6]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def brute_js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_references_and_distances(spark):
    import random
    rng = random.Random(1)
    en = [" ".join(rng.choice(["the", "and", "cat", "dog"]) for _ in range(300)) for _ in range(10)]
    fr = [" ".join(rng.choice(["le", "et", "chat", "chien"]) for _ in range(300)) for _ in range(10)]
    rows = [(i, t, "en") for i, t in enumerate(en)] + [(50 + i, t, "fr") for i, t in enumerate(fr)]
    rows += [(90, fr[0], None), (91, "#% $$ ** " * 200, "en"), (92, None, None), (93, en[0][:150], "xx")]
    docs = documents(spark, rows)
    refs = Q.references(docs)
    counts = Counter(w for _, t, g in rows if g == "en" for w in (t or "").lower().split())
    assert set(refs) == {"en", "fr"}
    assert refs["en"][1] == {w.encode(): float(n) for w, n in counts.most_common(64)} and refs["en"][2] == 0
    got = {r.doc_id: r for r in Q.quality(docs, refs).collect()}
    own = Counter(en[3].split())
    words = list(refs["en"][1])
    want = brute_js([own[w.decode()] for w in words] + [0], [*refs["en"][1].values(), 0])
    assert got[3].word_distance == pytest.approx(want)
    assert got[90].word_distance < 0.2 and got[91].char_distance > Q.MAX_CHAR_DISTANCE and not got[91].kept
    assert got[93].word_distance is None and got[92].char_distance is None


def test_kept_documents_is_the_verdict_and_keeps_columns(spark):
    docs = documents(spark, odd_rows(3), "n_words kept")
    want = Counter(r.doc_id for r in Q.quality(docs).collect() if r.kept)
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == want
    empty = documents(spark)
    assert Q.quality(empty).count() == 0 and Q.kept_documents(empty).count() == 0


def test_long_texts_without_common_words_are_rejected(spark):
    import random
    rng = random.Random(8)
    common = [f"c{i}" for i in range(64)]

    def text(n, share):
        # a third of the words are common, by Zipf's law; the others hardly ever come twice
        return " ".join(rng.choices(common, [1 / (i + 2) for i in range(64)])[0] if rng.random() < share else f"r{rng.randrange(10 ** 6)}" for _ in range(n))

    rows = [(i, text(rng.randrange(100, 900), .32), "en") for i in range(150)]
    rows += [(200 + i, text(300, 0), g) for i, g in enumerate(["en", "en", None, "en"])] + [(300, text(60, 0), "en"), (301, text(300, .32), None)]
    got = {r.doc_id: r for r in Q.quality(documents(spark, rows)).collect()}
    assert all(got[d].kept for d in got if d < 200 or d >= 300)
    assert not any(got[d].kept or got[d].base_failed for d in range(200, 204))
    assert all(got[d].char_distance < Q.MAX_CHAR_DISTANCE and got[d].word_distance < Q.MAX_WORD_DISTANCE for d in range(200, 204))


def test_word_limit_asks_for_more_words_where_common_words_are_rare():
    import numpy as np
    rare = np.array([1.0] * 64 + [3200.0])
    least, most = Q.word_limit(rare)
    none = Q.js_distance(np.array([0.0] * 64 + [1.0]), rare)
    assert least > Q.MIN_WORDS and most < none
    drawn = np.random.default_rng(1).multinomial(least, rare / rare.sum(), size=300)
    want = [brute_js(list(x), list(rare)) for x in drawn[:20].tolist()]
    assert Q.js_distances(drawn[:20], rare) == pytest.approx(want)
    assert (Q.js_distances(drawn, rare) <= most).mean() > .97


def test_every_language_has_its_own_reference_and_small_ones_pass(spark):
    # 600 languages with letters of their own; a foreign reference would reject them all
    rows = [(i, " ".join(f"{chr(0x4E00 + i)}{k % 7}" for k in range(2100)), f"g{i:03d}") for i in range(600)]
    rows += [(700, "#% $$ ** " * 200, "g001"), (701, " ".join(f"\u0416{k}" for k in range(150)), "rare")]
    docs = documents(spark, rows)
    refs = Q.references(docs)
    assert len(refs) == 600
    judge = Q.Judge({g: refs[g] for g in ("g001", "g599")})
    for d, g in ((1, "g001"), (599, "g599")):
        chars, word, limit = judge.distances(g, rows[d][1].encode(), rows[d][1].encode().split())
        assert chars < Q.MAX_CHAR_DISTANCE and word < limit
    assert judge.distances("rare", rows[601][1].encode(), rows[601][1].encode().split())[:2] == (None, None)
    assert judge.distances("g001", rows[600][1].encode(), rows[600][1].encode().split())[0] > Q.MAX_CHAR_DISTANCE
    chars, word, limit = judge.distances(None, rows[1][1].encode(), rows[1][1].encode().split())
    assert chars < Q.MAX_CHAR_DISTANCE and word < limit
