import random
import re
from collections import Counter

import pytest

from pricewise.llm import linededup as L
from tests.llm.data import documents, odd_rows


def visible(text):
    return [(i, x) for i, x in enumerate((text or "").split("\n")) if re.search("[^\x20\x09-\x0D]", x)]


def brute(rows, m):
    """doc_id -> (visible lines, removed lines, runs, text left); doc_ids are unique."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        v = visible(text)
        gone = set()
        for k in range(len(v) - m + 1):
            w = tuple(x for _, x in v[k:k + m])
            if w in seen:
                gone.update(range(k, k + m))
            seen.add(w)
        lines, drop, ordinal = (text or "").split("\n"), [], -1
        shown = {i for i, _ in v}
        for i in range(len(lines)):
            ordinal += i in shown
            drop.append(ordinal in gone)
        left = "\n".join(x for x, go in zip(lines, drop) if not go)
        runs = sum(k in gone and k - 1 not in gone for k in range(len(v)))
        out[d] = (len(v), len(gone), runs, left)
    return out


def line_rows(seed, n=40):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " \t", "long line", f"u{rng.random()}"]) for _ in range(rng.randrange(0, 30)))) for i in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, "x\nx\nx\nx\nx"), (n + 2, ""), (n + 3, None), (n + 4, "\n\n"), (n + 5, "\n".join(["q", "r"] * 2000))]


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines_left_match_brute_force(spark, m):
    rows = line_rows(m)
    got = L.dedup(documents(spark, rows, "key pos cut row"), m).select("row.doc_id", "cut.*").collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in got if r.doc_id != 43} == {k: v for k, v in brute(rows, m).items() if k != 43}
    assert len(got) == len(rows)


def test_documents_keep_their_columns_and_odd_rows(spark):
    rows = odd_rows(2) + [(40, "one\ntwo\nthree"), (41, "zero\none\ntwo\nfour"), (41, "zero\none\ntwo\nfour"), (None, "one\ntwo")]
    docs = documents(spark, rows, "key cut")
    out = L.deduplicated(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by = Counter((r.doc_id, r.text) for r in got)
    assert by[(23, None)] == 1 and by[(24, "")] == 1 and by[(None, "one\ntwo")] == 1
    assert by[(40, "three")] == 1 and by[(41, "zero\nfour")] == 2
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert L.deduplicated(documents(spark)).count() == 0


def brute_long(rows, m, words):
    """doc_id -> text left where later copies of runs of m lines and of single lines of more words go."""
    runs, lines, out = set(), set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        v = visible(text)
        gone = set()
        for k in range(len(v)):
            w = tuple(x for _, x in v[k:k + m])
            if len(w) == m and w in runs:
                gone.update(range(k, k + m))
            if len(v[k][1].split()) > words and v[k][1] in lines:
                gone.add(k)
            runs.add(w)
            lines.add(v[k][1])
        kept, ordinal, shown = [], -1, {i for i, _ in v}
        for i, x in enumerate((text or "").split("\n")):
            ordinal += i in shown
            if ordinal not in gone:
                kept.append(x)
        out[d] = (len(v), len(gone), sum(k in gone and k - 1 not in gone for k in range(len(v))), "\n".join(kept))
    return out


@pytest.mark.parametrize("m", [2, 3])
def test_long_single_lines_are_runs(spark, m):
    rng = random.Random(20 + m)
    long = [" ".join(f"l{i}{rng.randrange(50)}" for _ in range(n)) for i, n in enumerate((50, 51, 51, 80))]
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " \t", *long, f"u{rng.random()}", f"u{rng.random()}"]) for _ in range(rng.randrange(0, 14)))) for i in range(40)]
    rows += [(40, long[3]), (41, long[3]), (42, "x\n" + long[1] + "\ny"), (43, long[0]), (44, None), (45, "  " + long[1].replace(" ", "  ")), (46, "\t" + long[0])]
    docs = documents(spark, rows, "key pos cut row size long")
    got = L.dedup(docs, m, 50).select("row.doc_id", "cut.*").collect()
    # a null text stays null in deduplicated(); cut has no text for it
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.text) for r in got if r.doc_id != 44} == {k: v for k, v in brute_long(rows, m, 50).items() if k != 44}
    left = {r.doc_id: r.text for r in L.deduplicated(docs, m, 50).collect()}
    assert left[41] == "" and left[42] == "x\ny" and left[43] == long[0] and left[44] is None


def test_the_pipeline_removes_repeated_passages_on_one_line(spark):
    import corpus_pipeline
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [(1, "one\n" + passage + "\ntwo"), (2, "three\n" + passage + "\nfour"), (3, passage), (4, "one\nfive")])
    left = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert left == {1: "one\n" + passage + "\ntwo", 2: "three\nfour", 3: "", 4: "one\nfive"}
