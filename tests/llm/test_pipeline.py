"""The whole pipeline against a brute-force version of its stages on a small corpus."""

import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from pricewise.llm import bpe
from tests.llm import test_decontaminate, test_linededup, test_quality, test_simhash
from tests.llm.data import documents, prose


def corpus():
    rng = random.Random(11)
    items = [(i, prose(rng, 25, 500)) for i in range(6)]
    rows = [(i, "\n".join(prose(rng, rng.randrange(12, 60), 3000) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + "\nshort tail"), (102, "few words"), (103, None), (104, "same " * 50),
             (105, prose(rng, 30, 900) + " " + items[2][1] + " " + prose(rng, 9, 900)),
             (106, rows[2][1].replace("w1", "w2", 1)), (107, prose(rng, 40, 900) + "\n" + "\n".join(rows[3][1].split("\n")[-2:]))]
    return rows, items


def brute(rows, items):
    kept = []
    for d, t in rows:
        n, _, _, _, repeated = test_quality.brute(t)
        if n >= 10 and 100 * repeated <= 20 * n:
            kept.append((d, t))
    lines = test_linededup.brute(kept, 2)
    docs = [(d, lines[d][3]) for d, _ in kept]
    fps = {d: test_simhash.brute_fp(t) for d, t in docs}
    every = set(fps.values())
    roots = test_simhash.brute_components([(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= 3], every)
    first = {}
    for d, _ in sorted(docs):
        first.setdefault(roots[fps[d]], d)
    docs = [(d, t) for d, t in docs if first[roots[fps[d]]] == d]
    dirty = {r[0] for r in test_decontaminate.brute(docs, items) if r[5]}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
    return {d: (enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs if d not in dirty}


def test_run_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # prose of one kind: no document is far from the references, whose rules have their own tests
    want = brute(rows, items)
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(want) < len(rows)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (documents(spark, rows[:12] + [(None, None), (1, "twice"), (1, "twice")], "key row fp"), documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
