import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pricewise.llm import records as R
from pricewise.session import work_path
from tests.llm.data import documents, odd_rows, prose

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]


def expect(rows, library):
    out, start = [], 0
    for d, t in rows:
        ids = library(t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_records_hold_the_library_ids_in_order(spark, library):
    rows = [r for r in odd_rows() if r[0] not in (None, 30)]
    rows += [(600, "a\u0085b c　d é ́x Å Σας ΣΑΣ <|endoftext|> don't\x1cwe'll \x0b\x0c q"), (601, "İstanbul ǅ ﬁ 가"), (602, "End. end, END. ... a... b., .c ,d e.̸ f,̸ ≠ 3. x9, don't. I'S. é. 's, 'S. <|startoftext|>. Á, q'll,"), (-5, "negative id")]
    random.Random(1).shuffle(rows)
    got = R.tokenized(documents(spark, rows, "start n_tokens hash"), PATH, 2).drop("ids").collect()
    assert sorted(map(tuple, got)) == expect(sorted((r[0], r[1]) for r in rows), library)


def test_added_tokens_are_the_librarys(library):
    encoder, width = R.encoder_of(PATH, 2)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>.", "<|endoftext|>", "<|end oftext|> <| endoftext|>", "<|endoftext|", "plain < | >", "é<|EndOfText|>é <|endoftext|><|endoftext|>"]
    for t, ids in zip(texts, encoder([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u2").tolist() == library(t)[:-1], t
    assert 49407 in library(texts[0])


def test_words_by_core_and_mark_equal_the_library(library):
    rng = random.Random(8)
    encoder, width = R.encoder_of(PATH, 2)
    texts = ["".join(rng.choice("abAB'’.,;:-!sStTlLrReEvVmMdD019éÉñ̸́ \n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    small = R.WordEncoder(encoder.source, width, cached=50)
    for found in (encoder([t.encode() for t in texts]), [small([t.encode()])[0] for t in texts]):
        for t, ids in zip(texts, found):
            assert np.frombuffer(ids, "<u2").tolist() == library(t)[:-1], t


def test_same_and_null_ids_and_empty_table(spark, library):
    rows = [(None, "a b"), (None, "c"), (3, "x"), (3, "x"), (3, "y z")]
    got = sorted(R.tokenized(documents(spark, rows), PATH, 2).drop("ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]
    assert sorted(r.ids_crc32 for r in got) == sorted(x[3] for x in expect(rows, library))
    assert R.tokenized(documents(spark), PATH, 2).count() == 0


def test_many_files_random_access_and_stray_files(spark, library):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(40))) for i in rng.sample(range(5000), 500)]
    folder = work_path(spark, "records-test")
    encoder, width = R.encoder_of(PATH, 2)
    assert width == 2
    manifest = R.write_records(documents(spark, rows).repartition(4), encoder, width, 2, folder)
    files = [r.path for r in manifest.orderBy("part").collect()]
    system, base = R._open(folder)
    with system.open_output_stream(base + "/part-000000-stray.rec") as f:
        f.write(b"left by a lost attempt")
    got = sorted(map(tuple, R.read_records(spark, manifest).drop("ids").collect()))
    assert got == expect(sorted(rows), library)
    by_id = dict(rows)
    system, base = R._open(files[-1])
    index = np.frombuffer(system.open_input_file(base + ".idx").read(), R.ENTRY)
    data = system.open_input_file(base + ".rec").read()
    for e in rng.sample(list(index), 5):
        assert np.frombuffer(R.unframe(data, int(e["offset"])), "<u2").tolist() == library(by_id[int(e["doc_id"])])
    assert os.path.basename(base).startswith("part-")


def test_damage_is_found():
    data = bytearray(R.frame(b"abcdef"))
    assert R.unframe(bytes(data)) == b"abcdef"
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            R.unframe(bytes(bad))
    with pytest.raises(ValueError):
        R.unframe(bytes(data[:-2]) + b"")
