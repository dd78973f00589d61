import public_tokenizers as P
import pytest
import tiktoken

from pricewise.llm import bpe
from pyspark.sql import functions as F
from tests.llm.data import documents, odd_rows

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    return ["漢字仮名交じり文" * 200, "-" * 1500 + "=" * 377 + " " * 500 + "x", "   a\u0085b 　c d\n\n\n  e\t\tf",
            "abababab" * 200 + "aaaaabbbbb" * 100, "<|endoftext|> it's WE'LL don't\r\n", "٣٤٥ ½ Ⅷ x²", "é ́ 😀👍🏽"]


def test_ids_equal_the_library_and_decode_to_the_text(spark, library):
    rows = [r for r in odd_rows() if r[0] not in (None, 30)] + [(500 + i, t) for i, t in enumerate(odd_texts())]
    docs = documents(spark, rows, "ids decoded")
    got = {r.doc_id: r for r in bpe.encode(docs, RANKS, P.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = library.encode_ordinary(t or "")
        assert got[i].ids == want, i
        assert bytes(got[i].id_bytes) == b"".join(x.to_bytes(4, "little") for x in want)
        assert bytes(got[i].decoded) == (t or "").encode()


def test_fold_and_heap_equal_the_library(spark, library):
    """Ties are leftmost; the heap merges any word as the fold does."""
    words = ["aaaaaaa", "thethethe", "mississippi", " theatre", "漢字仮名交じり文", "é", "x", "abababab" * 9 + "aaaaabbbbb" * 4, "=" * 77]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in df.select("word", bpe.fold(F.col("word"), RANKS).alias("ids")).collect()}
    want = {w: library._core_bpe.encode_single_piece(w.encode()) for w in words}
    assert got == want and {w: bpe.merge_long(w.encode(), RANKS) for w in words} == want
    for w in ["漢字仮名交じり文" * 4000, "ab" * 20_001, "-" * 30_000 + "=" * 7]:
        assert bpe.merge_long(w.encode(), RANKS) == library._core_bpe.encode_single_piece(w.encode())


def test_merges_where_one_place_at_a_time_differs(spark):
    """A made vocabulary in which merging all places at once would be wrong, words on both sides of ``LONG_BYTES``."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"aba": 256, b"bc": 301, b"xx": 302, b"xxx": 257, b"abab": 303, b"cab": 258}
    enc = tiktoken.Encoding("made", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["ab" * 400, "abc" * 300, "x" * 701, "xxabxabab" * 120, "cabab" * 11, "abab", "xxx", "babcab", "x" * 127, "x" * 128, "x" * 129]
    got = {r.doc_id: r.ids for r in bpe.encode(documents(spark, list(enumerate(texts))), ranks, r"\S+|\s+").collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_words_are_cut_as_the_library_cuts_them(library):
    import regex
    find = regex.compile(P.PATTERN).findall
    for start in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} ," for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        want = [i for w in find(text) for i in library._core_bpe.encode_single_piece(w.encode())]
        if library.encode_ordinary(text) != want:
            assert False, [hex(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000 and library.encode_ordinary(t := f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} ,")
                           != [i for w in find(t) for i in library._core_bpe.encode_single_piece(w.encode())]][:20]


def test_slices_share_words_and_a_text_of_a_megabyte(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 300)
    monkeypatch.setattr(bpe.learn_common, "__defaults__", (3, 40))
    rows = [r for r in odd_rows() if r[0] not in (None, 30)] + [(900, "漢字かな" * 90_000 + " word" * 1000)]
    docs = documents(spark, rows).coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, P.PATTERN).collect()}
        assert bpe.split(docs, RANKS, P.PATTERN, []).select("slice").distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: library.encode_ordinary(t or "") for i, t, *_ in rows}


def test_empty_table_and_repeated_rows(spark):
    assert bpe.encode(documents(spark), RANKS, P.PATTERN).count() == 0
    rows = [r for r in odd_rows() if r[0] in (None, 30)]
    got = bpe.encode(documents(spark, rows), RANKS, P.PATTERN).collect()
    assert len(got) == 4 and sorted((r.doc_id is not None, bytes(r.decoded)) for r in got) == sorted((d is not None, t.encode()) for d, t in rows)


def test_words_travel_in_packets_and_documents_stay_where_they_are(spark, library):
    """The documents are read in buckets of their slices, ids come back packed, and no plan holds the rank map."""
    rows = [(i, f"word{i % 7} zqx{i} \x00 a\x00b vwk{i % 11}") for i in range(300)]
    docs = documents(spark, rows).coalesce(2)
    coded = bpe.encode(docs, RANKS, P.PATTERN)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Exchange")[0]
    assert "Bucketed: true" in left and left.count("FileScan") == 1
    assert len(plan) < 100_000 and plan.count("ranks#") == 1      # only the subquery reads the map, no row carries it
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: library.encode_ordinary(t) for i, t in rows}
    parts = bpe.split(docs, RANKS, P.PATTERN, [])
    packets = bpe.word_ids(parts, RANKS)
    words = sum(len(w.split("\x00")) for r in parts.select("packets.words").collect() for w in r.words)
    assert words > 300 and packets.count() <= 2 * packets.rdd.getNumPartitions() and packets.count() < words
