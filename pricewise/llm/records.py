"""Token ids in length-delimited binary records.

A record file is a header (magic, bytes per id) and framed sequences, one per document:
length (u64), masked checksum of the length (u32), the ids as little-endian integers, masked
checksum of the ids (u32).  Its index file has one entry per record: whether doc_id is
known, doc_id, offset, number of ids; any record can be read alone by it.  Checksums are CRC-32,
masked by rotation and an offset so that checksums of data that hold checksums stay sound.

Files hold the documents in ascending doc_id order, and are in that order themselves.  Each task
writes under a name of its own attempt, and the manifest, a table that Spark commits, names the
files of the attempts that count: what a lost or repeated attempt left is never read.

Cases: a null or empty text is a record of the end id alone; null doc_ids come first; rows that share
a doc_id are ordered by their text hash and each have a record; an empty table gives a manifest
without rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm.common import ship, slices, text_bytes, texts
from pricewise.session import work_path

MAGIC = b"TOKREC1\n"
HEADER_BYTES = len(MAGIC) + 1
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
#: Words whose ids a worker remembers, and records that are read at once.
CACHED_WORDS = 400_000
READ_RECORDS = 2_000

MANIFEST = "part int, path string, n_docs long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: bytes, at: int = 0) -> bytes:
    """The payload of the frame at ``at``; ValueError if it is damaged."""
    length = data[at:at + 8]
    if len(length) < 8 or int.from_bytes(data[at + 8:at + 12], "little") != masked(length):
        raise ValueError(f"bad record length at {at}")
    end = at + 12 + int.from_bytes(length, "little")
    payload = data[at + 12:end]
    if len(data) < end + 4 or int.from_bytes(data[end:end + 4], "little") != masked(payload):
        raise ValueError(f"bad record data at {at}")
    return payload


def _open(path: str):
    """(file system, path in it) of a folder that all executors share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _alphabet() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_ALPHABET = _alphabet()


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, and that joins nothing across ASCII white
    space nor across the border between an ASCII letter or digit and a final full stop or comma.

    Each distinct word goes to the library once while it is remembered: as its core (A-Z in lower
    case) and its final mark.  A core of letters that normalization leaves as it is is one piece, so
    it goes to the library's model directly, bytes written as its alphabet; any other passes the whole chain.
    """

    def __init__(self, source: str, width: int, cached: int = CACHED_WORDS):
        self.source, self.width, self.cached = source, width, cached
        self.tokenizer = None
        self.words: list[dict[bytes, bytes]] = [{}, {}]
        self.cores: list[dict[bytes, bytes]] = [{}, {}]

    def __reduce__(self):
        return WordEncoder, (self.source, self.width, self.cached)

    def _load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(self.source)
        self.marks = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]

    def _recall(self, memory: list[dict], wanted: set[bytes]) -> set[bytes]:
        """What ``memory`` (this generation and the one before) lacks; what is found is in
        the newer one afterwards.  A full generation becomes the old one."""
        if len(memory[0]) + len(wanted) > self.cached:
            memory[:] = [{}, memory[0]]
        new, old = memory
        missing = wanted.difference(new)
        again = {w: old[w] for w in missing if w in old}
        new.update(again)
        return missing.difference(again)

    def _learn(self, cores: list[bytes]) -> None:
        code, model, rest = self.code, self.tokenizer.model, []
        for core in cores:
            if core.isalpha():  # of bytes: ASCII letters only
                piece = core.decode()
            else:
                text = core.decode("utf-8", "replace")
                if not text.isalpha() or text != text.lower() or not is_normalized("NFC", text):
                    rest.append(core)
                    continue
                piece = core.decode("latin-1").translate(_ALPHABET)
            self.cores[0][core] = b"".join([code[t.id] for t in model.tokenize(piece)])
        for i in range(0, len(rest), 5_000):
            part = rest[i:i + 5_000]
            found = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)
            self.cores[0].update((c, b"".join([code[t] for t in x.ids])) for c, x in zip(part, found))

    def _marked(self, text: bytes) -> bool:
        low = text.lower()
        return any(m in low for m in self.marks)

    def __call__(self, data: list[bytes]) -> list[bytes]:
        if self.tokenizer is None:
            self._load()
        whole = {i: t for i, t in enumerate(data) if self._marked(t)}
        texts_words = [() if i in whole else t.split() for i, t in enumerate(data)]
        distinct = set().union(*texts_words)
        missing = self._recall(self.words, distinct)
        split = {}
        for w in missing:
            low = w.lower()
            split[w] = (low[:-1], low[-1:]) if low[-1] in b".," and low[-2:-1].isalnum() else (low, b"")
        new = self._recall(self.cores, {c for pair in split.values() for c in pair if c})
        self._learn(list(new))
        cores = self.cores[0]
        cores[b""] = b""
        self.words[0].update((w, cores[a] + cores[b]) for w, (a, b) in split.items())
        words = self.words[0]
        out = [b"".join(map(words.__getitem__, ws)) for ws in texts_words]
        for i, t in whole.items():
            found = self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False)
            out[i] = b"".join([self.code[x] for x in found.ids])
        return out


def write_records(docs: DataFrame, encoder: Callable[[list[bytes]], list[bytes]], width: int, end_id: int, folder: str) -> DataFrame:
    """Encode, append ``end_id`` and write all documents; the manifest, read back."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(encoder)
    end = end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        out = None
        for batch in batches:
            for part in slices(batch):
                if out is None:
                    system, base = _open(folder)
                    system.create_dir(base)
                    task = TaskContext.get().partitionId()
                    name = f"part-{task:06d}-{uuid.uuid4().hex}"
                    out, index = system.open_output_stream(f"{base}/{name}.rec"), system.open_output_stream(f"{base}/{name}.idx")
                    out.write(MAGIC + bytes([width]))
                    at, docs_n, tokens = HEADER_BYTES, 0, 0
                entries = np.zeros(part.num_rows, ENTRY)
                ids = part.column("doc_id").to_pylist()
                for k, (doc_id, payload) in enumerate(zip(ids, sent.value(text_bytes(part.column("text"))))):
                    framed = frame(payload + end)
                    entries[k] = (doc_id is not None, doc_id or 0, at, len(payload) // width + 1)
                    out.write(framed)
                    at += len(framed)
                index.write(entries.tobytes())
                docs_n += part.num_rows
                tokens += int(entries["n"].sum())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs_n], pa.int64()), pa.array([tokens], pa.int64())],
                                             names=["part", "path", "n_docs", "n_tokens"])

    # Many rows may share a doc_id: the hash lets their range be split too.
    ordered = texts(docs).withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash") \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash").select("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_file(path: str) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(index entries, payloads as little-endian unsigned 32-bit ids) in file order, a bounded
    number of records at a time, each found by its offset and verified."""
    system, base = _open(path)
    with system.open_input_file(f"{base}.idx") as f:
        index = np.frombuffer(f.read(), ENTRY)
    with system.open_input_file(f"{base}.rec") as f:
        head = f.read_at(HEADER_BYTES, 0)
        if head[:-1] != MAGIC:
            raise ValueError(f"{path}: not a record file")
        width = head[-1]
        for i in range(0, len(index), READ_RECORDS):
            part = index[i:i + READ_RECORDS]
            first, last = int(part["offset"][0]), part[-1]
            data = f.read_at(int(last["offset"]) - first + 16 + int(last["n"]) * width, first)
            payloads = [unframe(data, int(o) - first) for o in part["offset"]]
            if any(len(p) != n * width for p, n in zip(payloads, part["n"].tolist())):
                raise ValueError(f"{path}: index and records differ")
            yield part, [np.frombuffer(p, f"<u{width}").astype("<u4").tobytes() for p in payloads]


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every record, read back from the files.  Only the
    manifest, one row per file, comes to the driver, for the ids before each file."""
    ship(spark)
    rows, before = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((r["part"], r["path"], before))
        before += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                for part, payloads in read_file(path):
                    n = part["n"].astype(np.int64)
                    start = at + np.cumsum(n) - n
                    at += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part["doc_id"], mask=part["known"] == 0), pa.array(start), pa.array(n),
                         pa.array([zlib.crc32(p) for p in payloads], pa.int64()), pa.array(payloads, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.createDataFrame(rows, "part int, path string, before long").repartitionByRange(max(1, len(rows)), "part")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def encoder_of(path: str, end_id: int) -> tuple[WordEncoder, int]:
    """The encoder of a tokenizers file and the bytes an id needs."""
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        source = f.read()
    width = 2 if max(Tokenizer.from_str(source).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    return WordEncoder(source, width), width


def tokenized(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as records (by default in a new shared folder) and read them back."""
    spark = docs.sparkSession
    encoder, width = encoder_of(path, end_id)
    return read_records(spark, write_records(docs, encoder, width, end_id, folder or work_path(spark, "records")))
