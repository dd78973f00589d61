"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct 64-bit fingerprint emits the variants within half the radius, the variants
are shuffled, and fingerprints that meet at a variant are verified and linked.  For an odd
radius 2h+1 two fingerprints of different parity meet at h and h+1 flips and those of equal
parity at h and h, so only even fingerprints emit the larger ball; for radius 3 its
two-flip variants need only flips in one half of the word, as of three bits two always lie
in the same half.

Cases: null or empty texts and texts without words have fingerprint zero and link like any
other; repeated rows and equal texts share a fingerprint, which emits once; a null ``doc_id``
is never the component id unless the component has no other; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import map_rows, ship, text_bytes, texts
from pricewise.llm.components import components
from pricewise.session import materialize

SHINGLE = 3
RADIUS = 3
#: Fingerprints whose variants are held at once, shingles counted at once, and the
#: bytes of variants that one task of the shuffle gets.
CHUNK = 2_000
COUNTED = 50_000
TASK_BYTES = 24_000_000


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = 42) -> int:
    """Bit i is 1 if it is 1 in over half of the XXH64 values of the word shingles
    (A-Z lower-cased, words joined by one space, a shorter text is one shingle)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [x - 1 for x in starts[size:]] + [len(joined)]
        shingles = [joined[a:b] for a, b in zip(starts, ends)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), COUNTED):
        part = shingles[i:i + COUNTED]
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, part, repeat(seed))), np.uint8)
        ones += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long, one row per document."""
    def run(batch):
        fps = np.array([fingerprint(t, size) for t in text_bytes(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_rows(texts(docs), run, "doc_id long, fp long")


def flips(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(masks sorted by weight, their weights, which of them odd fingerprints emit)."""
    near, far = radius // 2, (radius + 1) // 2
    chosen = []
    for weight in range(far + 1):
        for bits in combinations(range(64), weight):
            if radius == 3 and weight == 2 and bits[0] // 32 != bits[1] // 32:
                continue
            chosen.append((sum(1 << b for b in bits), weight))
    masks = np.array([m for m, _ in chosen], np.uint64)
    weights = np.array([w for _, w in chosen], np.uint8)
    return masks, weights, weights <= near


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


_SLOT = np.dtype([("variant", "<u8"), ("mask", "<u2")])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps`` (fp long) whose components are
    those of all pairs at ``radius`` or fewer differing bits.

    Variants travel packed: one row per chunk and bucket holds 10 bytes a variant (the
    variant and the number of its mask, from which the fingerprint follows).  Of the
    fingerprints that meet at a variant one near it is linked to all others, never all pairs.
    """
    spark = fps.sparkSession
    ship(spark)
    masks, weights, odd_use = flips(radius)
    n = fps.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) * 10 // (2 * TASK_BYTES)))
    buckets = 1 << (4 * tasks - 1).bit_length()
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def emit(batches):
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), CHUNK):
                part = values[i:i + CHUNK]
                odd = popcount(part) & 1 == 1
                slots = np.concatenate([_slots(part[~odd], masks, np.arange(len(masks))),
                                        _slots(part[odd], masks, np.flatnonzero(odd_use))])
                bucket = ((slots["variant"] * mix) >> shift).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                slots, bucket = slots[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                begins, ends = np.r_[0, cuts], np.r_[cuts, len(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins].astype(np.int32)), pa.array([slots[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())],
                    names=["bucket", "slots"])

    def meet(batches):
        held = [np.frombuffer(x, _SLOT) for batch in batches for x in batch.column("slots").to_pylist()]
        if not held:
            return
        slots = np.concatenate(held)
        held.clear()
        slots = slots[np.argsort(slots["variant"], kind="stable")]
        v = slots["variant"]
        again = v[1:] == v[:-1]
        slots = slots[np.r_[again, False] | np.r_[False, again]]
        a, b = _stars(slots, masks, weights, radius)
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return fps.select("fp").repartition(tasks, "fp").mapInArrow(emit, "bucket int, slots binary").repartition(tasks, "bucket") \
        .select("slots").mapInArrow(meet, "a long, b long").distinct()


def _slots(fps: np.ndarray, masks: np.ndarray, use: np.ndarray) -> np.ndarray:
    out = np.empty((len(fps), len(use)), _SLOT)
    out["variant"] = fps[:, None] ^ masks[use][None, :]
    out["mask"] = use.astype("<u2")[None, :]
    return out.ravel()


def _stars(slots: np.ndarray, masks: np.ndarray, weights: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges of the fingerprints that meet: slots of equal variants, sorted."""
    v = slots["variant"].astype(np.uint64)
    if not len(v):
        return v, v
    far = weights[slots["mask"]] > radius // 2
    fp = v ^ masks[slots["mask"]]
    order = np.lexsort((fp, far, v))
    v, far, fp = v[order], far[order], fp[order]
    first = np.r_[True, v[1:] != v[:-1]]
    at = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
    hub = fp[at]
    # Two fingerprints that are both far from a variant meet elsewhere if they are linked.
    good = ~far[at] & (hub != fp) & (popcount(hub ^ fp) <= radius)
    pairs = np.unique(np.stack([hub[good], fp[good]], 1), axis=0) if good.any() else np.empty((0, 2), np.uint64)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that join two trees so far: same components, fewer edges than nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (p := parent.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return a[keep], b[keep]


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): fingerprints linked through any chain share a root (a fingerprint)."""
    distinct = materialize(fps.select("fp").distinct(), "fingerprints")  # small rows: dealt anew before they grow
    found = components(links(distinct, radius))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the
    smallest doc_id that chains of links reach."""
    fps = materialize(fingerprints(docs, size), "simhash")
    roots = materialize(classes(fps, radius), "classes")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    ids = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the row with the
    smallest doc_id (null last; ties: the smallest row hash, then any of equal rows).

    The rows travel as a struct, so no column name can clash; one candidate per task
    and component is left before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)

    def run(batch):
        fps = np.array([fingerprint(t, size) for t in text_bytes(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fps.view(np.int64))], names=["row", "fp"])

    schema = keyed.schema["row"].dataType.simpleString()
    rows = materialize(map_rows(keyed, run, f"row {schema}, fp long"), "simhash-rows")
    roots = materialize(classes(rows.select("fp"), radius), "classes")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row.text"))
    best = rows.join(roots, "fp").groupBy("root").agg(F.min_by("row", order).alias("row"))
    return best.select("row.*")
