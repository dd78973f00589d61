"""Personal data: rules, high-recall candidates and boosted trees.

Base spans follow fixed formats and always stay.  Candidate generators propose overlapping spans
of looser formats (obfuscated addresses, numbers with other separators or prefixes); gradient
boosted trees (MLlib) score them by format and context, and per kind a threshold, calibrated on
held-out candidates for precision, selects which are added.

Training is weakly supervised, on the candidates of all documents, equal ones as one row with a weight:
a candidate that is a base span of its kind is positive and one that is not is negative; each positive is repeated in rewritten formats
that the rules do not cover, and beside it stand negatives that only look like its kind (``broken``), all in its own context.  A candidate that already has such a format may be
real and has no label.  Thresholds are calibrated on the rewritten positives, where a kind has them,
as base spans are never added.  Without enough of both labels, nothing of the kind is added.

Cases: a null text is empty; offsets are code points, ends exclusive; repeated rows are treated
alike; an empty table gives an empty result; extra columns are ignored by ``find`` and kept by
``redacted_documents``.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import map_rows, ship, slices, texts

KINDS = ("email", "ip", "card", "phone")

#: Training parameters.
TREES = 40
DEPTH = 5
PRECISION = 0.995
MIN_LABELS = 30
#: Distinct weighted rows of one training partition, and ranges of scores that are added up apart.
PART_ROWS = 50_000
SCORE_RANGES = 1000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

#: Candidates: addresses written out (after a plain " at " only with a written dot), and numbers with any common separator.
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| @ ?|@ | at ", re.I)
_SPELLED_DOT = r" dot | ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?"
_AFTER_WORD = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_SPELLED_DOT})[A-Za-z0-9-]+)+", re.I)
_AFTER_SIGN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_SPELLED_DOT})[A-Za-z0-9-]+)+", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:\+|\(|00)?[0-9](?:(?: \. |\[\.\]|[ ().:/-]{0,2})[0-9])+")
#: Words around a span that hint at a kind.
_CUES = (("email", re.compile(r"mail|contact|write|adress", re.I)), ("ip", re.compile(r"\bip\b|host|server|address", re.I)),
         ("card", re.compile(r"card|visa|credit|payment|iban", re.I)), ("phone", re.compile(r"phone|tel|call|mobile|fax|cell", re.I)))
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then in the order of ``KINDS``."""
    found = []
    if "@" in text:
        upto = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > upto and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                upto = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                found.append((3, *m.span()))
    return [(KINDS[k], a, b) for k, a, b in sorted(found, key=lambda x: (x[1], x[0]))]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the loose formats, each for the kinds that its shape allows."""
    found = set()
    if "@" in text:
        found.update(("email", a, b) for k, a, b in base_spans(text) if k == "email")
    for m in _AT.finditer(text):
        low = m.start()
        while low and text[low - 1] in _LOCAL:
            low -= 1
        domain = (_AFTER_WORD if m.group().lower() == " at " else _AFTER_SIGN).match(text, m.end())
        if low < m.start() and domain:
            found.add(("email", low, domain.end()))
    for m in _NUMBER.finditer(text):
        digits = _DIGITS.sub("", m.group())
        groups = re.findall("[0-9]+", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.add(("card", *m.span()))
        if 7 <= len(digits) <= 15:
            found.add(("phone", *m.span()))
        if len(groups) == 4 and max(map(len, groups)) <= 3 and max(map(int, groups)) <= 255:
            found.add(("ip", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format and context of a candidate."""
    digits = _DIGITS.sub("", span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    parts = [int(g[:4]) for g in re.findall("[0-9]+", span)] or [0]
    labels = re.split(r"[.@ ]+|[(\[{]dot[)\]}]", span.lower().rstrip())
    side = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0
    return [*[float(kind == k) for k in KINDS], float(len(span)), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)),
            float(groups[0]), float(groups[-1]), float(span.count(" ")), float(span.count("-")), float(span.count(".")), float(span.count("(")),
            float(span.count("/") + span.count(":")), float(span[:1] == "+" or span[:2] == "00"), float(bool(digits) and luhn(digits)), float(max(parts) <= 255),
            float("@" in span), float(bool(re.search(r"\bat\b", span, re.I))), float(len(labels[-1])), side(before[-1:]), side(after[:1]),
            float(any(cue.search(before) for k, cue in _CUES if k == kind))]


def rewritten(kind: str, span: str, rng: random.Random) -> list[str]:
    """A positive in formats outside the rules."""
    if kind == "email":
        local, domain = span.split("@", 1)
        return [f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local} at {domain.replace('.', ' dot ')}", f"{local}[at]{domain.replace('.', '[dot]')}",
                f"{local} @ {domain}", f"{local}{{at}}{domain}"]
    digits = _DIGITS.sub("", span)
    if kind == "card":
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [mark.join(fours) for mark in (".", "/", "  ")]
    if kind == "phone":
        last = digits[-10:]
        return [f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"00{digits[:-10]} {last[:3]} {last[3:6]} {last[6:]}",
                f"{last[:3]}.{last[3:6]}.{last[6:]}"] if len(last) == 10 else []
    # another address, too: the sample may hold few networks
    return [mark.join(parts) for parts in (span.split("."), [str(rng.randrange(256)) for _ in range(4)]) for mark in (" . ", "[.]")]


def broken(kind: str, rng: random.Random) -> list[str]:
    """What looks like the kind and is none: prices, numbers out of range, numbers of other groups that pass the check, dates, versions, book and order numbers."""
    n = lambda low, high: rng.randrange(low, high)
    if kind == "email":
        return [f"{n(1, 100)} @ {n(1, 100)}.{n(10, 100)}", f"{n(1, 100)} @ ${n(1, 100)}", f"v{n(1, 9)} @ {n(1, 9)}.{n(0, 9)}.{n(0, 9)}", f"{n(2, 9)}x @ {n(1, 20)}.{n(10, 99)}"]
    if kind == "ip":
        parts = [n(1, 256), n(0, 256), n(0, 256), n(256, 1000)]
        rng.shuffle(parts)
        a, b, c, d = (n(1, 100) for _ in range(4))
        return [mark.join(map(str, parts)) for mark in (".", " . ", "[.]")] + [f"{a}-{b}-{c}-{d}", f"{a}:{b:02}:{c:02}.{d}", f"{a}/{b}/{c}/{d}", f"{a} {b} {c} {d}"]
    if kind == "card":
        def passing(make):
            return next(f for f in iter(make, None) if luhn(_DIGITS.sub("", f)))

        return [passing(lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02} {n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}"),
                passing(lambda: f"{n(100, 1000)}.{n(1000, 10000)}/{n(100, 1000)}.{n(10000, 100000)}"), passing(lambda: f"{n(10 ** 6, 10 ** 7)}/{n(10 ** 6, 10 ** 7)}"),
                passing(lambda: f"{n(10 ** 4, 10 ** 5)}.{n(10 ** 8, 10 ** 9)}"), passing(lambda: f"({n(10 ** 11, 10 ** 12)}):{n(10, 100)}")]
    y, m, d = n(1900, 2100), n(1, 13), n(1, 29)
    return [f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y}", f"{y}{m:02}{d:02}", f"{y}-{m:02}-{d:02} {n(0, 24):02}:{n(0, 60):02}", f"{y}-{y + n(1, 9)}",
            f"978-{n(0, 10)}-{n(10, 100)}-{n(100000, 1000000)}-{n(0, 10)}", str(n(10 ** 6, 10 ** 9)), str(n(10 ** 9, 10 ** 12)), f"{n(1, 30)}.{n(0, 30)}.{n(1000, 100000)}"]


_WRITTEN = {
    "email": re.compile(rf"\S+(?: ?\(at\) ?| ?\[at\] ?| ?\{{at\}} ?| @ ?|@ | at )[A-Za-z0-9-]+(?:(?:\.|{_SPELLED_DOT})[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}( \. |\[\.\])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}"),
    "card": re.compile(r"[0-9]{4}(?:([./]|  )[0-9]{4})(?:\1[0-9]{1,4})+"),
    "phone": re.compile(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|00[0-9]+ [0-9]{3} [0-9]{3} [0-9]{4}"),
}


def loose(kind: str, span: str) -> bool:
    """Whether a span has a format of ``rewritten`` (a card its checksum, too)."""
    return kind in _WRITTEN and bool(_WRITTEN[kind].fullmatch(span)) and (kind != "card" or luhn(_DIGITS.sub("", span))) \
        and (kind != "ip" or all(int(p) <= 255 for p in re.findall("[0-9]+", span)))


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, x, label, held, rewritten, n): how often each labelled candidate stands in the documents, every fourth document held out."""
    ship(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    text = text or ""
                    held = zlib.crc32(str(doc_id).encode()) % 4 == 0
                    rng = random.Random(zlib.crc32(text.encode()) if doc_id is None else doc_id)
                    base = set(base_spans(text))
                    for kind, a, b in base | set(candidates(text)):
                        good = (kind, a, b) in base
                        if not good and any(k == kind and a < e and s < b for k, s, e in base):
                            continue  # part of a positive: neither
                        if not good and loose(kind, text[a:b]):
                            continue  # perhaps a real one: neither
                        forms = [text[a:b]] + (rewritten(kind, text[a:b], rng) if good else [])
                        around = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
                        rows += [(kind, features(kind, f, *around), float(good), held, i > 0) for i, f in enumerate(forms)]
                        if good:
                            rows += [(kind, features(kind, f, *around), 0.0, held, False) for f in broken(kind, rng)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                 pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.bool_()), pa.array([r[4] for r in rows], pa.bool_())],
                names=["kind", "x", "label", "held", "rewritten"])

    found = texts(docs).mapInArrow(label, "kind string, x array<double>, label double, held boolean, rewritten boolean")
    return found.groupBy("kind", "x", "label", "held", "rewritten").agg(F.count("*").alias("n"))


class Trees:
    """Boosted trees as nested tuples, scored with numpy in the tasks."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = sum((w * _walk(t, x) for t, w in zip(self.trees, self.weights)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-2 * margin))


def _walk(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    feature, split, low, high = node
    return np.where(x[:, feature] <= split, _walk(low, x), _walk(high, x))


def parse_tree(debug: str):
    """A tree of MLlib's ``toDebugString``."""
    lines = [x.strip() for x in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node(i: int):
        if lines[i].startswith("Predict"):
            return float(lines[i].split(":")[1]), i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        low, i = node(i + 1)
        high, i = node(i + 1)  # past the Else line
        return (int(m[1]), float(m[2]), low, high), i

    return node(0)[0]


def train(docs: DataFrame, precision: float = PRECISION) -> Trees | None:
    """Boosted trees of the labelled candidates, and per kind the lowest threshold with at least
    ``precision`` among held-out candidates."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    from pricewise.session import materialize
    rows = materialize(labelled(docs), "pii-labels")
    # a row a kind, label and half: a few
    counts = rows.groupBy("kind", "label", "held", "rewritten").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    if min(sum(r["n"] for r in counts if not r["held"] and r["label"] == x) for x in (0.0, 1.0)) < MIN_LABELS:
        return None
    seen = rows.filter("NOT held").select(array_to_vector("x").alias("features"), "label", F.col("n").cast("double").alias("weight"))
    # few rows: one partition spares a job's overhead and fixes the order of sums
    parts = -(-sum(r["rows"] for r in counts if not r["held"]) // PART_ROWS)
    seen = seen.coalesce(1) if parts == 1 else seen.repartition(parts, "features", "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64, weightCol="weight").fit(seen)
    out = Trees([parse_tree(t.toDebugString) for t in model.trees], list(model.treeWeights), {})
    kinds = []
    for kind in KINDS:
        own = [r for r in counts if r["held"] and r["kind"] == kind]
        shown = any(r["rewritten"] for r in own)
        if min(sum(r["n"] for r in own if r["label"] == x and (r["rewritten"] or not x or not shown)) for x in (0.0, 1.0)) >= MIN_LABELS:
            kinds.append((kind, shown))
    if kinds:
        chosen = F.lit(False)
        for kind, shown in kinds:
            chosen = chosen | ((F.col("kind") == kind) & (F.col("rewritten") | (F.col("label") == 0) | F.lit(not shown)))
        out.thresholds = {k: 2.0 for k, _ in kinds} | thresholds(scored(rows.filter(F.col("held") & chosen), out), precision)
    return out


def scored(rows: DataFrame, trees: Trees) -> DataFrame:
    """(kind, score, label, n) of labelled candidates."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = batch.column("x")
            scores = trees.probability(x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(scores, pa.float64()), batch.column("label"), batch.column("n")], names=["kind", "score", "label", "n"])

    return rows.select("kind", "x", "label", "n").mapInArrow(run, "kind string, score double, label double, n long")


def thresholds(rows: DataFrame, precision: float) -> dict[str, float]:
    """``threshold`` of every kind that has one, over weighted scores.  Scores are added up from the highest down within
    ranges, and to each range what stands above it, so no task orders a whole kind."""
    own = rows.groupBy("kind", "score").agg(F.sum(F.col("n") * F.col("label")).alias("good"), F.sum("n").alias("n")).withColumn("range", F.floor(F.col("score") * SCORE_RANGES))
    above = Window.partitionBy("kind").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = own.groupBy("kind", "range").agg(F.sum("good").alias("g"), F.sum("n").alias("m")).select(
        "kind", "range", F.coalesce(F.sum("g").over(above), F.lit(0.0)).alias("good_above"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("n_above"))
    upto = Window.partitionBy("kind", "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = own.join(ranges, ["kind", "range"]).select("kind", "score", (F.sum("good").over(upto) + F.col("good_above")).alias("good"), (F.sum("n").over(upto) + F.col("n_above")).alias("n"))
    least = running.filter((F.col("good") / F.col("n") >= precision) & (F.col("n") >= MIN_LABELS)).groupBy("kind").agg(F.min("score").alias("score"))
    return {r["kind"]: max(r["score"], 0.5) for r in least.collect()}


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """What ``thresholds`` finds for one kind in the tasks, of scores that fit one array: lowest score from which on the share of positives is at least ``precision``; above 1 if
    fewer than ``MIN_LABELS`` are left.  Ties are taken together."""
    best = 2.0
    for t in sorted(set(scores.tolist()), reverse=True):
        chosen = labels[scores >= t]
        if chosen.mean() >= precision and len(chosen) >= MIN_LABELS:
            best = t
    return max(best, 0.5)


def spans(text: str, trees: Trees | None) -> tuple[list, list]:
    """(base spans, added spans): added ones overlap neither base spans nor better added ones."""
    base = base_spans(text)
    if trees is None:
        return base, []
    proposed = [c for c in candidates(text) if c[0] in trees.thresholds and not any(c[1] < e and s < c[2] for _, s, e in base)]
    if not proposed:
        return base, []
    scores = trees.probability(np.array([features(k, text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]) for k, a, b in proposed]))
    added: list[tuple[str, int, int]] = []
    for i in sorted(range(len(proposed)), key=lambda i: (-scores[i], i)):
        k, a, b = proposed[i]
        if scores[i] >= trees.thresholds[k] and not any(a < e and s < b for _, s, e in added):
            added.append(proposed[i])
    return base, added


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))))


def find(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, all spans and the number added."""
    def run(batch):
        rows = [spans(t or "", trees) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
             pa.array([joined(base + added) for base, added in rows], pa.string()), pa.array([len(added) for _, added in rows], pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return map_rows(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """``text`` with every span, overlapping ones together, replaced by its kind in brackets."""
    if not text or not found:
        return text
    out, upto = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= upto:
            out += [text[upto:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
    return "".join(out) + text[upto:]


def redacted_documents(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``docs``, all rows and columns, with the selected spans of ``text`` redacted."""
    at = docs.columns.index("text")

    def run(batch):
        data = [redact(t, sum(spans(t or "", trees), [])) for t in batch.column("text").to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(data, batch.schema.field(at).type))

    return map_rows(docs, run, docs.schema)
