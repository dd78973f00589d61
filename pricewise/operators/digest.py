"""Sums and digests of gap-filled panels, a series at a time inside its task.

A panel row's text is ``date|idx|iso week|iso year|simple week|year|observed price|filled price`` (prices as whole ten thousandths,
``-`` for no observation); a series' digest adds up the first 8 hex digits of the md5 of its rows' texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewise.functions import columns as C
from pricewise.operators import panel
from pricewise.operators.forecast import _arrow_rows, _per_series, dense_values

_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint64).astype(np.uint32)
LANES = 8_192           # texts hashed together: their state stays in the processor's cache


def md5_starts(blocks: np.ndarray) -> np.ndarray:
    """The first 8 hex digits, as a number, of the md5 of texts that fill one padded block of 64 bytes each."""
    out = np.empty(len(blocks), np.int64)
    for k in range(0, len(blocks), LANES):
        m = np.ascontiguousarray(blocks[k:k + LANES].view("<u4").T)
        a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            turn = i // 16
            if turn == 0:           # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif turn == 1:         # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += m[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
            f += _SINES[i]
            s = np.uint32(_SHIFTS[turn][i % 4])
            np.right_shift(f, np.uint32(32) - s, out=g)
            f <<= s
            f |= g
            f += b
            a, b, c, d, f = d, f, b, c, a
        a += np.uint32(0x67452301)
        out[k:k + LANES] = a.byteswap()
    return out


def _one(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


class Texts:
    """The texts of the rows of a calendar, up to the observed price."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.lengths = np.array([len(x) + 2 for x in labels])
        self.bytes = np.zeros((len(labels), 64), np.uint8)
        for i, x in enumerate(labels):
            self.bytes[i, :len(x) + 2] = np.frombuffer(f"{x}-|".encode(), np.uint8)

    def unobserved(self, row: np.ndarray, price: np.ndarray) -> np.ndarray:
        """Hashes of rows without an observation and the filled price ``price``."""
        out = np.empty(len(row), np.int64)
        digits = np.searchsorted(10 ** np.arange(1, 19), price, side="right") + 1
        plain = (price >= 0) & (price < 10 ** 18) & (self.lengths[row] + digits <= 55)
        for i in np.flatnonzero(~plain):
            out[i] = _one(f"{self.labels[row[i]]}-|{price[i]}")
        kind = np.where(plain, self.lengths[row] * 32 + digits, -1)
        for k in np.unique(kind[plain]):
            some = np.flatnonzero(kind == k)
            at, n = divmod(int(k), 32)
            text, rest = self.bytes[row[some]], price[some]
            for j in range(at + n - 1, at - 1, -1):
                rest, digit = np.divmod(rest, 10)
                text[:, j] = digit + 48
            text[:, at + n] = 128
            bits = 8 * (at + n)
            text[:, 56], text[:, 57] = bits % 256, bits // 256
            out[some] = md5_starts(text)
        return out


def panel_summary(obs: DataFrame, keys: list[str], step: str, value: str, span: tuple, t: str = "t") -> DataFrame:
    """Every series of ``filled_panel`` over ``span`` with its length, span, sums over all its periods in order of time and a digest of its
    rows.  Series are filled and hashed in their task: no panel row is made, every row counts."""
    rows = _per_series(obs, keys, value, C.period_index(t, step))
    cal = panel.calendar(obs, step, t, span).orderBy("t").collect() if span[0] is not None else []      # one row a period
    texts = [f"{r['t']}|{r['idx']}|{r['iso_week']}|{r['iso_year']}|{r['simple_week']}|{r['year']}|" for r in cal]
    labels = sum(r["iso_week"] + r["iso_year"] + r["simple_week"] + r["year"] for r in cal)
    lo, hi = (cal[0]["idx"], cal[-1]["idx"]) if cal else (0, 0)
    weights = np.array([r["idx"] % 7 for r in cal])
    empty = sum(_one(f"{x}-") for x in texts)
    held = []

    def fit(series):
        if not held:
            held.append(Texts(texts))
        out = [[(len(texts), 0, None, None, None, None, labels, empty)] for _ in series]
        some = [i for i, (at, _) in enumerate(series) if len(at)]
        for k in range(0, len(some), 16):
            part = some[k:k + 16]
            v = np.stack([dense_values(*series[i], lo, hi) for i in part])
            whole = np.floor(v * 10_000).astype(np.int64)
            free = np.ones(v.shape, bool)
            for r, i in enumerate(part):
                free[r, series[i][0] - lo] = False
            which, row = np.nonzero(free)
            # (sums of whole numbers below 2^53 are exact in any order)
            digests = np.bincount(which, held[0].unobserved(row, whole[free]).astype(float), minlength=len(part))
            total, by_idx = v.cumsum(axis=1)[:, -1], (v * weights).cumsum(axis=1)[:, -1]
            for r, i in enumerate(part):
                at = series[i][0] - lo
                seen = sum(_one(f"{texts[p]}{whole[r, p]}|{whole[r, p]}") for p in at)
                out[i] = [(len(texts), len(at), float(v[r].min()), float(v[r].max()), float(total[r]), float(by_idx[r]), labels, int(digests[r]) + seen)]
        return out

    long, double = T.LongType(), T.DoubleType()
    fields = [("n", long), ("n_observed", long), ("lowest", double), ("highest", double), ("total", double), ("by_idx", double), ("labels", long), ("digest", long)]
    found = _arrow_rows(rows, keys, fit, [T.StructField(n, k) for n, k in fields])
    return found.select(*keys, "n", "n_observed", F.lit(span[0]).cast("date").alias("t_first"), F.lit(span[1]).cast("date").alias("t_last"), "lowest", "highest",
                        F.round("total", 2).alias("total"), F.round("by_idx", 2).alias("by_idx"), "labels", "digest")
