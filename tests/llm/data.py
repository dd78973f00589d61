"""Small tables for the operator tests: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=60):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < .3 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows=None, extra=""):
    """``rows``: (doc_id, text) or (doc_id, text, lang); with ``extra`` columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows or []]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra.split():
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit("x"))
    return df


def odd_rows(seed=0):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + "\n" + base[1]), (22, base[1] + "\n" + base[1] + "\n\n" + base[2]),
             (23, None), (24, ""), (25, " \t\n"), (None, base[3]), (30, base[4]), (30, base[4]), (30, base[5]),
             (31, "Éa ñu 漢字 😀 çà x y  it's we'll 123 456é"), (32, "x" * 5000), (33, "a b " * 6000)]
    return rows
