"""Line dedup over a suffix array of line ids, built by distributed prefix doubling.

DataFrame functions only.  Lines with a character other than white space get ids (128-bit
hashes, in the order of their values); a suffix is a position among a document's lines.
Ranks order the suffixes by their first 1, 2, 4, ... lines: each round sorts the distinct
pairs of ranks of the two halves.  Suffixes that are alone with their rank are final and
leave.  The rounds end at depth ``min_lines``, where suffixes of equal rank are a
longest-common-prefix interval of at least that many lines; deeper rounds would only order
suffixes inside an interval.  All of an interval but its first occurrence (by doc_id, then
position) are later copies, and the lines that they cover go: the union of intervals covers
the maximal repeated runs.  With ``long_words``, a later copy of a single line of more words
than that is a run too: depth 1 decides it, so it takes no further round.

Cases: white-space lines take no part; one goes with the line before it.  A null text stays
null, an empty one empty.  Rows that share a doc_id are ordered by their text hash; equal
rows count as one document, so they keep the same lines; a null doc_id comes first.  A very
frequent line is one row per task before any shuffle of sums, and the joins on it can be
split by AQE.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewise.llm.common import texts
from pricewise.session import materialize

MIN_LINES = 2
#: Where single lines are runs too: those of more words than this.
LONG_WORDS = 50

#: Anything but the six ASCII white-space characters.
_VISIBLE = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _visible(text: Column) -> Column:
    """(i, line) of the lines that take part; i counts all lines."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(numbered, lambda x: x.line.rlike(_VISIBLE))


def _keyed(docs: DataFrame) -> DataFrame:
    """Row key of a document: its doc_id (null as 0 with a flag) and its text's hash."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                                           F.xxhash64("text").alias("hash")))


def _ranked(suffixes: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Shared ranks: one row per distinct ``parts`` that at least two suffixes have, in the
    order of ``parts``, with its rank and its first occurrence."""
    shared = suffixes.groupBy(*parts).agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("first")).filter("n > 1")
    ordered = shared.orderBy(*parts).select(*parts, "first", F.monotonically_increasing_id().alias("rank"))
    return materialize(ordered, name)


def _long(line: Column, words: int) -> Column:
    """Whether a line has more than so many words (and so at least twice as many characters)."""
    return (F.length(line) > 2 * words) & (F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")) > words)


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(key, pos, size): every position whose next ``min_lines`` lines also start earlier, and
    with ``long_words`` every line of more words that stands earlier, as a run of its own."""
    exploded = _keyed(texts(docs)).select("key", F.posexplode(_visible(F.col("text"))).alias("pos", "x")) \
        .select("key", "pos", F.xxhash64("x.line").alias("left"), F.xxhash64(F.lit(1), "x.line").alias("right"),
                *([] if long_words is None else [_long(F.col("x.line"), long_words).alias("long")]))
    suffixes = materialize(exploded, "line-ids")
    ranks = _ranked(suffixes, ["left", "right"], "line-ranks")
    later = lambda found, size: found.filter(F.struct("key", "pos") != F.col("first")).select("key", "pos", F.lit(size).alias("size"))
    singles = None if long_words is None else later(suffixes.filter("long").join(ranks, ["left", "right"]), 1)
    depth = 1
    while True:
        suffixes = suffixes.join(ranks, ["left", "right"]).select("key", "pos", "rank", "first")
        if depth == min_lines:
            break
        step = min(depth, min_lines - depth)
        after = Window.partitionBy("key").orderBy("pos").rangeBetween(step, step)
        suffixes = materialize(suffixes.select("key", "pos", F.col("rank").alias("left"), F.first("rank").over(after).alias("right"))
                               .filter("right IS NOT NULL"), "suffixes")
        ranks = _ranked(suffixes, ["left", "right"], "suffix-ranks")
        depth += step
    runs = later(suffixes, min_lines)
    return runs if singles is None else runs.unionByName(singles)


def _cut(text: Column, starts: Column, min_lines: int) -> Column:
    """Struct of the number of lines that took part and went, the removed runs and the text left."""
    def runs(s):
        n = F.size(s)
        opens = F.filter(s, lambda x, k: (k == 0) | (x > F.get(s, k - 1) + min_lines))
        closes = F.filter(s, lambda x, k: (k == n - 1) | (F.get(s, k + 1) > x + min_lines))
        return F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), (b + min_lines).alias("b")))

    def left(lines, seen, r):
        line_of = lambda k: F.coalesce(F.get(seen, k), F.size(lines))
        # what stays: before the first run, and from the end of each run to the next one
        begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(line_of(F.get(r, k - 1).b))
        end = lambda k: F.when(k == F.size(r), F.size(lines)).otherwise(line_of(F.get(r, k).a))
        pieces = F.transform(F.sequence(F.lit(0), F.size(r)), lambda k: F.slice(lines, begin(k) + 1, end(k) - begin(k)))
        return F.struct(F.size(seen).alias("n_lines"), F.size(r).alias("n_runs"),
                        F.aggregate(r, F.lit(0), lambda t, x: t + x.b - x.a).alias("n_removed"),
                        F.array_join(F.flatten(pieces), "\n").alias("text"))

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return let(_lines(text), lambda lines: let(F.transform(_visible(text), lambda x: x.i),
                                               lambda seen: let(runs(F.array_sort(starts)), lambda r: left(lines, seen, r))))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, and ``cut``: n_lines, n_removed, n_runs and
    the text left (null for a null text)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row))
    found = repeated_runs(docs, min_lines, long_words)
    if long_words is not None and min_lines > 1:  # runs of two sizes: every line that they cover starts a run of one
        found = found.select("key", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos"))
        min_lines = 1
    starts = found.groupBy("key").agg(F.collect_set("pos").alias("starts"))
    joined = whole.join(starts, "key", "left")
    return joined.select("row", _cut(F.col("text"), F.coalesce("starts", F.array().cast("array<int>")), min_lines).alias("cut"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs``, all rows and columns, without later copies; ``n_chars``, if there is one,
    follows the text."""
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("cut.text")).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut.n_removed") > 0, F.length("cut.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return dedup(docs, min_lines, long_words).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
