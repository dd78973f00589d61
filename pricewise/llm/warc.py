"""WARC: resolution of not-modified revisits.

A revisit says that a URL still had the content of an earlier capture.  It is joined as of its
time to the latest earlier full response of the same canonical URL, the validators of both
are compared, and the headers a not-modified answer may update are merged into the response's.

The as-of join is a scan over sorted ranges: records are range-partitioned by (URL, time, id), so
one URL may fill many partitions; each takes the last response inside it, and the last response
of earlier ranges of that URL is carried over from one small row per URL and range.

Cases: a null URL or time resolves nothing (``no_response``); records of equal time go by id;
a null id sorts first; repeated rows are each resolved; header names are compared without case
(of names that differ in case only, the first in sorted order counts), null headers are none; an empty table gives an empty result.
States: ``resolved`` (a validator agrees, none differs), ``mismatch`` (one differs),
``unverified`` (none is on both sides), ``no_response``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewise.session import materialize

#: Headers of a stored response that a 304 answer may update (fixed values).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, ``www.``, default port, final slashes and
    fragment; the host in lower case, parameters sorted, without ``utm_`` ones."""
    u = F.trim(url)
    head = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(u, head + r"([^/?#]*)", 1))
    for part in (r"^[^@]*@", r":(80|443)$", r"^www\."):
        host = F.regexp_replace(host, part, "")
    path = F.regexp_replace(F.regexp_extract(u, head + r"[^/?#]*([^?#]*)", 1), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"),
                                   lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(u.rlike(head), F.concat(host, path, query)).otherwise(F.regexp_replace(u, "#.*$", ""))


def lower_names(headers: Column) -> Column:
    """Entries (key in lower case, value), the first of each name in the order of spellings."""
    entries = F.coalesce(F.array_sort(F.map_entries(headers)), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    return F.filter(low, lambda e, i: F.array_position(F.transform(low, lambda x: x.key), e.key) == i + 1)


def _header(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e.key == name), F.lit(0))["value"]


def _agree(a: Column, b: Column) -> Column:
    """True or false where both sides have the validator, else null."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records``: record_id, url, ts, kind ('response' or 'revisit'), payload_digest, headers
    (map).  One row per revisit: record_id, canonical_url, resolved_id, state, payload_digest
    and headers (the merged map) of the response it stands for."""
    entries = lower_names(F.col("headers"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "payload_digest", entries.alias("entries"))
    revisit = F.col("kind") == "revisit"
    lost = rows.filter(revisit & (F.col("canonical_url").isNull() | F.col("ts").isNull())) \
        .select("record_id", "canonical_url", "payload_digest", "entries", F.lit(None).cast("struct<at:struct<ts:bigint,id:bigint>,digest:string,entries:array<struct<key:string,value:string>>>").alias("found"))
    at = F.struct(F.col("ts").cast("long").alias("ts"), F.col("record_id").cast("long").alias("id"))
    response = F.when(F.col("kind") == "response", F.struct(at.alias("at"), F.col("payload_digest").alias("digest"), F.col("entries").alias("entries")))
    events = rows.filter("canonical_url IS NOT NULL AND ts IS NOT NULL AND kind IN ('response', 'revisit')") \
        .withColumns({"at": at, "response": response}) \
        .repartitionByRange("canonical_url", "at").withColumn("range", F.spark_partition_id())
    events = materialize(events.drop("ts"), "captures")

    inside = Window.partitionBy("canonical_url", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    latest = events.filter("response IS NOT NULL").groupBy("canonical_url", "range").agg(F.max_by("response", "at").alias("last"))
    ranges = events.select("canonical_url", "range").distinct().join(latest, ["canonical_url", "range"], "left")
    carried = ranges.select("canonical_url", "range", F.last("last", ignorenulls=True).over(across).alias("carried"))
    found = events.withColumn("near", F.last("response", ignorenulls=True).over(inside)).filter(revisit) \
        .join(carried, ["canonical_url", "range"], "left") \
        .select("record_id", "canonical_url", "payload_digest", "entries", F.coalesce("near", "carried").alias("found"))

    own, theirs = F.col("entries"), F.col("found.entries")
    weak = lambda e: F.regexp_replace(_header(e, "etag"), "^W/", "")
    checks = F.filter(F.array(_agree(F.col("payload_digest"), F.col("found.digest")), _agree(weak(own), weak(theirs)),
                              _agree(_header(own, "last-modified"), _header(theirs, "last-modified"))), lambda x: x.isNotNull())
    state = F.when(F.col("found").isNull(), "no_response").when(F.exists(checks, lambda x: ~x), "mismatch") \
        .when(F.size(checks) > 0, "resolved").otherwise("unverified")
    update = F.filter(own, lambda e: e.key.isin(PERMITTED))
    stay = F.filter(theirs, lambda e: ~F.exists(update, lambda x: x.key == e.key))
    merged = F.map_from_entries(F.concat(stay, update))
    usable = F.col("state").isin("resolved", "unverified")
    return found.unionByName(lost).withColumn("state", state) \
        .select("record_id", "canonical_url", F.when(usable, F.col("found.at.id")).alias("resolved_id"), "state",
                F.when(usable, F.col("found.digest")).alias("payload_digest"), F.when(usable, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records derived from raw pages: per page a response and three later or
    earlier captures of the same URL, written differently; some pages change (a second
    response), some revisits carry another validator or none."""
    page, k = F.col("page_id"), F.col("k")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    changed = (k == 2) & (page % 5 == 0)
    # From k = 2 on a changed page's content differs; every seventh last revisit has a stale validator.
    content = F.concat("html", F.when((k >= 2) & (page % 5 == 0), "<!-- 2 -->").otherwise(""), F.when((k == 3) & (page % 7 == 0), "?").otherwise(""))
    digest = F.md5(content)
    kind = F.when((k == 0) | changed, "response").otherwise("revisit")
    ts = (page * 7919 + k * 104729) % 1000003
    quoted = F.concat(F.lit('"'), digest, F.lit('"'))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(content).cast("string"),
                        F.lit("Date"), ts.cast("string"), F.lit("ETag"), quoted)
    brief = F.create_map(F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"), F.lit("DATE"), ts.cast("string"),
                         F.lit("etag"), F.concat(F.lit("W/"), quoted))
    bare = F.create_map(F.lit("date"), ts.cast("string"))
    none = (k == 1) & (page % 11 == 0)
    url = F.when(k == 1, F.concat("url", F.lit("#part"))).otherwise(F.col("url"))
    return base.select((page * 4 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("kind"),
                       F.when((kind == "response"), digest).alias("payload_digest"),
                       F.when(kind == "response", full).when(none, bare).otherwise(brief).alias("headers"))
