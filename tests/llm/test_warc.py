import random

from pricewise.llm import warc as W
from pyspark.sql import functions as F

SCHEMA = "record_id long, url string, ts long, kind string, payload_digest string, headers map<string,string>, state string"


def brute(records, canonical):
    out = []
    for i, url, ts, kind, digest, headers, _ in records:
        if kind != "revisit":
            continue
        c = canonical[url]
        key = lambda r: (r[2], r[0] is not None, r[0] or 0)
        earlier = [r for r in records if r[3] == "response" and canonical[r[1]] == c and r[2] is not None and ts is not None and key(r) < (ts, i is not None, i or 0)] if c else []
        own = {}
        for k, v in sorted((headers or {}).items()):
            own.setdefault(k.lower(), v)
        if not earlier:
            out.append((i, c, None, "no_response", None, None))
            continue
        r = max(earlier, key=key)
        theirs = {}
        for k, v in sorted((r[5] or {}).items()):
            theirs.setdefault(k.lower(), v)
        weak = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        pairs = [(digest, r[4]), (weak(own), weak(theirs)), (own.get("last-modified"), theirs.get("last-modified"))]
        checks = [a == b for a, b in pairs if a is not None and b is not None]
        state = "mismatch" if not all(checks) else "resolved" if checks else "unverified"
        if state == "mismatch":
            out.append((i, c, None, state, None, None))
        else:
            merged = theirs | {k: v for k, v in own.items() if k in W.PERMITTED}
            out.append((i, c, r[0], state, r[4], tuple(sorted(merged.items()))))
    return sorted(out, key=str)


def test_canonical_urls(spark):
    urls = {"HTTP://User@WWW.Example.com:80/a/b//?z=1&utm_source=q&a=2#frag": "example.com/a/b?a=2&z=1", "https://example.com": "example.com",
            "https://example.com:8443/?": "example.com:8443", "not a url#x": "not a url", "": "", None: None, " https://e.org/p?q#r?s ": "e.org/p?q"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", W.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls


def test_revisits_match_brute_force(spark):
    rng = random.Random(4)
    urls = ["http://a.com/x", "https://www.A.com/x/#y", "http://b.org/?q=1&p=2", "http://b.org/?p=2&q=1&utm_medium=z", "http://hot.net/", None]
    records = []
    for i in range(400):
        url = rng.choice(urls + ["http://hot.net/"] * 6)
        response = rng.random() < .3
        headers = {"ETag": f'"{rng.randrange(3)}"', "Date": str(i), "Content-Type": "t", "CACHE-control": str(i)}
        if not response:
            headers["ETag"] = "W/" + headers["ETag"]
        for name in rng.sample(list(headers), rng.randrange(3)):
            del headers[name]
        if rng.random() < .2:
            headers |= {"Last-Modified": str(rng.randrange(2)), "last-modified": "second"}
        records.append((None if i == 7 else i, url, None if i % 50 == 9 else rng.randrange(120), "response" if response else "revisit",
                        str(rng.randrange(2)) if rng.random() < .3 else None, None if i % 40 == 1 else headers, "clash"))
    records += [records[20], (900, "http://a.com/x", 5, "request", None, {}, "x")]
    df = spark.createDataFrame(records, SCHEMA)
    canonical = {r.url: r.c for r in df.select("url", W.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    got = W.resolve_revisits(df.repartition(5)).collect()
    assert sorted(((*r[:5], None if r.headers is None else tuple(sorted(r.headers.items()))) for r in got), key=str) == brute(records, canonical)
    assert {r.state for r in got} == {"resolved", "mismatch", "unverified", "no_response"}


def test_one_url_over_many_ranges_and_empty_table(spark):
    records = [(0, "http://h.com/", 0, "response", "d", {"a": "1"}, "")] + [(i, "http://h.com/", i, "revisit", "d", {"date": str(i)}, "") for i in range(1, 3000)]
    records += [(5000, "http://h.com/", 2500, "response", "d", {}, "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r.resolved_id for r in W.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {i: 0 if i <= 2500 else 5000 for i in range(1, 3000)}
    assert W.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.resolve_revisits(W.captures(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string"))).count() == 3
