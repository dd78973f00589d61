"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewise.llm import bpe, collocation, decontaminate, langid, lexical, linededup, pii, quality, records, simhash, substrings, warc, webtext
from pricewise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@register
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@register
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("cut.n_lines").cast("long").alias("n_lines"), F.col("cut.n_removed").cast("long").alias("n_removed"),
                        F.col("cut.n_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("cut.text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
owned AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS seen,
         sum(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM lines),
pairs AS (
  SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM owned WHERE seen),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) AS nth FROM pairs WHERE following IS NOT NULL)
  WHERE nth > 1),
gone AS (SELECT doc_id, pos FROM later UNION SELECT doc_id, pos + 1 FROM later),
marked AS (
  SELECT o.*, g.pos IS NOT NULL AS removed FROM owned o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.pos = g.pos),
runs AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, count(*) AS n_lines,
         count(*) FILTER (WHERE removed AND NOT coalesce(before, false)) AS n_runs
  FROM (SELECT doc_id, removed, lag(removed) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM marked WHERE seen)
  GROUP BY doc_id)
SELECT m.doc_id, coalesce(max(r.n_lines), 0)::BIGINT AS n_lines, coalesce(max(r.n_removed), 0)::BIGINT AS n_removed,
       coalesce(max(r.n_runs), 0)::BIGINT AS n_runs,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE NOT m.removed), '')) AS kept_sha256
FROM marked m LEFT JOIN runs r ON m.doc_id = r.doc_id GROUP BY m.doc_id
"""


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register
def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@register
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)))
    return found.select("record_id", "canonical_url", "resolved_id", "state", "payload_digest", F.array_join(lines, "\n").alias("headers"))


ORACLE["op7_warc_revisits"] = r"""
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS html, k FROM pages, (SELECT unnest(range(4)) AS k)),
records AS (
  SELECT page_id * 4 + k AS record_id, (page_id * 7919 + k * 104729) % 1000003 AS ts,
         CASE WHEN k = 0 OR (k = 2 AND page_id % 5 = 0) THEN 'response' ELSE 'revisit' END AS kind,
         k = 1 AND page_id % 11 = 0 AS bare,
         html || CASE WHEN k >= 2 AND page_id % 5 = 0 THEN '<!-- 2 -->' ELSE '' END || CASE WHEN k = 3 AND page_id % 7 = 0 THEN '?' ELSE '' END AS content,
         trim(CASE WHEN k = 1 THEN url || '#part' ELSE url END) AS u
  FROM base),
split AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) AS params
  FROM records),
canonical AS (
  SELECT *, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://')
                 THEN host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END
                 ELSE regexp_replace(u, '#.*$', '') END AS canonical_url
  FROM split),
joined AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.bare, md5(v.content) AS own, r.record_id AS rid, md5(r.content) AS theirs, strlen(r.content) AS size, r.ts AS rts
  FROM (SELECT *, ts * 10000000000 + record_id AS place FROM canonical WHERE kind = 'revisit') v
  ASOF LEFT JOIN (SELECT *, ts * 10000000000 + record_id AS place FROM canonical WHERE kind = 'response') r
  ON v.canonical_url = r.canonical_url AND v.place > r.place),
states AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN bare THEN 'unverified' WHEN own = theirs THEN 'resolved' ELSE 'mismatch' END AS state FROM joined)
SELECT record_id, canonical_url, state,
       CASE WHEN state IN ('resolved', 'unverified') THEN rid END AS resolved_id,
       CASE WHEN state IN ('resolved', 'unverified') THEN theirs END AS payload_digest,
       CASE WHEN state = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/"' || own || '"'
            WHEN state = 'unverified' THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: "' || theirs || '"' END AS headers
FROM states
"""


@register
def op1_pii_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


ORACLE["op5_benchmark_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS pattern
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM iw WHERE len(w) > 0)),
windows AS (
  SELECT row, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS pattern
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, (SELECT DISTINCT size FROM patterns) WHERE len(w) >= size)),
found AS (SELECT row, k, v.size, item_id FROM windows v JOIN patterns p ON v.pattern = p.pattern AND v.size = p.size),
hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(k, k + size)) AS place FROM found) GROUP BY row),
ids AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (row) LEFT JOIN ids USING (row)
"""


@register
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


ORACLE["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, m, phrase, f AS a FROM f WHERE m >= 2),
inside AS (
  SELECT d.lang, d.a, array_to_string(list_slice(string_split(d.phrase, ' '), i, i + k - 1), ' ') AS phrase
  FROM candidates d, (SELECT unnest([2, 2, 2, 3, 3]) AS k, unnest([1, 2, 3, 1, 2]) AS i) WHERE k < d.m AND i + k - 1 <= d.m),
dropped AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inside d ON c.lang = d.lang AND c.phrase = d.phrase WHERE 100 * d.a::HUGEINT >= 80 * c.a::HUGEINT),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS p, array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS q
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) WHERE (lang, phrase) NOT IN (SELECT lang, phrase FROM dropped)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((2000000 * c.a::HUGEINT) // (l.f + r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON c.lang = l.lang AND c.p = l.phrase JOIN f r ON c.lang = r.lang AND c.q = r.phrase),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""


@register
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_ranked_lexical_search"] = r"""
WITH dt AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS len FROM dt WHERE len(w) > 0),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM dt) GROUP BY ALL),
needed AS (SELECT * FROM tf WHERE term IN (SELECT term FROM items)),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM needed GROUP BY term), corpus),
impacts AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // len))) AS impact FROM needed, corpus),
scores AS (
  SELECT i.item_id, p.row, p.doc_id, sum(w.weight * p.impact)::BIGINT AS score
  FROM items i JOIN weights w ON i.term = w.term JOIN impacts p ON i.term = p.term GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@register
def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.main_text(table(spark, sf_dir, "pages"))
