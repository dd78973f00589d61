"""Main text of web pages, by templates deduced from equivalence classes of tokens.

A token is an element in its context (the path of block elements with their classes and ids) or
a whole block of text in such a path.  Its occurrence vector counts it on every page of a host.
Vectors are compared by two sums over pages, of the page's hash times the count, so no page ever has
to meet another: tokens with equal sums form an equivalence class.  A class is valid if it is frequent
and its elements hang on one slot; valid classes nest where that slot belongs to another class.  The
nested classes are the host's template; what lies between its tokens are slots.

The slots that fill with changing prose hold the article: the way down from the root takes the slot with
most of the words that are no template text, until none does.  Slots named or filled like menus, headers, footers, side
bars, notices, adverts, forms and comments are left out, as is text that is the same wherever its
element stands on at least half of the host's pages (as long as the article's slot has other text).
Pages without a host, of hosts with under ``LEAST_PAGES`` pages, or without the host's slot are
judged by their own slots.

Cases: a null or empty html, or one without text, gives an empty text; a null url has no host; broken or cut
markup is read as far as it goes; each row of a repeated page is a page; an empty table gives an empty
result; columns other than page_id, url and html are not read; nothing is cut, however long.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.llm.common import map_rows, ship
from pricewise.session import materialize

LEAST_PAGES = 3          # pages of a host, and of a class
LEAST_SHARE = 0.02       # of the host's pages that a class stands on
FIXED_SHARE = 0.5        # of the host's pages that fixed text stands on
MOST = 0.6               # of a slot's words that the way down follows
LINKED = 0.8             # of a list's words that are links

# HTML elements.
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
          "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "body", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LEAVES = HEADINGS | {"p", "li", "blockquote", "pre", "dt", "dd", "figcaption", "ul", "ol", "dl", "figure", "caption"}
CLUTTER_TAGS = {"head", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "button", "select", "option", "svg", "canvas", "dialog",
                "menu", "fieldset", "object", "audio", "video"}
# Words of class and id names that say what a slot is for.
CLUTTER_WORDS = {"nav", "navbar", "navigation", "menu", "footer", "masthead", "sidebar", "ad", "ads", "advert", "adverts", "advertisement", "banner",
                 "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter",
                 "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus",
                 "respond", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "skip"}
NEGATIONS = {"has", "with", "no", "without", "not"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                    r"""|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[/A-Za-z][^>]*\Z|[^<]+|<""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)|(?:^|\s)style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


@lru_cache(maxsize=65536)
def _signature(tag: str, attributes: str) -> str:
    """An element's part of a path: tag, classes and id; numbers of ids, and of two or more digits in classes, are alike."""
    if not attributes:
        return tag
    names = {k.lower(): references.unescape(v.strip("\"'")) for k, v in _NAMES.findall(attributes)}
    classes = "".join("." + x for x in sorted({re.sub(r"[0-9]{2,}", "0", x) for x in names.get("class", "").lower().split()}))
    ident = "#" + re.sub(r"[0-9]+", "0", "-".join(names["id"].lower().split())) if names.get("id") else ""
    hidden = "~" if _HIDDEN.search(attributes) else ""
    return tag + (classes + ident).replace("/", "-") + hidden


@lru_cache(maxsize=65536)
def is_clutter(part: str) -> bool:
    """Whether an element's tag or names say that it is no article text."""
    tag = re.match(r"[^.#~]*", part).group()
    if part.endswith("~") or tag in CLUTTER_TAGS:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name in re.split(r"[.#~]", part)[1:]:
        words = set(re.split(r"[-_:0]+", name))
        if words & CLUTTER_WORDS and not words & NEGATIONS:
            return True
    return False


def read_page(html: str) -> tuple[list[str], list[tuple[str, str, int]]]:
    """Paths of all block elements, and the blocks of text as (path, text, words in links), in order."""
    elements, blocks = [], []
    stack, path = [], [""]
    held, links, in_link = [], 0, 0

    def flush():
        nonlocal held, links
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            if text:
                blocks.append((path[-1], text, links))
            held, links = [], 0

    def close(n):
        flush()
        del stack[n:], path[n + 1:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        first = m.group()
        name = m.group(2) or m.group(5)
        if not name:
            if first[0] != "<" or first == "<":
                held.append(first)
                if in_link:
                    links += len(first.split())
            continue
        tag, closing, attributes = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag not in INLINE and tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in INLINE:
            in_link += tag == "a"
            continue
        in_link = 0
        if "p" in stack and tag not in INLINE:
            close(len(stack) - 1 - stack[::-1].index("p"))
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in CLOSES.get(tag, ()):
                close(i)
                break
            if stack[i] in SCOPES:
                break
        flush()
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(tag)
        path.append(path[-1] + "/" + _signature(tag, attributes.rstrip("/ \t\r\n")))
        elements.append(path[-1])
    flush()
    return elements, blocks


def clutter_part(path: str, known: str = "") -> bool:
    """Whether an element of the path below ``known`` is clutter.  A page header is, an article's own is not."""
    parts = path[len(known):].split("/")[1:]
    article = any(re.match(r"(?:article|main)\b", p) for p in known.split("/"))
    for p in parts:
        if is_clutter(p) or (not article and re.match(r"header\b", p)):
            return True
        article = article or bool(re.match(r"(?:article|main)\b", p))
    return False


def main_slot(words: dict[str, float], slots: set[str]) -> str:
    """The slot that holds the article: from the root, while one slot has most of the words."""
    inside: dict[str, float] = defaultdict(float)
    for path, n in words.items():
        while path:
            if path in slots:
                inside[path] += n
            path = path.rpartition("/")[0]
    children = defaultdict(list)
    for path in inside:
        up = path.rpartition("/")[0]
        while up and up not in inside:
            up = up.rpartition("/")[0]
        children[up].append(path)
    at, total = "", sum(words.values())
    while True:
        tag = re.match(r"[^.#~]*", at.rpartition("/")[2]).group()
        if tag in ("article", "main"):
            return at
        below = [c for c in children[at] if re.match(r"[^.#~]*", c.rpartition("/")[2]).group() not in LEAVES]
        named = [c for c in below if re.match(r"(?:article|main)\b", c.rpartition("/")[2]) and inside[c] >= 0.3 * total]
        best = max(named or below, key=lambda c: (inside[c], c), default=None)
        if best is None or not total or not named and inside[best] < MOST * total:
            return at
        at, total = best, inside[best]


def _linked(blocks: dict[str, tuple[float, float]]) -> list[str]:
    """Paths whose blocks are nearly all links, headings apart."""
    return [p for p, (n, links) in blocks.items() if n and links >= LINKED * n and re.match(r"[^.#~]*", p.rpartition("/")[2]).group() not in HEADINGS | {"p"}]


def article(html: str, template: tuple[str, set[str], set[str]] | None) -> str:
    """The blocks of the page's main slot.  ``template``: the host's slot, its linked lists, its fixed texts."""
    elements, blocks = read_page(html)
    if template is None or template[0] and template[0] not in elements:
        own: dict[str, list] = defaultdict(lambda: [0, 0])
        for path, text, links in blocks:
            n = len(text.split())
            own[path][0] += n
            own[path][1] += min(n, links)
        slot = main_slot({p: n - k for p, (n, k) in own.items() if not clutter_part(p)}, set(elements))
        template = (slot, set(_linked(own)) - {slot}, set())
    slot, linked, fixed = template
    kept = []
    for path, text, _ in blocks:
        if (path == slot or path.startswith(slot + "/")) and path not in linked and not clutter_part(path, slot) and (not fixed or _text_key(path, text) not in fixed):
            kept.append(text)
    return "\n\n".join(kept)


def _text_key(path: str, text: str) -> str:
    return f"{xxhash.xxh64_hexdigest(path, 7)}{xxhash.xxh64_hexdigest(text, 42)}"


def _host(url):
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


TOKENS = "host string, path string, text string, pages long, sum_a long, sum_b long, n long, words long, links long"


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of every host with the sums that stand for their occurrence vectors, added up within batches:
    elements (text null), text blocks, and a row without a path for the pages themselves."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        held: dict[tuple, list[int]] = {}
        for host, key, html in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            if host is None:
                continue
            a, b = key & 0x3FFFFFFF, (key >> 30) & 0x3FFFFFFF
            counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
            elements, blocks = read_page(html or "")
            counts[None, None][0] = 1
            for path in elements:
                counts[path, None][0] += 1
            for path, text, links in blocks:
                n = len(text.split())
                here = counts[path, _text_key(path, text)]
                here[0] += 1
                here[1] += n
                here[2] += min(n, links)
            for (path, text), (n, words, links) in counts.items():
                sums = held.setdefault((host, path, text), [0] * 6)
                for i, x in enumerate((1, a * n, b * n, n, words, links)):
                    sums[i] += x
        if not held:
            return None
        columns = [*zip(*held)] + [*zip(*held.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 6)], names=[x.split()[0] for x in TOKENS.split(", ")])

    one = pages.select(_host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("key"), F.col("html").cast("string").alias("html"))
    found = map_rows(one, run, TOKENS, column="html")
    sums = [F.sum(c).alias(c) for c in ("pages", "sum_a", "sum_b", "n", "words", "links")]
    return found.groupBy("host", "path", "text").agg(*sums)


def deduce(rows: pd.DataFrame) -> tuple[str, list[str], list[str]] | None:
    """A host's template from its frequent tokens: the article's slot, linked lists, fixed texts.

    Elements with one vector are a class; it is valid if its topmost elements hang on one slot, and nests in the
    class that has this slot.  Elements outside the nest are no slots of their own."""
    pages = int(rows.loc[rows.path.isna(), "pages"].sum())
    elements = rows[rows.path.notna() & rows.text.isna()]
    vector = dict(zip(elements.path, zip(elements.sum_a, elements.sum_b)))
    classes = defaultdict(set)
    for path, v in vector.items():
        classes[v].add(path)
    slots: set[str] = set()
    for members in sorted(classes.values(), key=lambda m: min(p.count("/") for p in m)):
        tops = [p for p in members if p.rpartition("/")[0] not in members]
        hang = {p.rpartition("/")[0] for p in tops}
        if len(hang) == 1 and (hang == {""} or hang <= slots):
            slots |= members
        else:       # not one slot: the elements stand for themselves where they nest
            slots |= {p for p in members if p.rpartition("/")[0] in slots}
    text = rows[rows.text.notna()]
    same = pd.Series([vector.get(p) == (a, b) for p, a, b in zip(text.path, text.sum_a, text.sum_b)], index=text.index, dtype=bool)
    fixed = text[same & (text.pages >= max(LEAST_PAGES, FIXED_SHARE * pages))]
    words: dict[str, float] = dict(zip(elements.path, elements.words - elements.links))
    for path, n, links in zip(fixed.path, fixed.words, fixed.links):
        words[path] = words.get(path, 0) - (n - links)
    open_words = {p: n for p, n in words.items() if n > 0 and not clutter_part(p)}
    changing = bool(open_words)
    if not changing:        # pages that are all alike: their text is the article
        open_words = {p: n for p, n in zip(elements.path, elements.words - elements.links) if n > 0 and not clutter_part(p)}
    slot = main_slot(open_words, slots)
    inside = fixed[[p == slot or p.startswith(slot + "/") for p in fixed.path]] if len(fixed) else fixed
    linked = _linked({p: (n, k) for p, n, k in zip(elements.path, elements.words, elements.links)})
    varied = sum(n for p, n in open_words.items() if p == slot or p.startswith(slot + "/"))
    keep_fixed = not changing or inside.words.sum() > varied
    return slot, sorted(set(linked) - {slot}), [] if keep_fixed else sorted(inside.text)


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, linked, fixed) of every host with enough pages."""
    found = materialize(tokens(pages), "page-tokens")
    hosts = found.filter("path is null").select("host", F.col("pages").alias("of"))
    # the words of an element are those of its text blocks, frequent or not
    words = found.filter("text is not null").groupBy("host", "path").agg(F.sum("words").alias("words"), F.sum("links").alias("links"))
    elements = found.filter("path is not null and text is null").drop("words", "links").join(words, ["host", "path"], "left").na.fill(0, ["words", "links"])
    rows = found.filter("path is null or text is not null").unionByName(elements).join(hosts, "host")
    # a frequent token stands on a share of the pages, so a host has at most (tokens of a page) / share of them
    frequent = rows.filter(F.col("path").isNull() & (F.col("of") >= LEAST_PAGES) | (F.col("pages") >= LEAST_PAGES) & (
        F.col("text").isNull() & (F.col("pages") >= LEAST_SHARE * F.col("of")) | F.col("text").isNotNull() & (F.col("pages") >= FIXED_SHARE * F.col("of"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, linked, fixed = deduce(pdf)
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "slot": [slot], "linked": [linked], "fixed": [fixed]})

    ship(pages.sparkSession)
    return materialize(frequent.groupBy("host").applyInPandas(run, "host string, slot string, linked array<string>, fixed array<string>"), "page-templates")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    known = templates(pages)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, texts = {}, []
        for host, slot, linked, fixed, html in zip(*(batch.column(c).to_pylist() for c in ("host", "slot", "linked", "fixed", "html"))):
            if slot is not None and host not in held:
                held[host] = (slot, set(linked), set(fixed))
            texts.append(article(html or "", held[host] if slot is not None else None))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])

    one = pages.select("page_id", "url", _host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    kind, link = one.schema["page_id"].dataType.simpleString(), one.schema["url"].dataType.simpleString()
    # Spark broadcasts the templates only if their written size is small
    return map_rows(one.join(known, "host", "left"), run, f"page_id {kind}, url {link}, text string, n_chars long", column="html")
