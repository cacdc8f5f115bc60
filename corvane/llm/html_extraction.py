"""Main text of HTML pages by equivalence-class template deduction.

Tokens are start tags with their path (names, classes and ids of the elements around them) and whole text blocks with theirs,
inside an article or not. The occurrence vector of a token over a host's distinct pages is reduced to sums of hashes of (page,
count), which Spark adds up before it shuffles: tokens of one host with equal reductions share their vector and form an
equivalence class. Four steps:

1. Classes of tokens that stand once on a page, on SUPPORT of the pages of a host of LEAST_PAGES or more, are large and frequent.
   Their tokens are ordered by their mean place.
2. A map over the pages holds each class against each page: its tokens must come in their order, and what a class spans must lie
   in another's, hold it, or be apart from it. Classes that fail on more than 1 - SUPPORT of their pages are dropped; the others nest into the
   host's template.
3. The same map measures the slots, what the same innermost template element holds: characters, linked ones, and those that the
   template does not have.
4. A map extracts. A slot of the article or main element, or any slot on pages without one, is text unless its elements are
   chrome (navigation, asides, footers, forms and so on by tag or role; names such as "ad" or "comments" only where they are the whole
   name) or most of its characters are linked. Text tokens of the template are boilerplate; inside the article only in slots that
   hold nothing else on any page, and not if they are most of the article, as on hosts of near copies. On hosts of fewer pages
   each page's own elements are the slots.

Within the article a name such as "header" or "search" removes nothing by itself. A host's template is bounded by the tokens of two average pages.
Templates are broadcast while they are under BROADCAST_BYTES together; beyond that they are joined, with the pages of a host dealt over salts.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in
page order. Defined results: null html is empty and gives an empty text; a null url is a host of its own; equal pages of a host count
once for its template and are extracted each for itself; pages of any length are read whole; an empty table gives an empty
result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, table

SUPPORT, LEAST_PAGES, MOST_LINKED = 0.6, 4, 0.5
BROADCAST_BYTES, SALTED_PAGES = 64 << 20, 2_000
_TAG = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_RAW = frozenset("script style noscript template iframe svg textarea title object canvas math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio".split())
#: A start tag of the key ends an open element of the values, up to the nearest element of _SCOPE.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body article main section aside nav header footer div form table ul ol dl blockquote".split())
_CHROME_TAGS = frozenset("head nav aside footer form button select dialog menu".split())
_CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertisements adbox sponsor sponsored promo promotion nav navbar navigation menu sidebar footer header masthead comment comments commentlist disqus respond cookie cookies consent notice notices banner share sharing social related newsletter subscribe breadcrumb breadcrumbs popup modal login signup search pagination pager toolbar".split())
#: Of these, those that name chrome inside an article too.
_ALWAYS = frozenset("ad ads advert adverts advertisement advertisements adbox sponsored comment comments commentlist disqus cookie cookies consent newsletter breadcrumb breadcrumbs".split())
#: Words that say nothing about an element: a name is chrome if it has a word of chrome and all others are of these.
_NEUTRAL = frozenset("site page main top bottom left right global primary secondary section box bar area wrapper wrap container inner outer block list item items group slot unit widget links form field results thread row col js".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_MAIN = frozenset(("article", "main"))


class Block:
    """Text at a path, with the elements that decide on it and the number of start tags before it."""

    __slots__ = ("text", "path", "chrome", "main", "linked", "after")

    def __init__(self, text: str, path: str, chrome: bool, main: bool, linked: int, after: int):
        self.text, self.path, self.chrome, self.main, self.linked, self.after = text, path, chrome, main, linked, after


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMED.finditer(raw)} if raw else {}


def _names_chrome(name: str, words: frozenset[str]) -> bool:
    parts = set(_PARTS.split(name)) - {""}
    return bool(parts & words) and parts <= words | _NEUTRAL


def parse(page: str) -> tuple[list[Block], list[str]]:
    """The text blocks of a page, and the paths of its block elements in the order of their start tags."""
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, chrome, main
    blocks: list[Block] = []
    paths: list[str] = []
    held: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                _, path, chrome, main = stack[-1]
                blocks.append(Block(text, path, chrome, main, linked, len(paths)))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            held.append(text)
            if links:
                linked += len(text)

    def pop(name: str, scope: frozenset[str] = frozenset()) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                flush()
                del stack[k:]
                return True
            if stack[k][0] in scope:
                return False
        return False

    while (m := _TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            elif name in _BLOCK:
                pop(name)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not (m[3] or "").rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if name == "a":
            links += 1
        if name in _VOID or name not in _BLOCK:
            if name in ("br", "wbr", "img"):
                held.append(" " if name != "wbr" else "")
            if name == "hr":
                flush()
            continue
        flush()
        links = 0
        for old in _ENDS.get(name, ()):
            pop(old, _SCOPE)
        if name not in ("b", "i") and stack[-1][0] == "p":
            pop("p", _SCOPE)
        has = _attributes(m[3])
        names = f"{has.get('class', '')} {has.get('id', '')}".split()
        marks = set(_PARTS.split(" ".join(names)))
        main = stack[-1][3] or name in _MAIN or has.get("role") == "main" or has.get("itemprop") == "articlebody"
        hidden = "hidden" in has or "display:none" in has.get("style", "").replace(" ", "")
        tagged = name in _CHROME_TAGS or has.get("role") in _CHROME_ROLES or (name == "header" and not main)
        called = name not in ("html", "body", "article", "main") and any(_names_chrome(x, _ALWAYS if main else _CHROME_NAMES) for x in names)
        chrome = stack[-1][2] or hidden or tagged or called
        path = f"{stack[-1][1]}/{name}" + "".join(f".{x}" for x in sorted(marks - {""}))
        paths.append(path)
        stack.append((name, path, chrome, main))
    add(page[at:])
    flush()
    return blocks, paths


def _hash(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\n{path}\n{text}") - (1 << 63)


def page_tokens(blocks: list[Block], paths: list[str]) -> list[int]:
    """The tokens of a page in page order."""
    out, k = [], 0
    for b in blocks:
        out += [_hash("element", p) for p in paths[k : b.after]]
        out.append(_hash("text", b.path, b.text))
        k = b.after
    return out + [_hash("element", p) for p in paths[k:]]


_PAGE = 0  # the token that stands once on each page: its count is the host's


def _occurrences(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got: dict[tuple[str, int], list[int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mark = xxhash.xxh64_intdigest(page or "").to_bytes(8, "little")
            where: dict[int, list[int]] = {_PAGE: [0]}
            for place, token in enumerate(page_tokens(*parse(page or ""))):
                where.setdefault(token, []).append(place)
            for token, places in where.items():
                vector = xxhash.xxh64_intdigest(mark + len(places).to_bytes(8, "little"))
                x = got.setdefault((host, token), [0, 0, 0, 0, 0])
                for i, v in enumerate((vector & 0xFFFFFFF, vector >> 28 & 0xFFFFFFF, 1, places[0])):
                    x[i] += v
                x[4] = max(x[4], len(places))
        columns = (pa.array([x[i] for x in got.values()], pa.int64()) for i in range(5))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.string()), pa.array([t for _, t in got], pa.int64()), *columns], ["host", "token", "lo", "hi", "pages", "places", "most"])


def classes(pages: DataFrame) -> DataFrame:
    """(host, classes: arrays of tokens in order, of: pages): the large and frequent classes of hosts of LEAST_PAGES or more. pages: host, html."""
    distinct = pages.groupBy("host", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("same")).agg(F.first("html").alias("html"))
    rows = distinct.select("host", "html").mapInArrow(_occurrences, "host string, token long, lo long, hi long, pages long, places long, most long")
    sums = (F.sum(c).alias(c) for c in ("lo", "hi", "pages", "places"))
    tokens = checkpointed(rows.groupBy("host", "token").agg(*sums, F.max("most").alias("most")))
    hosts = tokens.where((F.col("token") == _PAGE) & (F.col("pages") >= LEAST_PAGES)).select("host", F.col("pages").alias("of"))
    frequent = tokens.where((F.col("token") != _PAGE) & (F.col("most") == 1) & (F.col("pages") >= LEAST_PAGES * SUPPORT)).join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    placed = F.sort_array(F.collect_list(F.struct((F.col("places") / F.col("pages")).alias("place"), "token")))
    one = frequent.groupBy("host", "of", "lo", "hi", "pages").agg(placed.alias("placed"))
    return one.groupBy("host", "of").agg(F.sort_array(F.collect_list("placed.token")).alias("classes"))


def _broken(places: dict[int, int], found: list[list[int]]) -> list[int]:
    """The classes of which the tokens on a page are out of order, or which cross another."""
    bad, spans = [], []
    for k, tokens in enumerate(found):
        mine = [places[t] for t in tokens if t in places]
        if any(x > y for x, y in zip(mine, mine[1:], strict=False)):
            bad.append(k)
        elif len(mine) > 1:
            spans.append((mine[0], -mine[-1], k, mine))
    held: list[tuple[int, list[int]]] = []
    for first, last, k, mine in sorted(spans):
        while held and held[-1][1][-1] < first:
            held.pop()
        if held:  # it must lie in one gap of the class around it
            around = held[-1][1]
            if bisect_left(around, first) != bisect_left(around, -last):
                bad.append(k)
                continue
        held.append((k, mine))
    return bad


def _slot(path: str, elements: set[int]) -> str:
    """The innermost element of a path that the template has; without a template the path itself."""
    if not elements:
        return path
    end = path
    while end and _hash("element", end) not in elements:
        end = end.rpartition("/")[0]
    return end


def _check(batches) -> Iterator[pa.RecordBatch]:
    """(host, kind, key, n, chars, linked): kind 0 counts the pages on which a class is broken; kind 1 measures slots of text that is
    not chrome, n being the characters that no class has."""
    for batch in batches:
        got: dict[tuple[str, int, int], list[int]] = {}
        known: dict[str, tuple[list[list[int]], set[int]]] = {}
        for host, page, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if host not in known:
                lists = found.as_py() or []
                known[host] = lists, {t for x in lists for t in x}
            lists, tokens = known[host]
            if not lists:
                continue
            blocks, paths = parse(page or "")
            places = {t: i for i, t in enumerate(page_tokens(blocks, paths)) if t in tokens}
            for k in _broken(places, lists):
                got.setdefault((host, 0, k), [0, 0, 0])[0] += 1
            for b in blocks:
                if not b.chrome:
                    x = got.setdefault((host, 1, _hash("slot", _slot(b.path, tokens))), [0, 0, 0])
                    x[0] += len(b.text) * (_hash("text", b.path, b.text) not in tokens)
                    x[1] += len(b.text)
                    x[2] += b.linked
        columns = (pa.array([x[i] for x in got.values()], pa.int64()) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in got], pa.string()), pa.array([k for _, k, _ in got], pa.int32()), pa.array([x for _, _, x in got], pa.int64()), *columns], ["host", "kind", "key", "n", "chars", "linked"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template: tokens of the valid classes, links: slots of which most characters are linked, fixed: slots that hold
    text of the template alone). pages: host, html."""
    found = checkpointed(classes(pages))
    measured = with_hosts(pages, found, "classes").mapInArrow(_check, "host string, kind int, key long, n long, chars long, linked long")
    measured = measured.groupBy("host", "kind", "key").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked")))
    broken = measured.where("kind = 0").groupBy("host").agg(F.collect_list(F.struct("key", "n")).alias("broken"))
    keys = lambda when: F.collect_list(F.when(when, F.col("key")))
    slots = measured.where("kind = 1").groupBy("host").agg(keys(F.col("linked") > MOST_LINKED * F.col("chars")).alias("links"), keys(F.col("n") == 0).alias("fixed"))
    both = found.join(broken, "host", "left").join(slots, "host", "left")
    many = F.filter(F.coalesce("broken", F.array().cast("array<struct<key:bigint,n:bigint>>")), lambda x: x["n"] > (1 - SUPPORT) * F.col("of"))
    out = F.transform(many, lambda x: x["key"])
    valid = F.filter("classes", lambda c, i: ~F.array_contains(out, i.cast("long")))
    none = F.array().cast("array<bigint>")
    return both.select("host", F.flatten(valid).alias("template"), F.coalesce("links", none).alias("links"), F.coalesce("fixed", none).alias("fixed"))


def with_hosts(pages: DataFrame, hosts: DataFrame, *columns: str) -> DataFrame:
    """pages (host, ...) with the arrays `columns` of their host: by broadcast while these are small, else with each host's pages dealt over salts."""
    size = hosts.agg(F.sum(sum((F.size(F.flatten(c)) if c == "classes" else F.size(c) for c in columns), F.lit(8)))).first()[0] or 0
    small = hosts.select("host", *columns)
    if 8 * size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(small), "host", "left")
    salts = pages.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SALTED_PAGES).cast("int").alias("salts"))
    dealt = small.join(salts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hot = salts.where("salts > 1")  # few: each has SALTED_PAGES pages or more
    salted = pages.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("html"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return salted.join(dealt.drop("salts"), ["host", "salt"], "left").drop("salt")


def extract(page: str, template: set[int], links: set[int], fixed: set[int]) -> str:
    """The text of a page's slots, less the template's own text."""
    blocks = [b for b in parse(page)[0] if not b.chrome]
    named = [(b, _slot(b.path, template)) for b in blocks]
    slots: dict[str, list[int]] = {}
    for b, slot in named:
        x = slots.setdefault(slot, [0, 0])
        x[0] += b.linked
        x[1] += len(b.text)
    # a host of few pages has no template: the page's own figures
    linked = {s for s, (k, n) in slots.items() if (_hash("slot", s) in links if template else k > MOST_LINKED * n)}
    mine = [(b, slot) for b, slot in named if slot not in linked]
    article = any(b.main for b in blocks)
    if article:
        mine = [(b, slot) for b, slot in mine if b.main]
    own = [b for b, slot in mine if _hash("text", b.path, b.text) not in template or (article and _hash("slot", slot) not in fixed)]
    if article and 2 * sum(len(b.text) for b in own) < sum(len(b.text) for b, _ in mine):
        own = [b for b, _ in mine]
    return "\n".join(b.text for b in own)


def _extract_all(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: dict[str, list[set[int]]] = {}
        out = []
        for k, (host, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if host not in sets:
                sets[host] = [set(batch.column(c)[k].as_py() or ()) for c in (4, 5, 6)]
            out.append(extract(page or "", *sets[host]))
        size = pa.array(np.fromiter(map(len, out), np.int64, len(out)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), size], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    known = checkpointed(templates(rows.select("host", "html")))
    kind = pages.schema[id_col].dataType.simpleString()
    sets = ("template", "links", "fixed")
    both = with_hosts(rows, known, *sets).select("page_id", "url", "host", "html", *sets)
    return both.mapInArrow(_extract_all, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
