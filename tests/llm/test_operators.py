"""The ten operators against plain versions, and on odd tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontamination as D
from corvane.llm import html_extraction as X
from corvane.llm import license_scan as L
from corvane.llm import near_dedup as N
from corvane.llm import packing as P
from corvane.llm import quality_rules as Q
from corvane.llm import sharding as S
from corvane.llm import substring_dedup as B
from corvane.llm import token_counts as C
from corvane.llm import toxicity as T
from corvane.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(WORDS, k=n))
split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
PASSAGE = prose(90, 1)
TEXTS = {
    1: prose(120, 2) + "\n" + PASSAGE, 2: PASSAGE + " " + prose(60, 3), 3: prose(40, 4), 4: None, 5: "", 6: " \n\t ", 7: "x",
    8: prose(30, 5), 9: prose(30, 5), 10: prose(30, 5).replace(split(prose(30, 5))[0], "zzz", 1), 11: ("one two three four five six seven eight\n" * 9).strip(),
    12: "wörter ünd ###$$$ größe " * 12, 13: prose(9000, 6), 14: PASSAGE.replace(" ", "\n  "), 15: "a" * 5000, 16: "<|endoftext|> Ünïcode 日本 don't 42 a_b",
}
ROWS = [(k, t, "en", len(t or "")) for k, t in TEXTS.items()] + [(3, TEXTS[3], "en", 0), (None, TEXTS[2], None, None)]
SCHEMA = "doc_id long, text string, lang string, n_words long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_substrings(rows, window=50):
    least = {}
    order = lambda k: 2**63 - 1 if k is None else k
    for k, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, 2**63), order(k))
    out = []
    for k, t, *_ in rows:
        w = split(t)
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < order(k) for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(odd, none):
    got = B.dedup_substrings(odd)
    assert "lang" in got.columns and got.columns.count("n_words") == 1
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == plain_substrings(ROWS)
    assert {r.doc_id: r.kept_text for r in rows}[5] == "" and {r.doc_id: r.n_removed for r in rows}[2] == 90
    assert B.dedup_substrings(none).count() == 0


def test_passages_that_many_documents_share(spark, monkeypatch):
    same = "ring " * 70
    rows = [(k, " ".join((prose(30, 900 + k), PASSAGE, same if k % 3 else "", prose(20, 2000 + k))), "en", 0) for k in range(20, 320)]
    rows += [(None, PASSAGE, "en", 0), (20, PASSAGE, "en", 0), (7, prose(200, 7), "en", 0)]
    real, seen = B._hot_answers, []
    monkeypatch.setattr(B, "_hot_answers", lambda found: seen.append(found) or real(found))
    got = B.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == plain_substrings(rows)
    assert seen[0].groupBy("digest").count().where("count > 1").count() > 0


def test_equal_hashes_are_told_apart():
    same = lambda i, j, k: False
    same.text = lambda i: ["a", "b", "a"][i]
    assert B._least_ids(np.array([7, 7, 7], np.uint64), np.array([5, 3, 9]), np.arange(3) * 10, same).tolist() == [5, 3, 5]


def plain_quality(text):
    w = split(text)
    n = len(w)

    def cover(k):
        c = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        return {j for i in range(n - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}

    chars = sum(map(len, w))
    lines = [x for x in (text or "").split("\n") if split(x)]
    count = Counter(lines)
    repeat = len(cover(8))
    failed = n < 20 or 100 * repeat > 30 * n
    dup = {k: sum(len(w[i]) for i in cover(k)) for k in Q.GRAMS}
    line_chars = sum(k * len("".join(split(x))) for x, k in count.items() if k > 1)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    bad = failed or 100 * symbols > 10 * n or 100 * line_chars > 30 * chars or any(100 * dup[k] > s * chars for k, s in Q.GRAMS.items())
    return (n, chars, symbols, sum(k - 1 for k in count.values()), repeat, failed, not bad)


def test_quality_rules(odd, none):
    got = Q.quality(odd).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=repr) == sorted(((k, *plain_quality(t)) for k, t, *_ in ROWS), key=repr)
    assert {r.doc_id for r in got if r.kept} >= {1, 2, 3, 8, 13} and not {11, 12} & {r.doc_id for r in got if r.kept}
    assert Q.quality(none).count() == 0


def test_near_duplicates(spark, odd, none):
    base = split(prose(120, 20))
    near = [(100 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :]), "en", 0) for i in (3, 50, 90)]
    far = [(200, " ".join(base[:60]) + " " + prose(60, 21), "en", 0)]
    docs = odd.union(spark.createDataFrame([*near, *far], SCHEMA))
    rows = N.near_duplicates(docs).collect()
    of = defaultdict(set)
    for r in rows:
        of[r.doc_id].add(r.class_id)
    assert all(len(v) == 1 for v in of.values()) and len(rows) == docs.count()
    assert of[103] == of[150] == of[190] == {103} and of[200] == {200}
    assert of[9] == {8} and of[4] == {4} and of[5] == {5} and of[6] == {6} and of[None] == {2}
    idf = N.idf_of_words(docs, "text")
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    for (a, x), (b, y) in combinations(texts, 2):
        if x == y or N.similarities([x.encode()], [y.encode()], idf)[0] >= 0.8:
            assert of[a] == of[b], (a, b)
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.class_id for r in rows})
    assert N.near_duplicates(none).count() == 0 and N.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("spokes", [50, 400])
def test_hub_and_spoke_groups_are_whole(spark, spokes):
    base = split(prose(400, 30))
    copies = []
    for k in range(spokes):
        w = list(base)
        for j, i in enumerate(sorted(random.Random(k).sample(range(5, 390, 11), 6))):
            w[i] = f"edit{k}x{j}"
        copies.append(" ".join(w))
    docs = spark.createDataFrame([(k, t, "en", 0) for k, t in enumerate([*copies, " ".join(base)])], SCHEMA)
    idf, hub = N.idf_of_words(docs, "text"), " ".join(base).encode()
    texts = [t.encode() for t in copies]
    assert N.similarities([hub] * spokes, texts, idf).min() >= 0.8 > np.median(N.similarities(texts[1:], texts[:-1], idf))
    assert {r.class_id for r in N.near_duplicates(docs).collect()} == {0}


def test_pairs_planted_in_a_large_template_group_are_found(spark):
    base, rows = split(prose(400, 31)), []
    for k in range(300):
        w = list(base)
        for j, i in enumerate(range(3, 390, 70)):  # the same places in all: each pair shares what none of them edits
            w[i] = f"own{k}x{j}"
        for j, i in enumerate(random.Random(k).sample(range(8, 390, 11), 2)):
            w[i] = f"edit{k}x{j}"
        rows.append(" ".join(w))
    planted = {}
    for k in range(0, 300, 3):
        w = split(rows[k])
        for j, i in enumerate(random.Random(1000 + k).sample(range(8, 390, 11), 4)):
            w[i] = f"copy{k}x{j}"
        planted[1000 + k] = " ".join(w)
    texts = {**dict(enumerate(rows)), **planted}
    docs = spark.createDataFrame([(k, t, "en", 0) for k, t in texts.items()], SCHEMA)
    idf, of = N.idf_of_words(docs, "text"), {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    among = N.similarities([rows[0].encode()] * 299, [t.encode() for t in rows[1:]], idf)
    assert 0.65 < np.median(among) < 0.8
    near = N.similarities([rows[k - 1000].encode() for k in planted], [t.encode() for t in planted.values()], idf)
    assert (near >= 0.8).sum() > 50
    for (k, _), x in zip(planted.items(), near, strict=True):
        assert x < 0.8 or of[k] == of[k - 1000]


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.8, 0.95, 1.0])
def test_few_pairs_at_the_threshold_are_left_unverified(similarity):
    least = N.least_agreeing(similarity)
    tail = lambda k: sum(N.math.comb(64, i) * similarity**i * (1 - similarity) ** (64 - i) for i in range(k))
    assert tail(least) <= N.MISSED and (least == 64 or tail(least + 1) > N.MISSED)
    marks = np.zeros((2, 64), np.uint8)
    marks[1, least:] = 1  # just as many agree
    longs = marks.view(np.int64)
    batch = N.pa.RecordBatch.from_arrays([N.pa.array([b"a"]), N.pa.array([b"b"]), *(N.pa.array(x[i : i + 1]) for x in longs for i in range(8))], [f"c{i}" for i in range(18)])
    assert [b.num_rows for b in N._likely(least)([batch])] == [1]


def test_samples_agree_as_often_as_the_weights():
    a, b = prose(400, 30).split(), prose(400, 31).split()
    x, y = " ".join(a).encode(), " ".join(a[:300] + b[:100]).encode()
    idf = N.NO_IDF
    true = N.similarities([x], [y], idf)[0]
    doc, h, tf = N.shingles([x, y], idf)
    _, signs = N.samples(doc, h, N.weights(h, tf), 2)
    assert abs((signs[0] == signs[1]).mean() - true) < 0.22


def test_html_extraction(spark):
    page = lambda body, k: f"<html><head><title>t{k}</title><script>var a='</p>'</script></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy {k}</div>{body}<div class=x>Our fixed notice</div><footer>&copy; {k}</footer>"
    rows = [(k, "http://h.example/a", page(f"<article><h1>T{k}</h1><p>a &amp; b{k}<br>c\n d<p>e<div class=comments>no</div></article>", k)) for k in range(6)]
    rows += [(k, "http://g.example/a", page(f"<div><p>free {k}</p></div>", k)) for k in range(10, 16)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://h.example/a", "just <b>text</b> &lt;&eacute;"), (0, "http://h.example/a", rows[0][2])]
    got = X.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[2] == "T2\na & b2 c d\ne" and text[20] == text[21] == ""
    assert text[11] == "free 11" and text[22] == "just text <é"
    assert all(r.n_chars == len(r.text) for r in got)
    assert X.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_an_article_element(spark):
    """The template decides: what is the same on a host's pages goes, what differs stays."""

    def page(k, body):
        return f"<html><body><div class=brand>The Daily Thing</div><div class=links><a href=1>One</a> <a href=2>Two {k}</a></div><div class=body>{body}</div><div class=fine>All our pages are free of charge.</div></body>"

    rows = [(k, "http://a.example/x", page(k, f"<h2>Title {k}</h2><p>First text of {k}.<p>Second, <a href=q>see {k}</a> and more words.")) for k in range(8)]
    got = {r.page_id: r.text for r in X.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nFirst text of {k}.\nSecond, see {k} and more words." for k in range(8)}


def test_html_names_inside_an_article_remove_nothing_alone(spark):
    def page(k):
        return f'<body><header>Site {k}</header><article><div class="article-header"><h1>Head {k}</h1></div><section class="search-results"><p>Found {k} things.</p></section><div class=note>Our usual notice: be kind.</div><p>Text {k}</p><div class="comments"><p>I disagree {k}</p></div><ul class=more><li><a href=1>See {k}</a><li><a href=2>And {k}</a></ul></article><aside>Side {k}</aside></body>'

    want = "Head {0}\nFound {0} things.\n{1}Text {0}"
    schema = "page_id long, url string, html string"
    many = X.extract_text(spark.createDataFrame([(k, "http://h.example/", page(k)) for k in range(6)], schema)).collect()
    assert {r.page_id: r.text for r in many} == {k: want.format(k, "") for k in range(6)}  # the notice is the template's
    few = X.extract_text(spark.createDataFrame([(0, "http://h.example/", page(0))], schema)).first()
    assert few.text == want.format(0, "Our usual notice: be kind.\n")


def test_html_of_repeated_and_nearly_equal_pages(spark):
    page = lambda k, t: f"<body><div class=top>Our name</div><p>{t}</p><p>only {k}</p></body>"
    schema = "page_id long, url string, html string"
    rows = [(i, "http://h.example/", page(i % 2, "AB"[i % 2])) for i in range(8)]  # two pages, four times each
    assert {r.text for r in X.extract_text(spark.createDataFrame(rows, schema)).collect()} == {"Our name\nA\nonly 0", "Our name\nB\nonly 1"}
    near = [(i, "http://n.example/", f"<body><article><p>{prose(60, 7)}</p><p>copy {i}</p></article></body>") for i in range(6)]
    assert {r.page_id: r.text for r in X.extract_text(spark.createDataFrame(near, schema)).collect()} == {i: f"{prose(60, 7)}\ncopy {i}" for i in range(6)}


def test_classes_out_of_order_or_crossing_are_found():
    assert X._broken({1: 0, 2: 5, 3: 7}, [[1, 2, 3]]) == []
    assert X._broken({1: 5, 2: 0}, [[1, 2]]) == [0]
    assert X._broken({1: 0, 2: 9, 3: 3, 4: 6}, [[1, 2], [3, 4]]) == []  # nested
    assert X._broken({1: 0, 2: 5, 3: 3, 4: 8}, [[1, 2], [3, 4]]) == [1]  # crossing
    assert X._broken({1: 0, 2: 5, 5: 9, 3: 3, 4: 7}, [[1, 2, 5], [3, 4]]) == [1]  # over two gaps


def test_html_templates_joined_by_salts(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/", f"<body><div class=a>Same</div><p>own {k}</p></body>") for k in range(60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"own {k}" for k in range(60)}
    assert {r.page_id: r.text for r in X.extract_text(d).collect()} == want
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(X, "SALTED_PAGES", 7)
    assert {r.page_id: r.text for r in X.extract_text(d).collect()} == want


def test_html_of_the_tables(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()

    def plain(h):
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        return "\n".join(x for x in (" ".join(entities.unescape(re.sub(r"<(?!/?p>|/?h1>)[^>]*>", " ", y)).split()) for y in re.split(r"</?(?:p|h1)>", body)) if x)

    got = {r.page_id: r.text for r in QUERIES["op4_html_extraction"](spark, DATA).collect()}
    assert got == {p.page_id: plain(p.html) for p in pages}


def test_sharding(odd, none):
    got = S.shard(odd, shards=5).collect()
    assert len(got) == len(ROWS) and {r.law for r in got} == {"key"}
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5) and r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert S.shard(none).count() == 0


def test_sharding_by_weight(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in S.shard(docs, shards=3, weights=[1.0, 1.0, 2.0]).select("shard").collect())
    assert abs(n[2] / 4000 - 0.5) < 0.05


def test_license_scan(spark, odd, none):
    mit = L.TEMPLATES["mit"]
    edited = mit.replace("merge", "mix").replace("sublicense", "lend")
    rows = [(1, prose(50, 40) + " " + mit + " " + prose(50, 41)), (2, edited), (3, "All Rights Reserved. All rights reserved!"), (4, prose(300, 42)), (5, None)]
    got = L.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "mit"), (2, "mit"), (3, "all-rights-reserved"), (3, "all-rights-reserved")]
    assert {r.doc_id: r.coverage for r in got}[1] == 1.0 and 0.95 < {r.doc_id: r.coverage for r in got}[2] < 1
    assert L.licenses(none).count() == 0 and L.licenses(odd).count() == 0


def test_a_long_notice_does_not_give_way_to_a_line_of_it():
    name = next(k for k, t in L.TEMPLATES.items() if "Licensed under the Apache License, Version 2.0" in t and "http:" in t)
    changed = L.TEMPLATES[name].replace("http:", "https:")
    got = {x[1]: x for x in L.Scanner().scan([changed.encode()])}
    assert name in got and 0.9 < got[name][5] < 1


def test_alignment_is_common_and_increasing():
    r = random.Random(3)
    for _ in range(200):
        a, b = [r.randrange(12) for _ in range(r.randrange(20))], [r.randrange(12) for _ in range(r.randrange(20))]
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_decontamination(spark, odd, none):
    items = [(1, prose(30, 50)), (2, prose(18, 51)), (3, None), (4, ""), (5, "three short words"), (2, prose(18, 51))]
    docs = [(1, prose(80, 52) + " " + items[0][1].upper() + " " + prose(20, 53)), (2, prose(200, 54)), (3, items[1][1]), (4, None), (5, "THREE short words"), (6, " ".join(split(items[0][1])[:15]) + " " + prose(60, 55))]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in D.contaminated(d, b).collect())
    assert got == [(1, 1, 80, 1.0), (3, 2, 0, 1.0), (3, 2, 0, 1.0), (5, 5, 0, 1.0)]
    assert sorted(r.doc_id for r in D.drop_contaminated(d, b).collect()) == [2, 4, 6]
    assert D.contaminated(none, b).count() == 0 and D.contaminated(odd, b.limit(0)).count() == 0 and D.drop_contaminated(odd, b.limit(0)).count() == len(ROWS)


def test_index_gives_all_within_the_radius():
    r = np.random.default_rng(5)
    items = D.Items([prose(20, 60 + i).encode() for i in range(600)])
    seen = []
    for i in range(60):
        mark = int(items.print[i]) ^ int(sum(1 << int(b) for b in r.choice(64, D.RADIUS, replace=False)))
        assert set(items.near(mark)) == {i for i in range(600) if bin(int(items.print[i]) ^ mark).count("1") <= D.RADIUS}
        seen.append(len(items.candidates(mark)) / 600)
    assert np.mean(seen) < 0.1  # the blocks choose


def plain_similar(text, item):
    """The largest similarity of any window of the item's size, from the definition alone."""
    fold = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in split(t)]
    w, q = fold(text), fold(item)

    def bag(x):
        runs = [tuple(x[i : i + 5]) for i in range(len(x) - 4)] if len(x) >= 5 else [tuple(x)] if x else []
        out = Counter()
        for s in runs:
            out[s] += sum(map(len, s))
        return out

    n = min(len(q), len(w))
    b, best = bag(q), 0.0
    for i in range(len(w) - n + 1) if n else ():
        a = bag(w[i : i + n])
        shared = sum((a & b).values())
        best = max(best, shared / (sum(a.values()) + sum(b.values()) - shared))
    return best


def test_decontamination_finds_edited_items(spark):
    r = random.Random(9)
    items = [prose(r.choice([3, 4, 5, 9, 14, 15, 20, 30, 45, 60]), 500 + i) for i in range(120)]
    docs = []
    for i in range(240):
        w = split(items[i % 120])
        for _ in range(r.randrange(4)):
            at = r.choice([0, 1, len(w) - 1, r.randrange(len(w))]) % len(w)
            match r.randrange(3):
                case 0:
                    w[at] = r.choice(WORDS).upper()
                case 1:
                    w.insert(at, r.choice(WORDS))
                case _ if len(w) > 2:
                    del w[at]
        docs.append(" ".join([*r.choices(WORDS, k=r.randrange(30)), *w, *r.choices(WORDS, k=r.randrange(30))]))
    want = {(i, j): s for i, t in enumerate(docs) for j, x in enumerate(items) if (s := plain_similar(t, x)) >= D.SIMILARITY - 1e-9}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame([(f"item {j}", x) for j, x in enumerate(items)], "item_id string, text string")
    one = D.contaminated(d, b).collect()
    got = {(x.doc_id, int(x.item_id.split()[1])): x.similarity for x in one}
    assert len(want) > 100 and set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert len(got) >= 0.99 * len(want)
    many = D.contaminated(d, b, block_bytes=2000)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one))
    left = {x.doc_id for x in D.drop_contaminated(d, b).collect()}
    assert left == set(range(240)) - {i for i, _ in got} == {x.doc_id for x in D.drop_contaminated(d, b, block_bytes=2000).collect()}


def test_decontamination_of_the_tables(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet").collect(), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    inside = {(d.doc_id, i.item_id) for d in docs for i in items if f" {' '.join(split(i.text))} ".lower() in f" {' '.join(split(d.text))} ".lower()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_decontamination"](spark, DATA).collect()}
    assert inside <= got


def test_toxicity_on_held_out_rows(spark, odd, none):
    bad = ["vile", "scummy", "dreadful", "rotten"]
    rows, labels = [], []
    for i in range(900):
        r = random.Random(i)
        words = split(prose(40, 1000 + i))
        if toxic := i % 6 == 0:
            for w in r.sample(bad, 2):
                words.insert(r.randrange(40), w.upper() if i % 4 else w + "!")
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3:
            labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(d, lab).collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert held and all(zlib.crc32(str(k).encode()) % 4 == 2 for k in held)
    right = sum(got[k].predicted == (k % 6 == 0) for k in held) / len(held)
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    wide = T.toxicity(odd.unionByName(d.withColumns({"lang": F.lit("x"), "n_words": F.lit(0).cast("long")})), lab)
    assert wide.count() == len(ROWS) + len(rows)
    assert T.toxicity(none, lab).count() == 0 and {r.score for r in T.toxicity(d.limit(5), lab.where("toxic = 0")).collect()} == {0.0}


def test_packing(odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    want = Counter()
    for k, t, *_ in ROWS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[k, i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = P.pack(odd, want_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert P.pack(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_all_and_fit(seed):
    r = random.Random(seed)
    lengths = Counter(min(100, max(1, int(r.lognormvariate(3, 1)))) for _ in range(800))
    patterns = P.plan(dict(lengths), 100)
    used = Counter()
    for content, m in patterns:
        assert sum(k * n for k, n in content.items()) <= 100
        for k, n in content.items():
            used[k] += n * m
    assert used == lengths
    total = sum(k * n for k, n in lengths.items())
    assert sum(m for _, m in patterns) <= -(-total // 100) + 2


def test_plan_takes_exact_complements_first():
    assert sorted((sorted(c.items()), m) for c, m in P.plan({60: 5, 40: 5, 50: 2, 30: 1, 20: 1}, 100)) == [([(20, 1), (30, 1)], 1), ([(40, 1), (60, 1)], 5), ([(50, 2)], 1)]


def test_token_counts(odd, none):
    pieces = C.Pieces(public_tokenizers.path(C.VOCABULARY))
    got = C.token_counts(odd).collect()
    assert sorted(((r.doc_id, r.n_pretokens, r.n_tokens) for r in got), key=repr) == sorted(((k, len(split(t)), sum(pieces.count(C.MARK + w) for w in split(t))) for k, t, *_ in ROWS), key=repr)
    assert C.token_counts(none).count() == 0


def test_oracles(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        rows = c.execute(sql)
        names = [d[0] for d in rows.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, rows.fetchall())), name


def thue_morse(n: int, a: str, b: str, sep: str = "") -> tuple[str, str]:
    """The sequence of two symbols and its complement: equal under any polynomial hash modulo 2**64 from some length on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return sep.join((a, b)[x] for x in bits), sep.join((b, a)[x] for x in bits)


def test_no_text_can_aim_at_the_hashes(spark):
    x, y = thue_morse(2048, "a", "b")
    w = B.Words([f"{x} {y}".encode()])
    assert w.hashes()[0] != w.hashes()[1]
    p, q = thue_morse(2048, "left", "right", " ")
    rows = [(1, f"{x} {y}", "en", 0), (2, p, "en", 0), (3, q, "en", 0), (4, p + " " + q, "en", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = B.dedup_substrings(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_substrings(rows)
    one = B.Words([p.encode(), q.encode()])
    whole = B.grams(one.hashes(), 50)
    marks = B.range_marks(whole, one.of[:2], np.array([1999, 1999]))
    assert marks[0] != marks[1]
    got = Q.quality(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == sorted((k, *plain_quality(t)) for k, t, *_ in rows)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    text = f"{x[:1024]} {y[:1024]}"
    ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
    got = P.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), want_ids=True).orderBy("piece").collect()
    assert [i for r in got for i in r.ids] == ids
    pieces = C.Pieces(public_tokenizers.path(C.VOCABULARY))
    got = C.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_tokens == sum(pieces.count(C.MARK + s) for s in text.split())


def test_names_that_differ_by_capitals_clash(spark):
    docs = spark.createDataFrame([(1, "one two three", 5, "x", 7), (2, None, None, None, None)], "doc_id long, text string, N_WORDS int, __g string, __hash int")
    assert {r.doc_id for r in B.dedup_substrings(docs).collect()} == {1, 2} and "__g" in B.dedup_substrings(docs).columns
    assert [c for c in Q.quality(docs).columns if c.lower() == "n_words"] == ["n_words"]
    got = {r.doc_id: r for r in S.shard(docs.withColumnRenamed("N_WORDS", "SLOT"), shards=3).collect()}
    assert got[1]["__hash"] == 7 and got[1].slot == 0
    with pytest.raises(TypeError):
        B.dedup_substrings(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(60))
def test_licenses_are_found_where_any_stretch_aligns(seed):
    r = random.Random(seed)
    words = [r.randrange(7) for _ in range(r.randint(1, 9))]
    t = L.Template(words)
    text = []
    while len(text) < 60:
        if r.random() < 0.1:
            for w in words:
                text += [w] * (r.random() < 0.95) + [-1] * r.choice([0, 0, 0, 1, 2])
        else:
            text.append(r.choice([-1, -1, -1, r.randrange(7)]))
    got = t.stretches(text)
    passes = lambda a, b: (n := common_length(text[a:b], words)) >= t.need and n >= L.DENSITY * (b - a)
    good = [(a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + t.reach) + 1) if passes(a, b)]
    assert bool(got) == bool(good)
    assert all(common_length(text[a:b], words) >= n >= t.need and n >= L.DENSITY * (b - a) for a, b, n in got)
    # what is left between the stretches holds none
    edges = [0, *(e for x in got for e in x[:2]), len(text)]
    for lo, hi in zip(edges[2::2], edges[3::2], strict=True):
        assert not any(lo <= a and b <= hi for a, b in good)


def test_licenses_with_words_between():
    mit = L.TEMPLATES["mit"].split()
    for extra in ("zz", "the"):
        text = " ".join(x for w in mit for x in (w, extra))
        assert [(x[1], x[5]) for x in L.Scanner().scan([text.encode()])] == [("mit", 1.0)]
    twice = " ".join([*mit, *mit, "x", *mit])
    assert [x[1] for x in L.Scanner().scan([twice.encode()])] == ["mit"] * 3


class PlainWeights:
    """Weighted Jaccard similarity from its definition: words as strings, document frequencies by counting."""

    def __init__(self, texts):
        self.texts = {k: split(t) for k, t in texts.items()}
        n = len(texts)
        df = Counter(w for ws in self.texts.values() for w in set(ws))
        top = np.log(1 + min(n, N.RARE))
        code = {w: round(255 * max(0.0, min(1.0, float(np.log((1 + n) / (1 + k)) / top)))) if k * N.RARE >= n else 255 for w, k in df.items()}
        self.bags, self.total, self.holders = {}, {}, defaultdict(set)
        for k, ws in self.texts.items():
            runs = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])
            self.bags[k] = {s: (1 + float(np.log(c))) * (N.LEAST_IDF + (1 - N.LEAST_IDF) * (sum(code[w] for w in s) // len(s)) / 255) for s, c in runs.items()}
            self.total[k] = sum(self.bags[k].values())
            for s in runs:
                self.holders[s].add(k)

    def links(self, k):
        """The other texts at SIMILARITY or more: all that share a shingle are compared."""
        shared = Counter()
        for s, w in self.bags[k].items():
            for o in self.holders[s]:
                shared[o] += min(w, self.bags[o][s])
        return {o for o, x in shared.items() if o != k and x / (self.total[k] + self.total[o] - x) >= N.SIMILARITY + 1e-9}


def test_no_links_are_lost_near_the_threshold(spark):
    texts = {}
    for g in range(60):
        base = split(prose(200, 5000 + g))
        for k in range(30):
            r = random.Random(g * 100 + k)
            w = list(base)
            for i in r.sample(range(200), r.randint(2, 4)):
                w[i] = r.choice(WORDS)
            texts[g * 30 + k] = " ".join(w)
    plain = PlainWeights(texts)
    of = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame([(k, t, "en", 0) for k, t in texts.items()], SCHEMA)).collect()}
    pairs = [(a, b) for a in texts for b in plain.links(a) if a < b]
    lost = sum(of[a] != of[b] for a, b in pairs)
    assert len(pairs) > 2000 and lost <= 0.001 * len(pairs), (lost, len(pairs))
    for a, c in of.items():  # and a class holds no text without a link
        assert a // 30 == c // 30


def test_near_duplicates_of_the_tables(spark):
    """Every row whose id is divisible by 20 against all rows."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    plain = PlainWeights({r.doc_id: r.text for r in rows})
    of = {r.doc_id: r.class_id for r in QUERIES["op3_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    pairs = [(a, b) for a in of if a % 20 == 0 for b in plain.links(a)]
    assert pairs and all(of[a] == of[b] for a, b in pairs)
    assert all(plain.links(a) for a, c in of.items() if a != c)


@pytest.mark.parametrize("bias", [-3.0, 0.5])
def test_the_risk_and_its_gradient(bias):
    """Against the definition, by finite differences; at the larger bias the bracket is positive, at the smaller one negative."""
    r = np.random.default_rng(4)
    rows = lambda n: [np.flatnonzero(r.random(12) < 0.3).astype(np.int32) for _ in range(n)]
    value, w, prior = r.random(12) + 0.1, r.normal(size=12), 0.4 if bias < 0 else 0.1
    p, u = T.Sparse(rows(30), value), T.Sparse(rows(50) if bias > 0 else rows(20), value)
    if bias < 0:
        w = np.where(np.arange(12) < 6, 4.0, -1.0)

    def plain(w, b):
        l = lambda z: np.log1p(np.exp(-z))  # noqa: E731, E741
        dense = lambda s: np.array([[value[j] if ((s.row == i) & (s.feature == j)).any() else 0 for j in range(12)] for i in range(s.n)]) @ w + b
        gp, gu = dense(p), dense(u)
        return prior * l(gp).mean(), l(-gu).mean() - prior * l(-gp).mean()

    positive, bracket, toward, away = T.risk(p, u, w, bias, prior)
    assert np.allclose((positive, bracket), plain(w, bias))
    for k in range(13):
        step = np.zeros(13)
        step[k] = 1e-5
        hi, lo = plain(w + step[:-1], bias + step[-1]), plain(w - step[:-1], bias - step[-1])
        assert np.allclose([(x - y) / 2e-5 for x, y in zip(hi, lo, strict=True)], [toward[k], away[k]], atol=1e-6)


def test_toxicity_counts_words_over_all_documents(spark):
    """A word of the toxic texts that most other documents have is no feature, however few rows the gradient draws."""
    rows = [(i, f"{'vile ' if i < 40 else ''}common filler w{i}") for i in range(400)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 40)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    vocabulary, w, *_ = T.train(d.toDF("id", "text"), lab.toDF("id", "toxic"))
    of = dict(zip(vocabulary.tolist(), w.tolist(), strict=True))
    h = dict(zip(("vile", "common", "filler"), T.word_hashes([b"vile common filler"])[1].tolist(), strict=True))
    assert of[h["vile"]] > 0 and of.get(h["common"], 0) == 0 == of.get(h["filler"], 0)


def fewest(lengths, capacity):
    """The least number of sequences, by trying all placements."""
    lengths, best, room = sorted(lengths, reverse=True), [len(lengths)], []

    def place(i):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for k in {r: k for k, r in enumerate(room) if r >= lengths[i]}.values():
            room[k] -= lengths[i]
            place(i + 1)
            room[k] += lengths[i]
        room.append(capacity - lengths[i])
        place(i + 1)
        room.pop()

    place(0)
    return best[0]


def test_plans_against_the_optimum():
    r, over = random.Random(1), Counter()
    for _ in range(300):
        capacity = r.choice([10, 20, 30])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 11))]
        patterns = P.plan(dict(Counter(lengths)), capacity)
        assert sum((Counter({k: n * m for k, n in c.items()}) for c, m in patterns), Counter()) == Counter(lengths)
        over[sum(m for _, m in patterns) - fewest(lengths, capacity)] += 1
    assert set(over) <= {0, 1} and over[1] <= 3


@pytest.mark.parametrize("seed", range(20))
def test_the_index_of_sums_misses_no_combination(seed):
    r = random.Random(seed)
    left = np.array([0] + [r.choice([0, 0, 1, 1, 2]) for _ in range(24)])
    sums = P.Sums(left, 24)
    for longest in range(24, 0, -3):  # it falls, as in a plan
        for total in r.sample(range(1, 25), 12):
            has = lambda *x: all(x.count(y) <= left[y] for y in x) and max(x) <= longest  # noqa: E731, B023
            pairs = [(a, total - a) for a in range(1, total) if has(a, total - a)]
            triples = [(a, b, total - a - b) for a in range(1, total) for b in range(1, total - a) if has(a, b, total - a - b)]
            two, three = sums.pair(total, longest), sums.triple(total, longest)
            assert bool(two) == bool(pairs) and (not two or (has(*two) and sum(two) == total))
            assert bool(three) == bool(triples) and (not three or (has(*three) and sum(three) == total))
        at = r.randrange(1, 25)
        left[at] = max(0, left[at] - 1)


def test_pieces_of_tokens_are_kept_from_text_to_text(monkeypatch):
    """A piece goes to the model once a worker, not once for each batch that holds it; also with a full cache ids are the tokenizer's."""
    tokens = P.Tokens(public_tokenizers.path(P.TOKENIZER))
    seen, model = [], tokens.model

    class Counted:
        def tokenize(self, x):
            seen.append(x)
            return model.tokenize(x)

    tokens.model = Counted()
    texts = ["Straße, don't 'stop' naïve_x 12,5", "Straße. <|endoftext|> stop; «naïve» x_12 日本 é", "", "STOP! don't x <| 日本 12", "12 naïve"]
    for most in (100, 3):
        monkeypatch.setattr(P, "_CACHE_PIECES", most, raising=False)
        for text in texts:
            w = P.Words([text.encode()])
            if w.n:
                ids, bounds = tokens.of(w)
                each = [tokens.whole.encode(x, add_special_tokens=False).ids for x in text.split()]
                assert ids.tolist() == sum(each, []) == tokens.whole.encode(text, add_special_tokens=False).ids
                assert np.diff(bounds).tolist() == [len(x) for x in each]
        if most == 100:
            assert len(seen) == len(set(seen)) > 5
        tokens.clear()
