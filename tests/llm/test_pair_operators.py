from __future__ import annotations

import random
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import html, ngrams, urls, vectors
from tidewire.llm._graph import connected_components


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(6000, 6300)]
    got = connected_components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == components([e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Operator 1.


def shingle_sets(rows, n=5):
    out = []
    for _, t in rows:
        w = (t or "").split()
        width = min(n, len(w))
        out.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if w else frozenset())
    return out


def brute_joins(rows):
    """(doc_id, component, links) of every row."""
    sets = shingle_sets(rows)
    links, edges = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    parts = {}
    for x, r in components(edges).items():
        parts.setdefault(r, []).append(x)
    smallest = {x: min(rows[y][0] for y in members) for members in parts.values() for x in members}
    return [(i, smallest.get(k, i), links[k]) for k, (i, _) in enumerate(rows)]


def near_rows(groups=12, size=14):
    rng = random.Random(4)
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(4, 200))]
        for _ in range(rng.randrange(1, size)):
            words = [w if rng.random() > rng.choice([0, 0.01, 0.05]) else f"x{rng.randrange(9999)}" for w in base]
            rows.append((at, " ".join(words)))
            at += 1
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    rows = [*near_rows(), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (905, "one two"), (903, "one")]
    table = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, id string, bands int")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngrams.near_duplicates(table).collect())
    assert got == Counter(brute_joins(rows))
    kept = ngrams.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got})


def test_chains_are_dealt_by_bucket(spark, monkeypatch):
    """A long chain of near-duplicates with a dense group in it: pairs in several buckets count once."""
    seen, plain = [], ngrams._verify
    monkeypatch.setattr(ngrams, "_verify", lambda docs, dealt, *how: seen.append(dealt.where("size(units) > 1").count()) or plain(docs, dealt, *how))
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    words = [f"w{k}" for k in range(5500)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 90])) for k in range(900)]
    rows += [(3000 + k, " ".join(words[30:120]).replace(f"w{40 + k}", "x")) for k in range(12)] + [(4000, rows[7][1])]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngrams.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter(brute_joins(rows))
    assert seen[0] > 800  # in several buckets each


def test_links_do_not_depend_on_how_groups_are_dealt(spark, monkeypatch):
    """A banding that misses many pairs: whole groups and single buckets count the same ones."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(w if rng.random() > 0.012 else f"x{rng.randrange(9999)}" for w in base)) for k in range(90)]
    rows += [(200 + k, " ".join(base[3 * k : 3 * k + 60])) for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, plain = [], ngrams._verify
    monkeypatch.setattr(ngrams, "_verify", lambda docs, dealt, *how: seen.append(dealt.where("size(units) > 1").count()) or plain(docs, dealt, *how))
    found = []
    for block in (100_000, 2, 8):
        monkeypatch.setattr(ngrams, "BLOCK", block)
        found.append(Counter((r.doc_id, r.class_id, r.n_links) for r in ngrams.near_duplicates(table, recall=0.3).collect()))
    assert found[0] == found[1] == found[2] and seen[0] == 0 < max(seen)
    links = {i: n for i, _, n in brute_joins(rows)}
    assert sum(n for _, _, n in found[0]) < sum(links.values())  # so there were pairs to disagree on


def test_null_ids_and_no_rows(spark):
    got = ngrams.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in got), key=repr) == sorted([(None, None, 1, True), (3, None, 1, False), (4, 4, 0, True)], key=repr)
    assert ngrams.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ids_that_are_null_or_repeat(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    near = text("a").replace("a39", "z")  # linked with text a
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("b")), (7, text("d")), (7, text("e")), (8, near), (5, text("e")), (9, None), (9, text("f"))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngrams.near_duplicates(table).collect())
    assert got == Counter([(None, None, 1), (None, None, 1), (None, None, 0), (None, None, 1), (7, 7, 0), (7, 5, 1), (8, None, 1), (5, 5, 1), (9, 9, 0), (9, 9, 0)])
    kept = Counter((r.doc_id, r.text) for r in ngrams.keep_one(table).collect())
    assert kept == Counter([(None, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (5, text("e")), (9, None), (9, text("f"))])


def test_banding_reaches_its_recall():
    bands, rows = ngrams.choose_bands(0.8)
    assert bands * rows <= ngrams.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= ngrams.RECALL
    sign, rng = ngrams.Signer(bands, rows), np.random.default_rng(1)
    hits = 0
    for _ in range(200):
        shared = rng.integers(0, 1 << 63, 400, np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50, np.uint64)])) for _ in range(2))  # Jaccard 0.8
        hits += bool((sign(a) == sign(b)).any())
    assert hits >= 198


# Operator 5.


def vector_rows(n=300, d=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    near = [base[k] + rng.normal(size=d) * s for k in range(0, 60, 2) for s in (0.05, 0.15, 0.25, 0.33)]
    hub = rng.normal(size=d)
    group = [hub + rng.normal(size=d) * 0.1 for _ in range(150)]
    return np.concatenate([base, near, group, base[:5], base[:5] * 3]).astype(np.float32)


@pytest.mark.parametrize("blocks", [(1024, 8192), (16, 40)])
@pytest.mark.parametrize("dimension", [64, 8])
def test_vectors_match_brute_force(spark, monkeypatch, blocks, dimension):
    monkeypatch.setattr(vectors, "OWN_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "OTHER_BLOCK", blocks[1])
    monkeypatch.setattr(vectors, "CELL", 60)
    x = vector_rows(d=dimension)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(9000, None, 1), (9001, [0.0] * dimension, 1), (9002, [1.0, None, 2.0], 1), (9003, [float("nan")] * dimension, 1), (9004, [], 1), (9005, [1.0], 1), (9006, [2.0], 1), (0, x[0].tolist(), 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, cell int")).collect()
    links, component = vectors.brute_force(list(range(len(x))), x)
    seen = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id < 9000}
    extra = {k for k in range(len(x)) if x[k] @ x[0] >= 0.95 * np.linalg.norm(x[k]) * np.linalg.norm(x[0])}  # row 0 is there twice
    assert seen == {k: (links[k] + (k in extra), component[k]) for k in links}
    tail = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id >= 9000}
    assert tail == {k: (0, k, True) for k in range(9000, 9005)} | {9005: (1, 9005, True), 9006: (1, 9005, False)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("intrinsic", [2, 4])
def test_vectors_of_low_intrinsic_dimension(spark, monkeypatch, intrinsic):
    monkeypatch.setattr(vectors, "CELL", 150)
    monkeypatch.setattr(vectors, "OWN_BLOCK", 100)
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(900, intrinsic)) @ np.linalg.qr(rng.normal(size=(64, intrinsic)))[0].T).astype(np.float32)
    x = np.concatenate([x, x[:40]])  # copies count for both ends of a link
    got = vectors.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()
    links, component = vectors.brute_force(list(range(len(x))), x)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (links[k], component[k]) for k in links}


def test_a_hot_block_is_labelled_by_arrays():
    """3,000 vectors that all link, and groups that meet only through visitors."""
    rng = np.random.default_rng(0)
    hub = rng.normal(size=64)
    x = vectors.unit(hub + rng.normal(size=(3000, 64)) * 0.05)
    ids, ones = np.arange(3000) * 7, np.ones(3000, np.int64)
    began = time.time()
    links, back, forest = vectors.compare_block(x, ids, ones, (np.zeros(3000, np.int64), np.zeros(0, np.int64)), x, ids, ones, np.full(3000, -1), 0.95)
    assert time.time() - began < 1.0
    assert (links == 2999).all() and not back.any() and sorted(map(tuple, forest)) == [(7 * k, 0) for k in range(1, 3000)]
    angle = np.arange(0, 3000) * np.arccos(0.96)  # a chain: each links with the next only
    chain = np.column_stack([np.cos(angle[:20]), np.sin(angle[:20])])
    order = rng.permutation(20)
    own, other = order[:10], order
    links, back, forest = vectors.compare_block(chain[own], own, ones[:10], (np.full(10, 1), np.full(10, 4)), chain[other], other, ones[:20], np.where(np.isin(other, own), -1, np.where(other % 2, 4, 5)), 0.95)
    edges = {(int(a), int(b)) for a in own for b in other if a != b and chain[a] @ chain[b] >= 0.95}
    assert links.tolist() == [sum(a == k for a, _ in edges) for k in own]
    want = {int(k): 0 if k in own or k % 2 else sum(b == k for _, b in edges) for k in other}  # cell 4 is visited in turn
    assert {int(k): int(n) for k, n in zip(other, back, strict=True)} == want
    assert components([(int(a), int(b)) for a, b in forest]) == components(edges)


def test_every_length_is_clustered(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "OWN_BLOCK", 50)
    rows, want = [], {}
    for at, d in ((0, 16), (1000, 5), (2000, 3)):
        x = vector_rows(n=80, d=d, seed=d)[: 25 if d == 3 else None]
        links, component = vectors.brute_force([at + k for k in range(len(x))], x)
        rows += [(at + k, v.tolist()) for k, v in enumerate(x)]
        want |= {k: (links[k], component[k]) for k in links}
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    alone = vectors.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (None, None)], "vec_id bigint, embedding array<float>")).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in alone] == [(None, 0, None)] * 2


# Operator 7.


def judged_by_hand(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, key=lambda r: (-len(r[0]), r[0], r[1]), default=(None, "allow"))
    return host, path, *best


def test_urls_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.b.example.com", "notexample.com", "x.net", "net", "e..com", "com.", "example.com:80", "u@x.net", "É.com", ""]
    paths = ["", "/", "/en", "/en/", "/EN/x", "/es/a?x=/fr/", "/fr/#top", "?q", "#f", "//en/", "/en/\n/x"]
    given = [f"{s}{h}{p}" for s, h, p in product(["https://", "HTTP://", ""], hosts, paths)] + [None, "", "://", "a://b://example.com/en/", "x" * 5000, "https://x.com/" + "y" * 9000]
    rows = [(k, u, "x") for k, u in enumerate(given * 2)]
    rng.shuffle(rows)
    extra = [*urls.RULES, ("example.com", "", "block"), ("example.com", "/e", "allow"), ("x.net", "/", "block"), ("x.net", "/", "allow")]
    for rules in (urls.RULES, extra, []):
        table = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
        for most in (200_000, 0):
            got = urls.filter_pages(spark.createDataFrame(rows, "page_id bigint, url string, host string"), table, max_rules=most).collect()
            assert {r.page_id: tuple(r)[1:] for r in got} == {k: judged_by_hand(u, rules) for k, u, _ in rows}


def test_no_urls(spark):
    table = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert urls.filter_pages(spark.createDataFrame([], "page_id bigint, url string"), table).count() == 0


# Operator 10.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site name</h1>
<ul class="menu"><li><a href=/>Home</a><li><a href=/b>More</a></ul></header><div id="cookie-notice">We use cookies on this site.</div><div class="layout">
<aside><p>Popular posts are here and there, you can read them all right now.</p></aside><main><article class="post"><header><h1>The title</h1></header>
<p>First &amp; foremost &#8212; a paragraph<br>of text.<p><b>Second one.</b><div class="ad">Buy this wonderful product now, it is great.</div><ul><li>One<li>Two</ul>
<blockquote>Quote</blockquote><form><label>Mail</label><button>Send</button></form><script>if (a < b) { "</p>" }</script><!-- <p>no</p> --><p>Short.</p><footer>Filed under</footer></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I like this very much, thank you for the great article.</p></article></section></main></div><footer>&copy; 2020</footer></body></html>"""


def test_extract():
    assert html.extract(PAGE) == "The title\nFirst & foremost — a paragraph of text.\nSecond one.\nOne\nTwo\nQuote\nShort."
    assert html.extract(None) == html.extract("") == html.extract("<p> </p>") == ""
    plain = "<p>A long paragraph of text with many words in it that makes sense on its own.<p>Another one with as many words, and a <a href=x>link</a> in it too.<div><a href=a>A</a> <a href=b>B</a></div>"
    assert html.extract(plain).count("\n") == 1
    long = "<article>" + "<p>Some words here.</p>" * 5000 + "</article>"
    assert html.extract(long).count("\n") == 4999
    for broken in ("<", "<p", "<a href='x", "<!--", "<script>", "</p></p>", "<p>a<p>b</div></b>", "&#xD800;&bogus;", "<İ>", "a<br/>b"):
        html.extract(broken)


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(1, 9)
        own = [rng.uniform(-3, 3) for _ in range(n)]
        joined = {(a, b): rng.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(labels, own=own, joined=joined):
            alone = sum(max(0, -round(x * html.SCALE)) if v else max(0, round(x * html.SCALE)) for x, v in zip(own, labels, strict=True))
            return alone + sum(round(w * html.SCALE) for (a, b), w in joined.items() if labels[a] != labels[b])

        assert cost(html.minimum_cut(own, joined)) == min(map(cost, product([False, True], repeat=n)))


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, "", None), (None, "v", "<article>q</article>", "x")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.url, r.n_chars == len(r.text)) for r in got) == Counter((r[0], r[1], True) for r in rows)
    assert html.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_synthetic_articles(spark, sf):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (re.sub("</?b>", "", p.replace("<br>", " ")) for p in re.split("</?(?:p|h1)>", article))
        want[r.page_id] = "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
    got = html.extract_pages(pages.withColumn("n_chars", F.lit(1)))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_article_inside_a_marked_region():
    long = " ".join(f"word{k}" for k in range(45))
    article = f"<article><h2>Short title</h2><p>{long}</p><p>And a line.</p><p>{long}</p></article>"
    want = f"Short title\n{long}\nAnd a line.\n{long}"
    for around in ("<form action=x>{}</form>", "<div class='layout sidebar-right'>{}</div>"):
        assert html.extract("<body>" + around.format("<ul><li><a href=x>Home</a></li></ul>" + article) + "</body>") == want
    # Cards have short blocks only; hidden and comment regions stay out.
    cards = "<div class=related>" + "<article><h3>Read more</h3><p>A teaser.</p></article>" * 3 + "</div>"
    hidden = f"<div hidden>{article}</div><div class=comments>{article}</div>"
    assert html.extract(f"<body>{article}{cards}{hidden}</body>") == want
    assert html.extract("<article><p>Mass <math><mi>m</mi><annotation>\\m</annotation></math> grows.</p></article>") == "Mass m grows."


#: Pages that mark no article and name no region, with the text that is theirs.
_L = [" ".join(f"{c}{k}" for k in range(45)) + "." for c in "abcdef"]
MESSY = [
    # A link list and a one-word line among paragraphs; link rows and a copyright line around them.
    (
        f"<div><div><a href=1>One</a></div><div><a href=2>Two</a></div></div><div><p>{_L[0]}</p><p>{_L[1]}</p><ul><li><a href=x>Part</a> one</li><li>Part two</li></ul><p>{_L[2]}</p><div>So</div><p>{_L[3]}</p></div>"
        "<table><tr><td><a href=3>Three</a></td><td><a href=4>Four</a></td><td>2020</td></tr></table>",
        [_L[0], _L[1], "Part one", "Part two", _L[2], "So", _L[3]],
    ),
    # A caption made of one link between paragraphs of plain divs, and a slogan among link rows.
    (
        f"<div><span><a href=1>Start</a></span></div><div>Fast</div><div><a href=2>Contact us</a></div><div><a href=5>Jobs</a></div><section><div>{_L[0]}</div><div><a href=z>{'see the figure ' * 3}</a></div><div>{_L[1]}</div><div>{_L[4]}</div></section>",
        [_L[0], ("see the figure " * 3).strip(), _L[1], _L[4]],
    ),
    # Boilerplate without telling names after a marked article in a form.
    (f"<form><article><p>{_L[0]}</p><p>Yes</p><p>{_L[5]}</p></article></form><div><div><a href=1>Next</a></div><div><a href=2>Back</a></div></div>", [_L[0], "Yes", _L[5]]),
]


def test_the_cut_decides_on_messy_pages(monkeypatch):
    calls, plain = [], html._source_side
    monkeypatch.setattr(html, "_source_side", lambda *a: calls.append(1) or plain(*a))
    model, changed = html.Model(), 0
    for page, want in MESSY:
        found = html.blocks(page)
        scores = [model.score(html.code(b, any(x.article for x in found))) for b in found]
        cut = html.minimum_cut(scores, html.edges(found))
        changed += sum((s > 0) != k for s, k in zip(scores, cut, strict=True))
        assert [b.text for b, k in zip(found, cut, strict=True) if k] == want == html.extract(page).split("\n")
    assert changed >= 4 and len(calls) >= 2


def test_whole_pages_match_all_labellings():
    for page in [*(p for p, _ in MESSY), PAGE.replace("article", "div").replace("main", "div")]:
        found = html.blocks(page)[:16]
        model = html.Model()
        marks = any(b.article for b in found)
        own, joined = [round(model.score(html.code(b, marks)) * html.SCALE) for b in found], {k: round(w * html.SCALE) for k, w in html.edges(found).items()}
        bits = np.array(list(product([0, 1], repeat=len(found))))
        cost = np.where(bits, np.maximum(0, -np.array(own)), np.maximum(0, np.array(own))).sum(axis=1)
        for (a, b), w in joined.items():
            cost = cost + w * (bits[:, a] != bits[:, b])
        got = html.minimum_cut([model.score(html.code(b, marks)) for b in found], html.edges(found))
        assert cost[(bits == np.array(got)).all(axis=1)][0] == cost.min()


def test_classifier_is_learned(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = html.fit(pages)
    assert model.weights != html.Model().weights
    right = total = 0
    for r in pages.where("crc32(cast(url AS binary)) % 5 = 0").collect():  # held out, marks hidden
        truth = [b.article and not b.other for b in html.blocks(r.html)]
        found = html.blocks(r.html.replace("article>", "div>"))
        got = html.minimum_cut([model.score(html.code(b, False)) for b in found], html.edges(found))
        right, total = right + sum(a == b for a, b in zip(got, truth, strict=True)), total + len(truth)
    assert total > 200 and right / total > 0.98
    assert html.fit(pages.limit(0)).weights == html.Model().weights
    with pytest.raises(ValueError):
        html.extract_pages(pages.withColumn("text", F.lit("x")), keep=("page_id", "text"))


def test_weights_are_the_maximum():
    rng = random.Random(11)
    counts = {((1, 0, 0, k % 7, k % 4, k % 3, k % 2), k % 5 < 3): rng.randrange(1, 9) for k in range(40)}
    best, prior = np.array(html.fit_weights(counts)), np.array(list(html.PRIOR.values()))
    scale = html.ROWS / sum(counts.values())

    def loss(w):
        z = {key: float(np.dot(w, html.features(key[0]))) for key in counts}
        return sum(n * scale * (np.logaddexp(0, z[k]) - k[1] * z[k]) for k, n in counts.items()) + ((w - prior) ** 2).sum() / (2 * html.DEVIATION**2)

    for j in range(len(best)):
        for step in (-1e-3, 1e-3):
            w = best.copy()
            w[j] += step
            assert loss(w) > loss(best)
