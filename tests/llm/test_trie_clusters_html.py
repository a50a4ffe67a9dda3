"""Prefix trie, centroid clustering and HTML extraction on small inputs: against plain Python, and on odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest

from evidentia.llm import centroids, html_text, prefix_trie
from evidentia.llm.registry import QUERIES
from evidentia.llm.shared import materialize

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
TURNS = "conv_id long, turn long, role string, text string, x1 string, d int, n_chars long, _cut int"


def plain_trie(sequences: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """The contract's nodes, from conversation -> [(role, text)], by a dictionary of prefixes."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(own) - 1) * (len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
    return {(min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, own in members.items()}


def plain_rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((-1 if turn is None else turn, (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def as_rows(df) -> set[tuple]:
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def odd_conversations() -> list[tuple]:
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "no", "é𝒳", "", None])) for c in [*range(95, 130), 250, 399, 400] for t in r.sample([None, *range(9)], r.randrange(1, 9))]
    rows += [(7, 5, "user", "x" * 200_000), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (None, 1, "user", "none"), (1_000_003, 0, "user", "far")]
    return [(*x, "a", 1, 2, 3) for x in rows]


def test_trie_of_rebuilt_conversations_equals_a_dictionary_of_prefixes(spark):
    rows = odd_conversations()
    assert as_rows(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, TURNS).repartition(3))) == plain_trie(plain_rebuilt(rows))


@needs_tables
def test_trie_of_the_driver_table_equals_a_dictionary_of_prefixes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op11_prefix_trie"](spark, SF)) == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("bits", [1, 12])
def test_trie_with_long_paths_in_pieces_and_many_light_levels(spark, monkeypatch, bits):
    monkeypatch.setattr(prefix_trie, "CUT_BITS", bits)
    r = random.Random(bits)
    made = {0: ["a"] * 40}
    for c in range(1, 150):
        base = made[r.randrange(c)]
        made[c] = base[: r.randrange(len(base) + 1)] + [r.choice("ab") for _ in range(r.randrange(6))]
    made |= {c: ["b", "b"] for c in range(9000, 9300)}  # copies over several blocks of ids
    sequences = {c: [("u", x) for x in t] for c, t in made.items() if t}
    rows = [(c, d, *x, "a", 1, 2, 3) for c, t in sequences.items() for d, x in enumerate(t)]
    turns = materialize(prefix_trie.numbered(spark.createDataFrame(rows, TURNS)), "numbered")
    assert as_rows(prefix_trie.digested(*prefix_trie.whole(turns))) == plain_trie(sequences)


def test_trie_of_no_conversations_is_empty(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 0, "user", "x", "", 1, 2, 3)], TURNS)).count() == 0


def test_trie_of_turnless_conversations_is_a_root(spark):
    few = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1]
    got = prefix_trie.rebuilt_trie(spark.createDataFrame([(c, 0, "user", "x", "", 1, 2, 3) for c in few], TURNS)).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(min(few), 0, None, len(few), 0, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(",".join(map(str, few)).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, q string, n long, cluster string"


def plain_clusters(rows, k=8, rounds=10, width=64):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(np.float32(x)) for x in e)]
    kept = [(i, q) for i, q in kept if max(map(abs, q)) <= 1 << 27]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(q, "<i4").tobytes(), q) for i, q in kept if i is not None)[:k]
    cents = [list(q) for _, _, q in seeds]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        sums = {}
        for _, q in kept:
            n = nearest(q)[1]
            m, s = sums.get(n, (0, [0] * width))
            sums[n] = m + 1, [a + b for a, b in zip(s, q, strict=True)]
        for n, (m, s) in sums.items():
            cents[n] = [x // m for x in s]
    out = [(i, *nearest(q)[::-1]) for i, q in kept]
    own = {n: sum(d for _, m, d in out if m == n) for _, n, _ in out}
    return sorted(((i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, n, d in out), key=str)


def test_clusters_equal_plain_integers_on_odd_vectors(spark):
    r = random.Random(3)
    vector = lambda: [r.gauss(0, 0.3) for _ in range(64)]
    hot = vector()
    rows = [(i, vector()) for i in range(60)] + [(100 + i, hot) for i in range(40)]
    rows += [(200, None), (201, []), (202, vector()[:63]), (203, [*vector(), 0.0]), (204, [None, *vector()[1:]]), (205, [float("nan"), *vector()[1:]]), (206, [float("-inf"), *vector()[1:]]), (207, [1e30, *vector()[1:]])]
    rows += [(208, [131072.0, -131072.0, *vector()[2:]]), (209, [-1e-9] * 64), (3, vector()), (3, rows[3][1]), (None, vector())]
    frame = spark.createDataFrame([(*x, 1, "q", 2, "c") for x in rows], VECTORS).repartition(3)
    got = centroids.labelled(frame)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["vec_id bigint", "cluster int", "distance bigint", "cluster_inertia bigint", "inertia bigint", "centroid_sha256 string"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [0.25] * 64)]
    got = centroids.labelled(spark.createDataFrame([(*x, 1, "q", 2, "c") for x in rows], VECTORS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows)
    assert centroids.labelled(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.labelled(spark.createDataFrame([(1, None, 1, "q", 2, "c")], VECTORS)).columns == got.columns


def test_an_empty_cluster_keeps_its_centroid(spark):
    rows = [(i, [float(i // 3)] * 64) for i in range(9)]  # copies among the first centroids: of equal ones the first takes all
    assert sorted((tuple(r) for r in centroids.labelled(spark.createDataFrame([(*x, 1, "q", 2, "c") for x in rows], VECTORS)).collect()), key=str) == plain_clusters(rows)


PAGES = "page_id long, url string, html string, host string, text string, paths string, _row string"
WORDS = "the quick brown fox jumps over a lazy dog and runs away from the hunters of the wood"


def para(seed: int, n: int = 30) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS.split()) for _ in range(n)).capitalize() + "."


def extracted(spark, pages: list[tuple]) -> dict[int, str]:
    got = html_text.main_text(spark.createDataFrame([(*p, "h", "t", "p", "r") for p in pages], PAGES).repartition(2)).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


@needs_tables
def test_driver_pages_give_their_articles(spark):
    """The driver's pages hold one <article>; its text by regular expressions."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    block = re.compile(r"</?(?:p|h1|br|div|li|ul)\b[^>]*>")

    def plain(page):
        inside = " ".join(re.findall(r"<article>(.*?)</article>", page, re.S))
        return " ".join(unescape(re.sub(r"<[^>]*>", "", block.sub(" ", inside))).split())

    got = QUERIES["op13_html_text"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.text for r in got.collect()} == {r.page_id: plain(r.html) for r in rows}


def test_templates_without_article_elements(spark):
    a, b, c = para(1), para(2), para(3)
    menu = "<ul class='menu'>" + "".join(f"<li><a href='/{i}'>Item number {i}</a></li>" for i in range(9)) + "</ul>"
    pages, want = [], {}
    for i in range(12):
        x, y = para(100 + i), para(200 + i)
        pages.append((i, f"http://one.example/{i}", f"<html><body><div id=top>{menu}</div><div class='wrap w{i}'><div class='post-{i} post'><h2>Title {i}</h2><p>{x}</p><p>{y}</div><div class=sidebar><p>{a}</p></div></div><div class=footer><p>{b}</p></div></body></html>"))
        want[i] = f"Title {i} {x} {y}"
    # Sections without a common wrapper, a comment list, a cookie notice, a form.
    pages.append((50, "http://two.example/x", f"<body><header><h1>Site</h1></header><div class=cookie-notice>We use cookies. {a}</div><div class='section'><p>{a}</p></div><div class='section'><p>{b}</p></div><div class='section'><p>{c}</p></div><form><p>{a}</p><input><button>Go</button></form><section id='comments'><article class=comment><p>{c} {b} {a} {c} {b}</p></article></section></body>"))
    want[50] = f"{a} {b} {c}"
    # The host's usual container is there but holds next to nothing: the page's own best one is taken.
    pages.append((12, "http://one.example/12", f"<body><div class='wrap'><div class='post'>x</div></div><main><p>{a}</p><p>{b}</p></main></body>"))
    want[12] = f"{a} {b}"
    assert extracted(spark, pages) == want


def test_host_consensus_settles_a_page_that_alone_would_go_wrong(spark):
    """One page has a short article beside a long unnamed block; on the host's other pages the article is the best container."""
    pages = [(i, f"http://h.example/{i}", f"<body><div class=mid><p>{para(i, 60)}</p></div><div class=extra><p>{para(500 + i, 8)}</p></div></body>") for i in range(10)]
    pages.append((10, "http://h.example/10", f"<body><div class=mid><p>{para(10, 25)}</p></div><div class=extra><p>{para(510, 30)}</p></div></body>"))
    got = extracted(spark, pages)
    assert got == {i: para(i, 60) for i in range(10)} | {10: para(10, 25)}
    alone = extracted(spark, [(10, "http://other.example/10", pages[-1][2])])
    assert alone[10] == para(510, 30)


def test_markup_in_detail(spark):
    body = lambda x: f"<html><body><article>{x}</article></body></html>"
    cases = {
        "a&amp;b &eacute;&#8217;&#x41; &copy 1&nbsp;2 &unknown; &lt;p&gt;": "a&b é’A © 1 2 &unknown; <p>",
        "<p>one<p>two</p>three<br>four<br/>five": "one two three four five",
        "<p>in<b>line</b> <i>and <u>nes</i>ted</u></p>": "inline and nested",
        "x < y and 3 > 2 <!-- <p>no</p> --> z <!doctype x> <?php ?> end": "x < y and 3 > 2 z end",
        "<p>a</p><script>document.write('<p>no</p>')</script><STYLE>p{}</STYLE><p>b</p>": "a b",
        "<p title='a > b' data-x=\"<p>\">shown</p>": "shown",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>e<dd>f</dl>": "a b c d e f",
        "<p>a</p><div hidden>no</div><div style='display:none'>no</div><p aria-hidden=true>no</p><span role=alert>no</span>b": "a b",
        "<p>a</p><noscript><p>no</p></noscript><textarea>no</textarea><svg><text>no</text></svg><p>b": "a b",
        "<h1 class='page-header'>T</h1><figure><img alt=no><figcaption>c</figcaption></figure><blockquote>q</blockquote><pre>p\n  q</pre>": "T c q p q",
        "<div class='ad-slot'>no</div><div class='with-sidebar'>yes</div><div class='adult'>so</div><div id='relatedPosts'>no</div>": "yes so",
        "é ü　𝒳\t\n\x0b z": "é ü 𝒳 z",
        "": "",
        "<nav>no</nav>": "",
    }
    pages = [(i, f"http://h{i}.example/", body(x)) for i, x in enumerate(cases)]
    assert extracted(spark, pages) == dict(enumerate(cases.values()))


def test_odd_pages(spark):
    long = " ".join(para(i) for i in range(3000))
    pages = [
        (1, "http://a.example/", None),
        (2, "http://a.example/", ""),
        (3, None, "plain text only"),
        (4, "no scheme", "<p>loose</p><h2>and</h2>bare"),
        (5, "HTTP://A.example:80/?x", f"<body><p>{long}</p></body>"),
        (6, "http://b.example/", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (7, "http://b.example/", "<b><i>" * 3000 + "inline" + "<div>"),
        (8, "http://c.example/", "<html><head><title>no</title><meta x><body><article><p>head left open"),
        (9, "http://c.example/", "<article><p>kept</p><!-- never closed <p>no</p>"),
        (10, "http://c.example/", "<article><p>kept</p><script>never closed <p>no</p>"),
        (11, "http://c.example/", "<article><p>kept</p><a href='never closed"),
        (12, "http://d.example/", "<nav>only</nav><footer>this</footer>"),
        (13, "http://d.example/", "<p><a href=x>only links here</a></p>"),
    ]
    got = extracted(spark, pages)
    assert got == {1: "", 2: "", 3: "plain text only", 4: "loose and bare", 5: long, 6: "deep", 7: "inline", 8: "head left open", 9: "kept", 10: "kept", 11: "kept", 12: "", 13: "only links here"}
    assert html_text.main_text(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("unit", ['<a "', "<!--", "<p ", "</p", "<", "<div><p>", "<b><p>", "<a href='x>", "&amp", "<li><ul>", "</div><i>"])
def test_parsing_takes_linear_time(unit):
    began = time.perf_counter()
    html_text.scored(html_text.blocks(unit * (200_000 // len(unit)) + ">"))
    assert time.perf_counter() - began < 20
