"""Operators on pages and vectors against brute force and SQL, with odd rows."""

import base64
import gzip
import hashlib
import html as H
import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import extract, mincut, neighbours, pagemaker, urlfilter, warc
from tessera.llm import queries as q
from tessera.session import table
from tests.compare import same


@pytest.fixture(scope="module")
def odd(spark):
    urls = [
        "https://www.example.com/en/1", "http://a.EXAMPLE.com/en/x?q=1", "x", None, "ftp://", "http://net/es/", "http://NOTnet/es/",
        "https://b.net/fr/#f", "https://com", "https://com/", "//x", "http://q..example.com/en/", "https://ex.com:80/en/é"
    ]
    rows = [(i, u, None if i == 3 else "" if i == 4 else f"<p>page {i % 3}</p>", "k", b"x", i, "t") for i, u in enumerate(urls)]
    rows += [rows[0], (None, None, None, None, None, None, None), (0, "http://other/", "<p>page 1</p>", "", b"", 0, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, payload binary, uid int, text string")


def test_sql_twins(spark, sf_dir, duck):
    for name, sql in q.oracle_sql().items():
        assert same(q.queries()[name](spark, sf_dir), duck.sql(sql))


def brute_verdict(url):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0] if m else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules_on_odd_rows(spark, odd):
    got = urlfilter.judge(odd, urlfilter.rule_table(spark, q.URL_RULES)).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((r.page_id, *brute_verdict(r.url)) for r in odd.collect())))
    rules = urlfilter.rule_table(spark, q.URL_RULES)
    assert urlfilter.judge(odd.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(odd, rules.limit(0), "block").collect()} == {"block"}


def test_ranges_of_a_hot_host_and_many_rules(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(urlfilter, "COPIES", 16)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.net", "xa.com", "a.com.net"]
    rules = sorted({(str(rng.choice(["allow", "block"])), str(rng.choice(hosts)), "/" + "/".join(rng.choice(list("pqr"), int(rng.integers(0, 4))))) for _ in range(60)})
    urls = ["http://c.b.a.com/p/q"] * 300 + [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(list("pqrs"), int(rng.integers(0, 6)))) for _ in range(600)]
    rows = [(None if i % 7 == 0 else i % 500, u) for i, u in enumerate(urls)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(5), urlfilter.rule_table(spark, rules)).collect()

    def brute(url):
        host, _, path = url.removeprefix("http://").partition("/")
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    assert sorted((str(r.page_id), r.rule or "", r.verdict) for r in got) == sorted((str(i), brute(u)[0] or "", brute(u)[1]) for i, u in rows)


def test_nested_rules_unwind(spark):
    rules = [
        ("block", "a.com", ""), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("allow", "a.com", "/x/y/z"), ("block", "com", "/x/y/zz"),
        ("block", "a.com", "/x"), ("allow", "b.a.com", "")
    ]
    urls = [
        "http://a.com", "http://a.com/x", "http://a.com/x/y", "http://a.com/x/y/z/1", "http://a.com/x/z", "http://a.com/w", "http://c.b.a.com/x/y",
        "http://d.com/x/y/zz", "http://aa.com/x", "http://a.com/x/y/zzz"
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()}

    def brute(url):
        host, _, path = url.removeprefix("http://").partition("/")
        path = "/" + path if path else ""
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)}


def test_archive_round_trip(spark, odd, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_pages(odd, folder)
    got = sorted(map(str, (tuple(r) for r in warc.page_rows(warc.read_archives(spark, folder, split=700)).collect())))
    rows = [(r.page_id, (r.html or "").encode()) for r in odd.collect()]
    want = []
    for i, payload in rows:
        first = min((k for k, p in rows if p == payload and k is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((i, len(payload), digest, "response", None) if first is None or i == first else (i, len(payload), digest, "revisit", first))
    assert got == sorted(map(str, want))
    kept = warc.read_archives(spark, folder, payloads=True).where("kind = 'response'").collect()
    assert {r.payload.decode() for r in kept} == {(r.html or "") for r in odd.collect()}
    assert {r.url for r in kept} <= {r.url for r in odd.collect()}
    empty = str(tmp_path / "e")
    warc.write_pages(odd.limit(0), empty)
    assert warc.page_rows(warc.read_archives(spark, empty)).count() == 0


def test_archives_are_plain_gzip(spark, odd, tmp_path):
    folder = tmp_path / "w"
    warc.write_pages(odd, str(folder))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in folder.glob("part-*"))
    assert data.count(b"WARC/1.1\r\n") - data.count(b"WARC-Type: warcinfo") == odd.count()


def test_ranges_own_what_starts_inside():
    rng = np.random.default_rng(1)
    bodies = [bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in rng.integers(0, 4000, 40)] + [warc.MAGIC * 50, gzip.compress(b"x" * 100)]
    data = b"junk" + b"".join(warc._ended(warc.page_record(i, "u", b, None)) + b"\0" for i, b in enumerate(bodies)) + b"\0\0"
    for step in (1, 997, 10_000, 1 << 30):
        step = max(step, 50)
        found = [r for s in range(0, len(data), step) for r in warc.read_range(io.BytesIO(data), s, min(len(data), s + step), True)]
        assert [r["payload"] for r in found] == bodies


def test_a_range_may_reach_past_the_end():
    data = warc.page_record(1, "u", b"x", None)
    assert len(list(warc.read_range(io.BytesIO(data), 0, 1 << 40))) == 1
    assert not list(warc.read_range(io.BytesIO(data), len(data), 1 << 40))


def test_long_headers_and_pages_are_read_whole(spark, tmp_path):
    rows = [(1, "http://a/" + "x" * 3_000_000, "<p>one</p>"), (2, "http://b/", "<p>two</p>" * 400_000), (3, None, None)]
    folder = str(tmp_path / "w")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.record_id: (r.url, r.payload_bytes) for r in warc.read_archives(spark, folder, split=1 << 16).where("kind = 'response'").collect()}
    assert got == {f"urn:page:{i}": (u, len((h or "").encode())) for i, u, h in rows}


def test_http_blocks_without_an_empty_line_are_payload():
    data = warc.record("response", "1", {"Content-Type": "application/http"}, b"no headers here")
    assert [(r["payload"], r["payload_bytes"]) for r in warc.read_range(io.BytesIO(data), 0, len(data), True)] == [(b"no headers here", 15)]


def test_large_members_end_in_an_empty_one():
    member = gzip.compress(b"abc", mtime=0)[:-1] + b"\x01"
    assert warc._ended(member)[: len(member)] == member and (warc._ended(member) + b"\0").endswith(warc.EMPTY)


def test_damaged_record_is_an_error():
    data = warc.page_record(1, "http://a/" + np.random.default_rng(1).bytes(30_000).hex(), bytes(range(256)) * 40, None)
    for cut in (len(data) - 20, 10_000):  # in the block, and in the header
        with pytest.raises((zlib.error, ValueError)):
            list(warc.read_range(io.BytesIO(data[:cut]), 0, cut))
    headless = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n")
    with pytest.raises(ValueError):
        list(warc.read_range(io.BytesIO(headless), 0, len(headless)))


def brute_cut(source, sink, edges):
    n, best = len(source), None
    for mask in range(1 << n):
        side = [mask >> i & 1 for i in range(n)]
        cost = sum(t if s else f for s, f, t in zip(side, source, sink, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    source, sink = rng.random(n) * 3, rng.random(n) * 3
    edges = [(int(a), int(b), float(c)) for (a, b), c in zip(rng.integers(0, n, (2 * n, 2)), rng.random(2 * n), strict=True)]
    side = mincut.source_side(source.tolist(), sink.tolist(), edges)
    cost = sum(t if s else f for s, f, t in zip(side, source, sink, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])
    assert cost == pytest.approx(brute_cut(source, sink, edges))


def test_main_text_of_all_pages(spark, sf_dir):
    got = {r.page_id: (r.text, r.n_chars) for r in q.op2_html_extraction(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(H.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


PAGE = """<html><head><title>T</title><style>a{}</style></head><body><div class="cookie-notice">We use cookies. Accept?</div>
<header><a href=/>Site</a><nav><a href=/a>A</a></nav></header><aside><h3>Related</h3><ul><li><a href=x>foo bar</a></ul></aside>
<div class="post-content"><h1>My title</h1><p>First &amp; second&nbsp;para with   some words. It has two sentences, long enough to be told.<p>Short.
<blockquote>Quote &#105;s here</blockquote><div class="ad">Buy now!</div><form><label>Name</label><input></form><ul><li>One item<li>Two item</ul>
<p>Last paragraph of the article ends here. Bye to all of the readers of it.</div><section id="comments"><h2>Comments</h2>
<p>I liked this article very much, thanks. It was a good read, indeed.</p></section><footer>&copy; 2020 Site</footer><script>if(a<b){x("</p>")}</script></body></html>"""


def test_main_text_without_article_tags():
    assert extract.main_text(PAGE).split("\n") == [
        "My title", "First & second para with some words. It has two sentences, long enough to be told.", "Short.", "Quote is here", "One item",
        "Two item", "Last paragraph of the article ends here. Bye to all of the readers of it."
    ]


BODY = "<h1>Title here</h1><p>" + "A sentence of the article that is long enough to count. " * 5 + "</p><p>Another paragraph with <math><mi>x</mi></math> in it.</p>"
WRAPPERS = [
    ("<article>", "</article>"),
    ('<div class="has-sidebar"><article>', "</article></div>"),
    ('<div class="overflow-hidden"><main>', "</main></div>"),
    ('<div class="page-with-sidebar nav-open"><article>', "</article></div>"),
    ('<div class="search-wrapper"><article>', "</article></div>"),
    ('<div id="main"><div class="row social-enabled">', "</div></div>"),
    ('<div class="content no-sidebar">', "</div>"),
    ('<form id="form1"><div class="widget"><article>', "</article></div></form>"),
    ('<div class="comments-open">', "</div>"),
    ("<div>", "</div>"),
]


@pytest.mark.parametrize("around", WRAPPERS)
@pytest.mark.parametrize("body", ["<body>", '<body class="nav-open with-sidebar">'])
def test_wrappers_notices_and_comments(around, body):
    page = f"""<html>{body}<nav><a href=/>Home</a></nav>{around[0]}{BODY}{around[1]}<div>We use cookies to make this site better. Accept</div>
    <div><h3>2 Comments</h3><div><p>I liked this very much, thank you for writing it all down.</p></div></div><footer>&copy; 2020 Site</footer></body></html>"""
    sentence = " ".join(["A sentence of the article that is long enough to count."] * 5)
    assert extract.main_text(page).split("\n") == ["Title here", sentence, "Another paragraph with x in it."]


def test_classifier_on_pages_it_has_not_seen():
    right = []
    for html, content in pagemaker.pages(200, 77):
        found = extract.blocks(html)
        right += [(b.text in content) == keep for b, keep in zip(found, extract.label(found), strict=True)]
    assert np.mean(right) > 0.995


def test_newton_finds_the_least_loss():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(300), rng.normal(size=(300, 2))]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.5, 1.0, -2.0])))).astype(float)
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + 0.5 * 2e-4 * len(x) * w @ w
    best = np.array(extract.train(x, y))
    assert all(loss(best) <= loss(best + d) + 1e-9 for d in rng.normal(size=(200, 3)) * 0.05)


def test_long_pages_are_read_whole():
    many = "".join(f"<p>Paragraph number {i} of a long page, with words enough.</p>" for i in range(20_000))
    text = extract.main_text(f"<article>{many}</article>")
    assert text.count("\n") == 19_999 and text.endswith("Paragraph number 19999 of a long page, with words enough.")


def test_extraction_of_odd_rows(odd):
    got = extract.extract(odd).collect()
    assert len(got) == odd.count() and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (3, 4)} == {""}
    assert extract.extract(odd.limit(0)).count() == 0
    for bad in ("<", "<p", "</p>" * 50, "<!--", "<script>x", "&#xFFFFFFFF;", "<div>" * 5000 + "deep text in many boxes.", "<p>a" * 3000):
        extract.main_text(bad)


def brute_nearest(rows, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, v in enumerate(ids):
        if v % 20 == 0:
            s = (x * x[i]).sum(axis=1)
            keep = ids != v
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[int(v)] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_recall_and_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    want = brute_nearest(rows)
    got = {}
    for r in q.op10_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = {i: np.array(v, float) for i, v in rows}
    recall = []
    for i, best in want.items():
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, len(best) + 1))
        assert all(s == (vectors[i] * vectors[v]).sum() for _, v, s in mine)
        recall.append(len({v for _, v, _ in mine} & {v for v, _ in best}) / len(best))
    assert np.mean(recall) >= 0.95
    exact = neighbours.nearest(e, "vec_id % 20 = 0", share=1.0).where("query_id = 20").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in exact] == want[20]


def test_recall_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows)
    assert np.mean([len(got[i] & {v for v, _ in best}) / 20 for i, best in want.items()]) >= 0.9


@pytest.mark.parametrize("cosine", [0.8, 0.95])
def test_search_is_exact_with_a_crowd_and_unequal_lengths(spark, cosine):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = np.sqrt(cosine) * x[0] + np.sqrt(1 - cosine) * x[::3]
    x *= rng.lognormal(0, 0.5, (3000, 1))
    x[40], x[41] = x[40] * 1e200, x[41] * 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(rows)


def test_footrule_by_hand():
    rng = np.random.default_rng(2)
    a, b = (np.stack([rng.permutation(12)[:5] for _ in range(6)]) for _ in "ab")

    def distance(p, r):
        at = lambda o, x: list(o).index(x) if x in o else 5
        return sum(abs(at(p, x) - at(r, x)) for x in range(12))

    gain = neighbours.footrule_gain(a, b, 12)
    assert all(distance(a[i], b[j]) == 2 * sum(5 - r for r in range(5)) - 2 * gain[i, j] for i in range(6) for j in range(6))


def test_odd_vectors(spark):
    good = [(i, [float(i % 5), 1.0, 0.5]) for i in range(30)]
    rows = [
        *good, (50, None), (60, []), (80, [0.0, 0.0, 0.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (140, [None, 1.0, 1.0]),
        (160, [1.0, 2.0]), (161, [3.0, -1.0]), (162, [0.5, 0.5]), (40, [2.0] * 5), (41, [1.0] * 5), (42, [1.0] * 4), (None, [1.0, 1.0, 1.0]),
        (7, good[7][1])
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "near": F.lit(2), "block": F.lit(3)})
    got = neighbours.nearest(df, "vec_id % 20 = 0", k=6).collect()
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, v in usable:
        if i % 20 == 0:
            scored = sorted((-(v * w).sum(), j) for j, w in usable if j != i and len(w) == len(v))[:6]
            assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == [(j, -s) for s, j in scored]
    assert {r.query_id for r in got} == {0, 20, 40, 160}
    few = neighbours.nearest(df.where("vec_id < 3"), "vec_id % 20 = 0").collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
