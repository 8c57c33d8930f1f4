"""Vector codes, ranked search and decontamination against brute force, with odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate, ranking, vectorcodes


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Everything in Python integers, without bounds."""
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, _, v in kept}:
        own = [r for r in kept if len(r[2]) == d]
        w = max(1, -(-d // parts))
        cut = [[(v + [0] * (w * parts - d))[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in own]
        order = sorted(range(len(own)), key=lambda i: (own[i][0] is None, own[i][0] or 0, own[i][2]))[:entries]
        books = [[cut[i][p] for i in order] for p in range(parts)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        for _ in range(rounds):
            code = assign()
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [c[p] for c, k in zip(cut, code, strict=True) if k[p] == e]
                    if mine:
                        books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        code = assign()
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, lab, _), c, k in zip(own, cut, code, strict=True):
            out.append((i, lab, "".join(f"{x:02x}" for x in k), sum(far(c[p], books[p][k[p]]) for p in range(parts)), digest))
    total = Counter()
    for r in out:
        total[r[1]] += r[3]
    return sorted(map(str, ((i, c, e, total[lab], g) for i, lab, c, e, g in out)))


def coded(df, **more):
    return sorted(map(str, ((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.compress(df, **more).collect())))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(0, 0.1, 32).round(2).tolist(), int(i % 5)) for i in rng.permutation(150)]
    rows += [(200 + i, [0.25] * 32, None) for i in range(40)]  # equal vectors, null labels
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, [0.5] * 32, 2)]
    rows += [(300, None, 1), (301, [], 1), (302, [], None), (303, [None] * 32, 1), (304, [float("nan")] * 32, 1), (305, [float("inf")] + [0.0] * 31, 1)]
    rows += [(400 + i, [0.1 * i, -0.1, 1.0], 9) for i in range(5)]  # another length, no multiple of the parts
    return rows


KIND = "vec_id long, embedding array<double>, label int"


def test_codes_equal_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, KIND).repartition(5)
    assert coded(df) == brute_codes(vectors)
    assert coded(df, parts=4, entries=7, rounds=3) == brute_codes(vectors, 4, 7, 3)
    assert vectorcodes.compress(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 as code", "2 as v", "'x' as codebooks_sha256", "3 as error")
    assert coded(clash) == brute_codes(vectors)
    with pytest.raises(ValueError):
        vectorcodes.compress(df, entries=257)


def test_huge_components_are_clipped(spark):
    rows = [(i, [1e300 * (-1) ** i, 3e38] + [0.0] * 62, 0) for i in range(3)] + [(9, [1.0] * 64, 0)]
    got = vectorcodes.compress(spark.createDataFrame(rows, KIND), rounds=0, entries=1).collect()
    errors = {r.vec_id: r.error for r in got}
    assert errors[0] == errors[2] == 0 and errors[1] == 1 << 56
    assert {r.label_error for r in got} == {sum(errors.values())}


def test_bounds_skip_scans_and_never_decide_ties():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (4000, 4))
    old = x[:64].copy()
    new = old + rng.integers(-1, 2, old.shape)
    code, upper, lower = vectorcodes.scan(x, old)
    far = np.sqrt(vectorcodes.squares(x, old).astype(float))
    assert (upper >= far.min(axis=1)).all() and (lower <= np.partition(far, 1, axis=1)[:, 1]).all()
    again, upper, lower, scanned = vectorcodes.rescan(x, old, new, code, upper, lower)
    assert (again == vectorcodes.squares(x, new).argmin(axis=1)).all()
    assert 0 < len(scanned) < len(x)
    far = np.sqrt(vectorcodes.squares(x, new).astype(float))
    assert (upper >= far.min(axis=1)).all() and (lower <= np.partition(far, 1, axis=1)[:, 1]).all()
    big = rng.integers(-(1 << 27), 1 << 27, (50, 4))
    assert vectorcodes.squares(big, big[:5]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in big[:5]] for r in big]


TERM, WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_search(docs, items, k):
    counts = [(i, Counter(re.findall(TERM, low(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(re.findall(TERM, low(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 75 + 25 * c.total() * n_docs // length
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(times * weight(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def searched(docs, items, k=20):
    return sorted(map(str, ((r.item_id, r.rank, r.doc_id, r.score) for r in ranking.search(docs, items, k).collect())))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x y", "日本", "Z9"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    some = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(i, some(int(rng.integers(1, 120)))) for i in range(250)]
    docs += [(500 + i, docs[7][1]) for i in range(40)] + [docs[3], docs[3], (None, docs[4][1]), (600, None), (601, ""), (602, ";;\x00 \t"), (603, "w1 " * 30_000)]
    items = [(i, some(int(rng.integers(1, 40)))) for i in range(20)] + [(3, "w1 w1 w2"), (None, "w5 W6"), (90, ""), (91, None), (92, "nowhere"), (93, docs[7][1].upper())]
    return docs, items


def test_search_equals_brute_force(spark, texts, monkeypatch):
    docs, items = texts
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = brute_search(docs, items, 5)
    assert searched(d, q, 5) == want
    assert searched(d.selectExpr("*", "1 as n", "2 as term", "3 as item_id"), q.selectExpr("*", "1 as doc_id", "4 as rank"), 5) == want
    assert searched(d.limit(0), q) == searched(d, q.limit(0)) == []
    # many batches of documents, several passes over the items, terms that are joined rather than broadcast
    monkeypatch.setattr(ranking, "BATCH", 200)
    monkeypatch.setattr(ranking, "FEW", 40)
    assert searched(d, q, 5) == want
    assert searched(d, q, 400) == brute_search(docs, items, 400)


def test_terms_across_portions(monkeypatch):
    text = ("ab Cd " * 50 + "é" * 70 + " " + "q" * 90 + "!x").encode()
    want = ranking.term_counts(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(ranking, "PORTION", size)
        assert ranking.term_counts(text) == want
    assert want[b"cd"] == 50 and want["é".encode() * 70] == 1 and want[b"q" * 90] == 1 and want[b"x"] == 1


def brute_report(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = re.findall(WORD, low(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[a : a + k]), set()).add(i)
    lengths = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w = re.findall(WORD, low(t))
        hit, named = set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in grams:
                    hit |= set(range(a, a + k))
                    named |= grams[g]
        ids = sorted(str(x) for x in named if x is not None)
        out.append((i, t, hit, (i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))))
    return out


def brute_cut(text, hit):
    pieces = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", text or "")
    lead = (text or "")[: len(text or "") - sum(map(len, pieces))]
    return lead + "".join(p for i, p in enumerate(pieces) if i not in hit) if hit else text


@pytest.fixture(scope="module")
def leaks():
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(200)] + ["Ünique", "ünique", "ABC", "日"]
    some = lambda n: [str(x) for x in rng.choice(words, n)]
    items = [(i, " ".join(some(int(rng.integers(4, 40))))) for i in range(12)] + [(20, "one two"), (21, ""), (22, None), (23, "!?"), (None, " ".join(some(15)))]
    items += [(4, items[5][1]), items[6], (30, " ".join(["again"] * 14))]
    docs = []
    for i in range(120):
        body = some(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            source = (items[int(rng.integers(0, len(items)))][1] or "").split()
            a = int(rng.integers(0, max(1, len(source) - 9)))
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = source[a : a + int(rng.integers(8, 25))]
        docs.append((i, [" ", ", ", "\n\x0b"][i % 3].join(body).upper() if i % 4 == 0 else " ".join(body)))
    long = " ".join(some(30_000))
    return docs + [docs[3], (3, "other"), (None, items[0][1]), (200, None), (201, ""), (202, "..."), (203, ". " + items[1][1] + "!"), (204, "again " * 60), (205, long + " one TWO")], items


def told(df):
    return sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())))


def test_report_equals_brute_force(spark, leaks, monkeypatch):
    docs, items = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(str(r[3]) for r in brute_report(docs, items))
    assert told(decontaminate.report(d, b)) == want
    assert told(decontaminate.report(d.selectExpr("*", "1 as pos", "2 as gram", "3 as n_words", "4 as key"), b.selectExpr("*", "5 as hash", "6 as doc_id"))) == want
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert not any(r.contaminated or r.n_hit or r.n_items for r in decontaminate.report(d, b.limit(0)).collect())
    monkeypatch.setattr(decontaminate, "HELD", 50)
    assert told(decontaminate.report(d, b)) == want


def test_spans_and_documents_are_removed(spark, leaks):
    docs, items = leaks
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string")
    brute = brute_report(docs, items)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(decontaminate.cleaned(d, b)) == sorted(str((i, brute_cut(t, hit), "k")) for i, t, hit, _ in brute)
    assert rows(decontaminate.cleaned(d, b, how="documents")) == sorted(str((i, t, "k")) for i, t, hit, _ in brute if not hit)
    with pytest.raises(ValueError):
        decontaminate.cleaned(d, b, how="x")


def test_no_python_on_the_main_path(spark, leaks):
    docs, items = leaks
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    grams = decontaminate.windows(b)
    plan = decontaminate.occurrences(d, grams.select("hash", "gram"), [10], 10)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin [probe" in plan
