"""Near copies by five-word shingles against brute force."""

import numpy as np
import pytest

import corpus_pipeline as cp
from tessera.llm import alike
from tessera.session import table
from tests.llm.test_documents import brute_simhash


def brute_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets, prints = [brute_sets(t) for _, t in rows], [brute_simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and ((prints[i] ^ prints[j]).bit_count() <= 2 or sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i] | sets[j]))):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows)))


def components(found):
    """``(doc_id, least id of the group)`` of rows with a component."""
    least = {}
    for r in found:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    return sorted((r.doc_id, least[r.component]) for r in found for _ in range(r.times))


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_groups_match_brute_force(spark, sf_dir):
    rng = np.random.default_rng(3)
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts += [" ".join(words)] + [edited(rng, words, int(n)) for n in rng.integers(1, 9, 6)]
    texts += [None, "", "one two", "One  two", "one two three"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = alike.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert components(got) == brute_groups(rows)


def test_least_of_a_band_need_not_be_near(spark, monkeypatch):
    # every set meets every other one in the only band, so most are compared after the stars
    monkeypatch.setattr(alike, "bands", lambda hashes: np.zeros(min(1, len(hashes)), np.int64))
    rng = np.random.default_rng(6)
    rows = []
    for g in range(5):
        words = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        rows += [(10 * g + i, edited(rng, words, i)) for i in range(4)]
    got = alike.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert components(got) == brute_groups(rows)


@pytest.mark.parametrize("changes", [1, 2])
def test_stage_drops_near_copies_that_simhash_misses(spark, changes):
    rng, rows = np.random.default_rng(changes), []
    for g in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, edited(rng, words, changes))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_duplicates_stage(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_pairs_that_the_stars_miss_are_found_and_few_are_tried(spark, monkeypatch):
    # a crowd around one text, most of its members too far from each other, some pairs within four fifths
    rng, rows = np.random.default_rng(9), []
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    for i in range(60):
        text = edited(rng, base, int(rng.integers(3, 14)))
        rows += [(2 * i, text), (2 * i + 1, edited(rng, text.split(), 2))]
    tried = []
    plain = alike.verified
    monkeypatch.setattr(alike, "verified", lambda pairs, sets: tried.append(pairs.count()) or plain(pairs, sets))
    got = alike.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert components(got) == brute_groups(rows)
    assert sum(tried) < len(rows) * 20


@pytest.mark.parametrize("seed", range(4))
def test_sketch_never_rules_out_a_near_copy(spark, seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 5 + 1)) :], rng.integers(0, 1 << 62, int(rng.integers(0, len(a) // 5 + 1))).astype(np.uint64)]))
        alone = sum(int(x).bit_count() for x in (alike.sketch(a) ^ alike.sketch(b)).view(np.uint64))
        assert alone <= len(np.setxor1d(a, b))


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert alike.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (1, ""), (1, "a b  c"), (1, "x y z")]
    got = alike.leavers(spark.createDataFrame(rows, schema)).collect()
    keys = {t: spark.createDataFrame([(t,)], "t string").select(alike.text_key(alike.F.col("t")).alias("k")).head().k for _, t in rows}
    found = {(r.doc_id, r.key): r.goes for r in got}
    assert found[(None, keys["a b c"])] is True
    assert (1, keys["a b  c"]) not in found and (1, keys["x y z"]) not in found
    assert sorted(found.get((1, keys[t])) is True for t in (None, "")) == [False, True]


def test_a_crowd_that_its_least_set_leaves_apart_is_not_compared_in_pairs(spark, monkeypatch):
    """Sets that differ from a common text in a few places: some pairs are near copies, most of the crowd hangs together."""
    monkeypatch.setattr(alike, "bands", lambda hashes: np.arange(min(8, len(hashes))))
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = [(i, edited(rng, words, int(n))) for i, n in enumerate(rng.integers(2, 4, 150))]
    seen, once = [], alike.prefix_pairs
    monkeypatch.setattr(alike, "prefix_pairs", lambda sets, nodes: seen.append(once(sets, nodes).count()) or once(sets, nodes))
    got = alike.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert components(got) == brute_groups(rows)
    monkeypatch.setattr(alike, "dealt_pairs", lambda torn: torn.selectExpr("shape as a", "shape as b").limit(0))
    alike.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 3 * seen[0] <= seen[1]
