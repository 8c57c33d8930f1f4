"""Every stage of the pipeline against brute force on its own input, and odd rows through all of them."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import credentials, quality
from tessera.session import table
from tests.llm.test_alike import brute_groups
from tests.llm.test_documents import brute_mix, brute_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return [table(spark, sf_dir, "documents"), *out]


def test_stages_are_named_and_keep_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "secret scans", "mixing sources", "sentencepiece"]
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert cp.ORACLE_SQL is None


def test_rejected_documents_go(spark, sf_dir, steps):
    model = quality.fit(steps[0], table(spark, sf_dir, "labels"))
    want = sorted(r.doc_id for r in steps[0].collect() if model.score([r.text])[0] >= 0.5)
    assert sorted(r.doc_id for r in steps[1].collect()) == want
    clean = {r.doc_id for r in table(spark, sf_dir, "labels").where("quality = 1").collect()}
    assert len(clean & set(want)) >= 0.97 * len(clean)


def test_one_document_per_group_stays(steps):
    """Groups by the whole rule: prints at most two bits apart, or four fifths of the five-word shingles shared."""
    groups = brute_groups([(r.doc_id, r.text) for r in steps[1].collect()])
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({g for _, g in groups})


def test_secrets_are_masked(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    for r in steps[3].collect():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id].text) == (not credentials.spans(before[r.doc_id].text, *credentials.fitted()))


def test_mix_meets_its_targets(steps):
    rows = steps[3].collect()
    _, _, target = brute_mix(rows)
    words, longest = Counter(), Counter()
    texts = {r.doc_id: r.text for r in rows}
    for r in rows:
        longest[r.source] = max(longest[r.source], len(WORD.findall(r.text)))
    for r in steps[4].collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.text == texts[r.doc_id]
    assert all(abs(words[s] - t) <= longest[s] / 2 + 1 for s, t in target.items())
    assert max(Counter(r.doc_id for r in steps[4].collect()).values()) <= 2


def test_texts_survive_the_ids(steps):
    assert sorted((r.doc_id, r.decoded) for r in steps[5].collect()) == sorted((r.doc_id, r.text) for r in steps[4].collect())


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    assert sorted((r.doc_id, r.n_ids) for r in cp.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.n_ids) for r in steps[5].collect())


def test_odd_rows_pass_all_stages(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, odd string, times int, stays long, `a.b` int, nth int, score double, taken long"
    extra = (1, "x", 2, 3, 4, 5, 0.5, 7)
    rows = [
        (1, "the first document has some words of its own", "en", "a", 44, *extra),
        (1, "the first document has some words of its own", "en", "a", 44, *extra),
        (1, "another text under the same id", None, None, None, *[None] * 8),
        (2, None, "en", "a", None, *extra),
        (3, "", "en", "b", 0, *extra),
        (None, "a text whose id is not known to anyone", "en", "b", 38, *extra),
        (None, None, None, None, None, *[None] * 8),
        (4, "w " * 40_000, "en", "b", 80_000, *extra),
        (5, 'token = "0123456789abcdef0123" é', "en", None, 33, *extra),
    ]
    docs = spark.createDataFrame(rows, schema).withColumn("marks", F.create_map(F.lit("a"), F.col("size"))).withColumn("lists", F.array("marks"))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert cp.encoding_stage(spark, docs, sf_dir).count() == len(rows)
    kept = [r.doc_id for r in cp.near_duplicates_stage(spark, docs, sf_dir).collect()]
    assert Counter(kept) == {1: 2, 2: 1, 4: 1, 5: 1, None: 1}
    texts = {r.text for r in cp.near_duplicates_stage(spark, docs, sf_dir).where("doc_id = 1").collect()}
    assert texts == {rows[0][1], rows[2][1]}
    masked = {r.doc_id: r for r in cp.secrets_stage(spark, docs, sf_dir).collect()}
    assert masked[5].text == '[secret]" é' and masked[5].n_chars == 11
