"""The stages of the pipeline against brute force, and the pipeline as a whole."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from chargeweave.llm import bpe, minhash, mixing, pii, quality
from test_llm_pairs import _edited, _sets, _words

SMALL = "/root/testdata/sf0.001"


def _roots(texts, percent):
    sets = [_sets(t) for t in texts]
    roots = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((roots[a], roots[b]))
                roots = [x if r == y else r for r in roots]
    return roots


@pytest.fixture(scope="module")
def near(spark):
    """Copies with three of 150 words changed: between 0.80 and 0.85 of the shingles in common."""
    r = random.Random(8)
    texts = []
    for _ in range(20):
        base = _words(150, r)
        copy = list(base)
        for at in (20, 70, 120):
            copy[at] = "zzzzzzz"
        texts += [" ".join(base), " ".join(copy), " ".join(_edited(base, 6, r))]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return texts, docs.cache()


@pytest.mark.parametrize("percent", [80, 85])
def test_percentage_of_near_dedup(near, percent):
    texts, docs = near
    want = _roots(texts, percent)
    assert want != _roots(texts, 165 - percent)
    got = {r["doc_id"]: r["component_id"] for r in minhash.cluster(docs, percent).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_bands_miss_next_to_nothing():
    assert minhash.banding(85) == (24, 5)
    for percent in (50, 80, 85, 95):
        bands, rows = minhash.banding(percent)
        assert bands * rows == minhash.MINIMA and (1 - (percent / 100) ** rows) ** bands < 1e-6


def test_near_dedup_stage(spark, near):
    texts, docs = near
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()]
    assert sorted(kept) == sorted(set(_roots(texts, 80)))


def test_stages_and_run(spark):
    """Each stage against the verdicts of its operator, and run() against the stages in a row."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "PII", "mixing sources", "byte-level BPE"]

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = quality.keep_good(docs).cache()
    assert good.columns == docs.columns
    assert ids(good) == ids(quality.verdicts(docs).where("kept"))
    one = minhash.keep_one(good, 80).cache()
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    order = sorted(texts)
    roots = _roots([texts[i] for i in order], 80)
    assert ids(one) == [order[i] for i in sorted(set(roots))]
    clean = pii.redact(one).cache()
    assert ids(clean) == ids(one)
    times = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()})
    mixed = mixing.apply_copies(clean).cache()
    assert mixed.columns == docs.columns and Counter(ids(mixed)) == +times
    want = bpe.encode(mixed, corpus_pipeline.RANKS, corpus_pipeline.public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_that_share_a_doc_id_go_by_their_texts(spark):
    r = random.Random(9)
    texts = [" ".join(_words(60, r)) for _ in range(4)]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[0], "c"), (2, texts[1], "d"), (3, texts[2], "e"), (3, texts[3], "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted((x["doc_id"], texts.index(x["text"]), x["source"]) for x in minhash.keep_one(docs.repartition(n)).collect()) for n in (1, 4)]
    assert [x[:2] for x in kept[0]] == [(1, 0), (1, 1), (3, 2), (3, 3)] and kept[0] == kept[1]


def test_clashing_columns_and_empty_tables(spark):
    r = random.Random(4)
    texts = [" ".join(_words(80, r)) for _ in range(3)]
    rows = [(i, texts[i % 3], "s", i * 7, f"d{i}", i + 0.5, True) for i in range(6)] + [(None, texts[0], None, 1, "n", 0.0, False)]
    schema = "doc_id long, text string, source string, _row long, doc string, _row_ double, kept boolean"
    docs = spark.createDataFrame(rows, schema)
    for apply in (quality.keep_good, minhash.keep_one):
        got = apply(docs)
        assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(rows)
        assert apply(docs.limit(0)).count() == 0
    assert sorted(map(tuple, quality.keep_good(docs).collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, minhash.keep_one(docs).collect()), key=str) == sorted(rows[:3] + rows[6:], key=str)
