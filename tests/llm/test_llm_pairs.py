"""Near-dedup, suffix removal and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from chargeweave.llm import ann, minhash, suffixes
from chargeweave.llm.components import components
from pyspark.sql import functions as F


def _words(n, random_):
    return ["".join(random_.choices("abcdefghij", k=random_.randint(2, 6))) for _ in range(n)]


def _edited(words, edits, random_):
    words = list(words)
    for _ in range(edits):
        words[random_.randrange(len(words))] = "".join(random_.choices("klmnop", k=6))
    return words


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base, other, passage = _words(150, r), _words(80, r), " ".join(_words(30, r))
    out = [" ".join(_edited(base, r.randint(0, 5), r)) for _ in range(120)]
    out += [" ".join(_edited(other, r.randint(0, 2), r)) for _ in range(12)]
    out += [" ".join(base)] * 15 + [" ".join(base).upper()]
    out += [" ".join(_words(20, r)) + " " + passage + " " + " ".join(_words(20, r)) for _ in range(30)]
    out += [None, "", "   \n", "one two", "one  two", "One TWO", "one two three", "a" * 700, "ab" * 300, "a" * 99]
    out += ["é" * 200, " ".join(_words(4000, r)), passage, passage]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, i % 3, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[0], 1, "y"), (5, texts[5], 5 % 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, print string").repartition(6).cache()


def _sets(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(texts):
    sets = [_sets(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sets, [root(i) for i in range(len(sets))]


def test_near_dedup_is_brute_force(docs, texts):
    sets, roots = _components(texts)
    found = {}
    for r in minhash.cluster(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert len(found[5]) == 2 and found[5][0] == found[5][1]
    none = found.pop(None)[0]
    assert (none["component_id"], none["kept"]) == (None, True)
    for i, (s, c) in enumerate(zip(sets, roots, strict=True)):
        r = found[i][0]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s), c, c == i)


def test_kept_documents(docs, texts):
    _, roots = _components(texts)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(roots)) and ids.count(None) == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 4), (5, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def _kept(rows):
    seen, out = {}, []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 99):
            first = seen.setdefault(data[s : s + 100], (doc, s))
            if first < (doc, s):
                gone[s : s + 100] = True
        kept = bytes(x for x, g in zip(data, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [4096, 8])
def test_repeats_are_brute_force(docs, texts, split, monkeypatch):
    """With a small SPLIT, common anchors are dealt over shards and merged by range."""
    monkeypatch.setattr(suffixes, "SPLIT", split)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    rows = list(enumerate(texts))
    want = _kept([*rows, (2**63 - 1, texts[0])])
    got = {(r[0] if r[0] is not None else 2**63 - 1): tuple(r) for r in suffixes.report(docs).collect()}
    for w in want:
        assert got[w[0]][1:] == w[1:]


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(5)
    for data in (b"abracadabra" * 9, bytes(r.integers(0, 3, 900, np.uint8)), b"a" * 300, b"\0\0\1\0\0"):
        x = np.frombuffer(data, np.uint8)
        order = suffixes.suffix_array(x)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        lcp = suffixes.common_prefixes(x, order, 100)
        for k in range(1, len(data)):
            a, b = data[order[k - 1] :], data[order[k] :]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == min(n, 100)


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((900, 12)).astype(np.float32).astype(np.float64)
    x[300:600] = x[300]  # a common vector
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    rows += [(1000, None, "b"), (1100, [0.0] * 12, "b"), (1200, [float("nan")] * 12, "b"), (1300, [1.0, 2.0], "b")]
    rows += [(1400, [None] * 12, "b"), (None, x[0].tolist(), "b")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string")
    found = {}
    for q in ann.search(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(q["query_id"], []).append(q)
    assert set(found) == set(range(0, 900, 100))
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        got.sort(key=lambda g: g["rank"])
        assert [g["rank"] for g in got] == list(range(1, 11))
        assert all(g["score"] == pytest.approx(d[g["vec_id"]], rel=1e-12) for g in got)
        assert [(g["score"], g["vec_id"]) for g in got] == sorted((g["score"], g["vec_id"]) for g in got)
        hits += len({g["vec_id"] for g in got} & set(best.tolist()))
        if 300 <= q < 600:
            assert [g["vec_id"] for g in got] == best.tolist()
    assert hits >= 0.9 * 90


@pytest.mark.parametrize("kind", ["table", "wide", "clusters", "few"])
def test_every_query_gets_all_its_rows(spark, kind):
    r = np.random.default_rng(7)
    if kind == "table":
        table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    else:
        n, dim = {"wide": (3000, 128), "clusters": (2500, 24), "few": (7, 5)}[kind]
        x = r.standard_normal((n, dim))
        if kind == "clusters":
            x = r.standard_normal((40, dim))[r.integers(0, 40, n)] + 0.05 * x
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.valid(table).orderBy("vec_id").collect()
    ids, x = np.array([v["vec_id"] for v in rows]), np.array([v["vec"] for v in rows])
    found = {}
    for q in ann.search(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"]))
    asked = [i for i in ids if i % 100 == 0]
    most = min(10, len(ids) - 1)
    assert sorted(found) == asked
    assert all([k for k, _ in sorted(got)] == list(range(1, most + 1)) for got in found.values())
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        order = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len({i for _, i in found[q]} & set(order))
    assert hits >= 0.9 * most * len(asked)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.cluster(docs).count() == 0
    assert suffixes.report(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(vectors, F.col("vec_id") % 100 == 0).count() == 0


def test_repeats_of_rows_without_an_own_id(spark):
    """Rows without doc_id, or with another row's, are cut by their own repeats only."""
    r = random.Random(17)
    p, q = " ".join(_words(40, r)), " ".join(_words(40, r))
    texts = {i: [" ".join(_words(60, r)) for _ in range(6)] for i in (None, 3)}
    for i, found in texts.items():
        found += [f"{p} {i} x", f"{p} {i} y", f"{texts[i][0]} {q}", f"{q} z{i}"]  # p at one start
    rows = [(1, p)] + [(i, t) for i, found in texts.items() for t in found]
    rows += [(None, q), (None, q)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256(x[1].encode()).digest()))
    want = [(order[k][0], *w[1:]) for k, w in enumerate(_kept([(k, t) for k, (_, t) in enumerate(order)]))]
    got = [tuple(x) for x in suffixes.report(table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(n_removed <= n_bytes for _, n_bytes, n_removed, _, _ in got)


def test_texts_that_share_bands_but_no_links_are_not_compared_all_with_all(spark, monkeypatch):
    """Copies with four words left out: few shingles are in one copy only, hardly any pair is linked."""
    r = random.Random(11)
    base, texts = _words(150, r), []
    for _ in range(150):
        out = set(r.sample(range(150), 4))
        texts.append(" ".join(w for i, w in enumerate(base) if i not in out))
    compared, confirmed = [], minhash._confirmed

    def counting(pairs, sets, percent):
        compared.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirmed", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in minhash.cluster(docs).collect()}
    assert got == dict(enumerate(_components(texts)[1]))
    assert len(compared) == 4 and compared[-1] < 3 * len(texts), compared


def test_sets_of_unlike_sizes_are_linked_by_their_rare_shingles(spark):
    """At the least similarity, 85 of 100: all members of a set are in a larger one."""
    a, b, c = list(range(85)), list(range(100)), list(range(1, 100))
    rows = [(i, np.array(x, np.uint64).tobytes()) for i, x in enumerate([a, b, c])]
    counted = minhash.shingle_counts(spark.createDataFrame(rows, "id long, set binary"), 284, 85)
    rare = counted.select("id", "n", F.posexplode("rare").alias("place", "r")).select("id", "n", "place", "r.*", F.col("id").alias("component"))
    got = {tuple(x) for x in minhash.all_across(rare, 85).collect()}
    assert (0, 1) in got and (1, 2) in got
    alone = {x["id"]: x["alone"] for x in minhash.alone_counts(counted).collect()}
    assert alone == {0: 0, 1: 0, 2: 0}


def test_members_that_share_many_buckets_meet_once(spark):
    """Each bucket had every member meet its centers anew."""
    r = random.Random(8)
    rows = [
        (key, id_, r.randint(80, 120), id_ % 7, 40, id_ // 3 * 3)
        for key in range(24) for id_ in range(40) if key < 20 or r.random() < 0.5
    ]
    members = spark.createDataFrame(rows, "key long, id long, n long, place long, members long, component long")
    expected = set()
    for key in range(24):
        own = [x for x in rows if x[0] == key]
        sizes = {}
        for x in own:
            sizes[x[5]] = sizes.get(x[5], 0) + 1
        largest = max((n, c) for c, n in sizes.items())[1]
        outside, inside = ([x for x in own if (x[5] != largest) == side] for side in (True, False))
        centers = [y for side in (outside, inside) for y in sorted(side, key=lambda x: (x[3], x[1]))[: minhash.CENTERS]]
        for x in outside:
            for y in centers:
                if x[5] != y[5] and 100 * min(x[2], y[2]) >= 85 * max(x[2], y[2]):
                    expected.add((min(x[1], y[1]), max(x[1], y[1])))
    assert {tuple(x) for x in minhash.candidates(members, 85).collect()} == expected
    met = minhash._partners(members, F.col("place"), lambda c: F.lit(True)).collect()
    assert len(met) == len({x.id for x in met}) and all(len(x.others) == len(set(x.others)) for x in met)
