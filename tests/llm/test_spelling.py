"""Spelling groups against brute force; k-d trees against all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from chargeweave.llm import letters, queries, spelling

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_in(words):
    """All words one inserted, deleted or replaced letter away."""
    held, near, patterns = set(words), defaultdict(set), defaultdict(list)
    for w in held:
        for k in range(len(w)):
            patterns[w[:k], w[k + 1 :]].append(w)
            if (shorter := w[:k] + w[k + 1 :]) in held:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in patterns.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def expected(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near, form = near_in(vocab), {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    rows = []
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), vocab.get(form[w])))
    return sorted(rows, key=repr)


def invented():
    pick = random.Random(5)
    base = ["colour", "color", "colours", "größe", "grösse", "Größe", "stale", "least", "steal", "tesla", "aaaaa", "aaaaaa"]
    base += ["banana", "bananas", "bannana", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149, "four", "ÿÿÿÿÿ", "ÿÿÿÿÀ"]
    words = base + ["".join(pick.choice("abé") for _ in range(pick.randrange(4, 9))) for _ in range(300)]
    docs = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 90)))) for i in range(120)]
    # a chain of forms, each twice as frequent, and ties between near words
    docs += [(500 + i, "chaina " * 3 + "chainab " * 6 + "chainabc, " * 12 + "chainabcd;" * 25) for i in range(4)]
    docs += [(600, "tied! " * 3 + "tieds " * 3 + "tiedt " * 9 + "tiedr " * 9), (600, "tiedr " * 9 + "tiedt " * 9)]
    docs += [(None, "colour " * 40), (None, None), (7, None), (8, ""), (9, "12345 --- \n"), (10, "ab" * 200_000 + " " + "z" * 5)]
    return docs + docs[:5]


@pytest.mark.parametrize("most", [spelling.SHARD, 40])
def test_equals_brute_force(spark, most):
    docs = invented()
    rows = [(i, t, "w", 3, True) for i, t in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, near boolean").repartition(4)
    got = sorted((tuple(r) for r in spelling.report(table, most).collect()), key=repr)
    assert got == expected(docs)
    assert ("chaina", "chainab", "chainabcd", 12, 1, 24) in got


def test_query_on_the_table(spark):
    table = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = queries.op11_spelling_groups(spark, SMALL)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(zip(table.doc_id, table.text))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.report(docs).count() == 0
    none = spark.createDataFrame([(1, None), (2, "a b c"), (None, "")], "doc_id long, text string")
    assert spelling.report(none).count() == 0


def test_index_finds_all_pairs():
    pick = random.Random(2)
    for size, alphabet in ((700, "abc"), (3000, "abcdefàÿ"), (900, "ab")):
        words = {"".join(pick.choice(alphabet) for _ in range(pick.randrange(5, 8))) for _ in range(size)}
        near = near_in(words)
        found = Counter()
        for held_of in (5, 6, 7):
            held = sorted(w for w in words if len(w) == held_of)
            for length in (held_of, held_of - 1):
                given = sorted(w for w in words if len(w) == length)
                if held and given:
                    for i, j in letters.Index(held).near(given):
                        found.update(zip(np.array(given)[i].tolist(), np.array(held)[j].tolist()))
        assert set(found.values()) == {1}
        assert set(found) == {(w, x) for w in words for x in near[w] if len(x) >= len(w)}


def test_shards_hold_each_vector_once_and_reach_all_in_distance():
    pick = np.random.default_rng(3)
    vectors = np.zeros((2000, letters.DIMS), dtype=np.float32)
    vectors[:, :12] = pick.integers(0, 3, (2000, 12))
    shards = letters.Shards(vectors[:400], 2000, 100)
    home = np.full(2000, -1)
    for shard, rows in shards.within(vectors, 0):
        assert (home[rows] == -1).all()
        home[rows] = shard
    assert (home >= 0).all() and shards.count > 8
    reach = {(r, shard) for shard, rows in shards.within(vectors, 2) for r in rows}
    apart = np.abs(vectors[:, None, :12] - vectors[None, :, :12]).sum(2)
    assert all((i, home[j]) in reach for i, j in zip(*np.nonzero(apart <= 2)))
    assert len(reach) < 2000 * shards.count
