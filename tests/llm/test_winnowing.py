"""Benchmark decontamination against brute force, with the odd rows."""

import hashlib
import random
import re

import pytest

from chargeweave.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    held = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    rows = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(g) for g in held}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in held:
                    hit.update(range(k, k + n))
                    met |= held[g]
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        rows.append((doc_id, len(w), len(hit), len(met), digest, bool(hit)))
    return sorted(rows, key=repr)


def passage(seed, n, of=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(of)}" for _ in range(n))


ITEMS = [
    (1, passage(1, 40)), (2, passage(2, 10)), (3, passage(3, 11) + "\n" + passage(1, 25)), (10, "Only three words"),
    (4, "solo"), (5, ""), (6, None), (None, passage(7, 30)), (None, "an item's pair"), (8, passage(8, 9)),
    (9, passage(1, 40)), (9, passage(9, 12)), (11, "la la la la la la la la la la la la la la"), (12, "Ärger ÄRGER ñandú"),
]
DOCS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "clean words, nothing else"), (4, passage(1, 40)),
    (5, "x " + passage(2, 10) + " y"), (6, passage(2, 9)), (7, passage(1, 40).replace(" ", "--").upper()),
    (8, "only THREE words; only three words"), (9, "so. solo, so"), (9, "so. solo, so"), (9, passage(3, 11)),
    (None, passage(7, 30)), (None, passage(7, 12)), (10, "la " * 5000), (11, passage(5, 9000) + " " + passage(9, 12)),
    (12, passage(8, 9) + " q " + passage(8, 8)), (13, "ärger ÄRGER ñandú"), (14, "Ärger Ärger ÄRGER ñandú 9"),
    (15, " ".join(passage(1, 40).split()[5:20] + ["z"] + passage(1, 40).split()[18:33])),
    *((100 + i, passage(1000 + i, 30) + " " + passage(1, 40 - i % 32)) for i in range(64)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 3, [1], "k") for i, t in DOCS]
    schema = "doc_id long, text string, spans string, n_words int, hits array<int>, key string"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, t, "w", 1) for i, t in ITEMS]
    return spark.createDataFrame(rows, "item_id long, text string, item string, span int").repartition(2)


@pytest.mark.parametrize("bits", [winnowing.BITS, 64])
def test_equals_brute_force(docs, items, bits, monkeypatch):
    monkeypatch.setattr(winnowing.find, "__defaults__", (bits,))
    got = sorted((tuple(r) for r in winnowing.report(docs, items).collect()), key=repr)
    assert got == expected(DOCS, ITEMS)


def test_spans_are_maximal_runs(docs, items):
    found = {r["doc_id"]: r for r in winnowing.find(docs, items).collect()}
    assert [tuple(s) for s in found[5]["spans"]] == [(1, 11)] and found[5]["items"] == ["2"]
    assert [tuple(s) for s in found[15]["spans"]] == [(0, 15), (16, 31)]
    assert found[4]["items"] == ["1", "3", "9"] and found[0]["spans"] == []


def test_empty_tables(docs, items):
    none = winnowing.report(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r["contaminated"] for r in none)
    assert {r["items_sha256"] for r in none} == {hashlib.sha256(b"").hexdigest()}
    assert winnowing.report(docs.limit(0), items).count() == 0


def test_every_shared_window_shares_a_fingerprint(spark):
    from pyspark.sql import functions as F

    rows = [(passage(i, 10, of=8),) for i in range(200)]
    both = spark.createDataFrame([(w, f"a b {w} c d") for (w,) in rows], "w string, around string")
    prints = [winnowing.winnow(winnowing.words(F.col(c)), 10) for c in ("w", "around")]
    assert both.where(F.size(F.array_except(*prints)) > 0).count() == 0
