"""The prefix trie against brute force, and the spilling queue."""

import hashlib
import random
import zlib

import pytest

from chargeweave.llm import prefixes
from chargeweave.llm.timeforward import SpillingQueue, subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, h int"


def expected(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append(((turn is not None, turn or 0), role or "", text or ""))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = sorted(convs.get(c - c % 5, []))[:h]
        rebuilt[c] = [t[1:] for t in first + sorted(turns)[h:]]
    members, below = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        kids = below.get(node, [])
        totals[node] = (sum(totals[k][0] for k in kids) or 1, own + sum(totals[k][1] for k in kids))
        ends = sorted(c for c in members[node] if len(rebuilt[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append(
            (min(members[node]), len(node), parent, len(members[node]), len(kids), *totals[node], digest)
        )
    return sorted(out, key=repr)


def invented(seed, n=60):
    """Few different turns, so that prefixes are shared; long, hot, missing and odd ones too."""
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 10 == 0 and pick.random() < 0.4:
            continue  # opens others, but is absent
        for t in range(pick.randrange(1, 12)):
            role = pick.choice(["user", "assistant", None])
            rows.append((c, pick.choice([t, t, None]), role, pick.choice(["a", "é" * 3, "", None])))
    rows += [(1000 + c, t, "user", "same") for c in range(40) for t in range(4)]
    rows += [(5000, t, "user", f"long {t // 2}") for t in range(2500)]
    rows += [(5001, t, "user", f"long {t // 2}") for t in range(2500)]
    rows += [(None, 1, "user", "no id"), (7000, 0, "user", "alone"), (7003, None, None, None), (7003, None, None, None)]
    return rows + rows[5:9] + [(8000, 0, "user", "x" * 300_000), (8001, 0, "user", "x" * 300_000)]


def ran(spark, rows, parts=4, **settings):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).repartition(parts)
    convs, turns = prefixes.rebuild(prefixes.number(table))
    return sorted((tuple(r) for r in prefixes.trie(convs, turns, **settings).collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"heavy": 3, "held": 2}])
def test_equals_brute_force(spark, settings):
    rows = invented(3)
    assert ran(spark, rows, **settings) == expected(rows)


def test_small_tables(spark):
    assert ran(spark, []) == [] and ran(spark, [(None, 1, "user", "x")]) == []
    # 3 opens with conversation 0, which is absent: only turns after its first h are left
    rows = [(3, 1, "user", "x")]
    got = ran(spark, rows)
    assert got == expected(rows) and len(got) in (1, 2)


def test_queue_spills_and_keeps_order():
    pick = random.Random(1)
    queue, held = SpillingQueue(20), []
    for _ in range(5000):
        if held and pick.random() < 0.45:
            held.sort()
            assert queue.least() == held[0] and queue.pop() == held.pop(0)
        else:
            held.append((pick.randrange(1000), pick.random()))
            queue.push(held[-1])
    assert queue.spilled > 20
    assert [queue.pop() for _ in held] == sorted(held) and queue.least() is None


def test_totals_of_a_tree_larger_than_the_queue():
    parent = {k: (k - 1) // 3 for k in range(1, 4000)}
    depth = {0: 0}
    for k in range(1, 4000):
        depth[k] = depth[parent[k]] + 1
    order = sorted(depth, key=lambda k: (-depth[k], f"{k:05d}"))
    nodes = [(depth[k], f"{k:05d}", f"{parent[k]:05d}" if k else None, (0, k), 0) for k in order]
    found = {key: (n, *totals) for _, key, n, totals in subtree_totals(nodes, held=16)}
    assert found["00000"] == (3, sum(1 for k in depth if 3 * k + 1 >= 4000), sum(depth))
    with pytest.raises(ValueError):
        list(subtree_totals([(1, "b", "a", (0, 1), 0)]))
