import hashlib
import math
import random
import re
import zlib

import pytest

from tessera.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, bucket string, seq string, id string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "s", "i", "n") for r in rows], SCHEMA)


def brute(rows):
    """All nodes from a dict of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    members, words = {}, lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    ends = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], set()).add(c)
        ends.setdefault(seq, set()).add(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        mine = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in mine) or 1
        saved[p] = sum(saved[x] for x in mine) + (len(members[p]) - 1) * (words(p[-1][1]) if p else 0)
    return list(
        (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p in members
    )


def nodes(spark, rows, **kw):
    got = P.trie(frame(spark, rows).repartition(3), **kw).collect()
    return list((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def branching(n, seed, turns=5, kinds=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(["hello"] * rng.randint(1, kinds))) for c in range(n) for t in range(rng.randint(1, turns))]


def key(x):
    return [(y is None, y) for y in x]


@pytest.mark.parametrize("local", [1, 3, 256])
def test_equals_dict_of_prefixes(spark, local):
    rows = branching(160, 1)
    # A third starts with the same long run of turns and parts late, some are copies, and one stops inside the run.
    shared = [("system", f"rule {i} holds") for i in range(12)]
    for c in range(200, 280):
        rows += [(c, t, *x) for t, x in enumerate(shared[: 12 if c % 7 else 9])] + [(c, 20, "user", f"question {c % 9}")] * (c % 5 > 0)
    assert sorted(nodes(spark, rows, local=local), key=key) == sorted(brute(rows), key=key)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "bot", "a b"), (21, 5, "user", ""), (21, None, "", None), (None, 1, "user", "x"), (40, 1, "user", "x " * 50_000), (41, 1, "user", "x " * 50_000)]
    rows += [(c, 0, "user", "same") for c in range(60, 79)] + [(-3, 1, "user", "neg"), (0, 0, None, "zero")]
    assert sorted(nodes(spark, rows, local=2), key=key) == sorted(brute(rows), key=key)
    assert P.trie(frame(spark, [])).count() == 0 and P.trie(frame(spark, rows[6:7])).count() == 0


def test_copies_are_one_row(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 20) for t in range(3)]
    got = nodes(spark, rows, local=1)
    assert sorted(got, key=key) == sorted(brute(rows), key=key) and len(got) == 4


def test_quicksort_needs_no_recursion():
    long = list(range(5000))
    out = P.Grown()
    P.quicksort([(long + [1], [1] * 5001, 1, 7, "x"), (long + [2], [1] * 5001, 2, 5, "y")], "", 0, 0, out)
    got = out.table().to_pylist()
    assert len(got) == 5002 and got[0] == {"bucket": "", "top": True, "conv_id": 5, "depth": 1, "parent_conv_id": 0, "n_convs": 3, "n_children": 1, "n_leaves": 2, "saved_tokens": 2 * 5000 + 1, "ends_sha256": P.EMPTY}
