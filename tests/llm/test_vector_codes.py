import hashlib
import random

import numpy as np

from tessera.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, q string, entry string, error string"


def brute(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error)} and the codebooks' digest, every distance computed with Python's integers."""
    rows = sorted(rows)
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows}
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(x[i], p) for i, _ in rows[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for v in x.values():
                mine.setdefault(near(v, p), []).append(cut(v, p))
            for e, members in mine.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = {}
    for i, v in x.items():
        at = [near(v, p) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e in at), sum(dist(cut(v, p), books[p][e]) for p, e in enumerate(at)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "q", "e", "x") for i, v, y in rows], SCHEMA)


def vectors(n, dims, seed, spread=1.0, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.gauss(0, spread)) if grid is None else (lambda: rng.randint(-grid, grid) / 256)
    return [(i * 3, [value() for _ in range(dims)], rng.choice([1, 2, None])) for i in range(n)]


def test_equals_brute_force(spark):
    # Coarse grids make ties of distance, equal vectors and equal entries the usual case.
    for rows in (vectors(300, 32, 1), vectors(400, 32, 2, grid=2), vectors(200, 16, 3, grid=1), vectors(70, 48, 4, spread=300.0), vectors(40, 32, 5)):
        want, name = brute([r[:2] for r in rows])
        got = V.encode(frame(spark, rows).repartition(3)).collect()
        assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {name}
        for label in (1, 2, None):
            mine = {i for i, _, y in rows if y == label}
            assert {r.label_error for r in got if r.vec_id in mine} == {sum(want[i][1] for i in mine)}


def test_pruning_leaves_most_distances_out():
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-40, 41, (5000, 4))
    near, far = V.nearest_of_all(x, centres)
    moved = centres + rng.integers(-3, 4, centres.shape)
    shift = np.sqrt(((moved - centres) ** 2).sum(1))
    root = np.sqrt(far)
    entry, upper, lower, seen = V.reassign(x, near, root[np.arange(5000), near] + shift[near], np.maximum(0, root - shift), moved)
    want, far = V.nearest_of_all(x, moved)
    assert (entry == want).all() and seen < 0.05 * far.size
    assert (upper >= np.sqrt(far[np.arange(5000), want])).all() and (lower <= np.sqrt(far)).all()


def test_large_integers_are_exact():
    x = np.array([[1 << 27, 0], [-(1 << 27), 1]])
    book = np.array([[-(1 << 27), 0], [1 << 27, 1]])
    near, far = V.nearest_of_all(x, book)
    assert near.tolist() == [1, 0] and far.tolist() == [[1 << 56, 1], [1, 1 << 56]]


def test_awkward_rows(spark):
    rows = vectors(100, 32, 7)
    bad = [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, None), (504, [0.0, None] * 16, 2)]
    odd = [(600, [1.0] * 5, 9), (601, [], 9), (602, [3e38] * 32, 9), (None, rows[0][1], 8), (3, rows[1][1], 8)]
    got = V.encode(frame(spark, rows + bad + odd)).collect()
    want, _ = brute([r[:2] for r in rows])
    assert len(got) == 100 + len(odd)
    by = {r.vec_id: r for r in got}
    assert not {500, 501, 502, 503, 504} & set(by)
    assert all(by[i].code is None and by[i].error is None and by[i].label_error is None for i in (600, 601, 602))
    assert by[None].code is not None and len([r for r in got if r.vec_id == 3 and r.code == by[3].code]) == 2
    assert V.encode(frame(spark, [])).count() == 0
    assert [r.code for r in V.encode(frame(spark, bad[:1] + [(1, [], 1)])).collect()] == [None]
    # A length that is no multiple of the parts is filled up with zeros.
    short = V.encode(frame(spark, [(i, v[:20], y) for i, v, y in rows])).collect()
    assert len({r.code for r in short}) > 50 and all(len(r.code) == 32 for r in short)
    assert want
