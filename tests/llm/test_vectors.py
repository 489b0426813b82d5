"""Clustering and hard negatives against full comparisons, with ties, copies, odd vectors and small blocks."""

import hashlib
import math
import random

import numpy as np
import pytest

from docket.llm import clusters, negatives, vectors

SCHEMA = "vec_id long, embedding array<double>, label long, cluster int, x int, score long, q long, p long, norm int, was int"


def frame(spark, rows):
    """Rows of (vec_id, embedding, label) with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, b, 1, 2, 3, 4, 5, 6, 7) for i, v, b in rows], SCHEMA)


def odd(size):
    good = [0.1] * size
    return [(901, None, 1), (902, [], 1), (903, good[:-1], 1), (904, good + [0.1], 1), (905, good[:-1] + [float("nan")], 1), (906, good[:-1] + [float("inf")], 1), (907, good[:-1] + [None], 1)]


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * e) for e in v]) for i, v, _ in rows if v is not None and len(v) == size and all(e is not None and math.isfinite(e) for e in v)]
    hash_of = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (hash_of(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        centres = [[sum(col) // len(col) for col in zip(*mine)] if (mine := [x for (_, x), j in zip(kept, own) if j == c]) else centres[c] for c in range(len(centres))]
    found = [(i, *near(x)) for i, x in kept]
    inertia = [sum(d for _, d, j in found if j == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for i, d, j in found), key=str)


@pytest.mark.parametrize("k,rounds,spread", [(7, 5, 3), (12, 4, 1), (5, 0, 2), (3, 6, 1e5)])
def test_clusters(spark, k, rounds, spread):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-2, -1, 0, 1, 2]) * spread / 256 + rng.choice([0, 0.001]) for _ in range(4)], 0) for i in range(150)]
    rows += [(1, rows[1][1], 0), (None, rows[5][1], None)] + [(1000 + i, [0.5] * 4, 0) for i in range(60)] + odd(4)
    got = clusters.cluster_vectors(frame(spark, rows).repartition(3), k=k, rounds=rounds, size=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows, k, rounds, 4)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(5, [1.0, 2.0], 0), (6, [1.0, 2.0], 0), (7, [-3.5, 0.0], 0)]
    got = clusters.cluster_vectors(frame(spark, rows), k=40, size=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows, 40, 5, 2)
    assert clusters.cluster_vectors(frame(spark, odd(2)[:1]), size=2).collect() == []
    assert clusters.cluster_vectors(frame(spark, []), size=2).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster_vectors(frame(spark, [(1, [1e30, 0.0], 0)]), size=2).collect()


def test_bounds_skip_scans(monkeypatch):
    """Vectors far inside their cluster are not scanned again, and the state stays that of full scans."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-20, 20, (200, 8)) + c for c in (0, 400, -400)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), vectors.packed(x)], names=["vec_id", "x"])
    before, after = x[[0, 200, 400]], np.stack([x[:200].sum(0) // 200, x[200:400].sum(0) // 200, x[400:].sum(0) // 200])
    state = next(clusters.first_round(before)(iter([batch])))
    scanned = []
    scan = clusters._scan
    monkeypatch.setattr(clusters, "_scan", lambda v, c: scanned.append(len(v)) or scan(v, c))
    state = next(clusters.next_round(before, after)(iter([state])))
    assert sum(scanned) == 0
    assert state.column(2).to_pylist() == scan(x, after)[0].tolist()


def test_products_beyond_doubles():
    a = np.array([[1 << 27, -(1 << 27) + 1], [3, 5]])
    assert vectors.products(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(u, v)) for v in a] for u in a]
    assert vectors.squares(a, a[::-1]).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(u, v)) for v in a[::-1]] for u in a]


def brute_negatives(rows, size, every, positives=5, negatives=10):
    kept = [(i, b, [math.floor(256 * e) for e in v]) for i, v, b in rows if i is not None and b is not None and v is not None and len(v) == size and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for at, (i, b, x) in enumerate(kept):
        if i % every:
            continue
        others = [(-sum(p * q for p, q in zip(x, y)), j, c) for k, (j, c, y) in enumerate(kept) if k != at]
        for s, j, _ in sorted(o for o in others if o[2] == b)[:positives]:
            fit = sorted((t, m) for t, m, c in others if c != b and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed,block_rows,leaf,most_depth,query_block", [(1, 40, 5, 4, 3), (2, 4096, 128, 10, 10_000), (3, 16, 16, 3, 5), (4, 100, 7, 0, 4)])
def test_negatives(spark, seed, block_rows, leaf, most_depth, query_block):
    rng = random.Random(seed)
    step = rng.choice([1, 3])
    rows = [(i, [rng.randint(-4, 4) * step / 256 for _ in range(3)], rng.randint(0, 3)) for i in range(300)]
    rows += [(1000 + i, [4 / 256, 3 / 256, 0.0], i % 3) for i in range(150)]  # a vector that a third of all rows share
    rows += [(20, *rows[20][1:]), (40, [0.1, 0.2, 0.3], 1), (None, [0.1] * 3, 1), (960, [0.1] * 3, None), (980, [0.0] * 3, 2), *odd(3)]
    got = negatives.mine_negatives(frame(spark, rows).repartition(4), size=3, every=20, block_rows=block_rows, leaf=leaf, most_depth=most_depth, query_block=query_block, most_sample=120)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 3, 20)


def test_negatives_of_no_rows_or_anchors(spark):
    for rows in ([], odd(3), [(1, [0.1] * 3, 1), (2, [0.2] * 3, 2)], [(100, [0.1] * 3, 1)]):
        assert negatives.mine_negatives(frame(spark, rows), size=3).collect() == []


def test_leaves_are_left_out():
    """Neither leaves beyond the k-th row nor those inside the annulus are read."""
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(-1000, 1000, 1024))[:, None] * np.ones((1, 2), np.int64)
    order, starts, vps, lo, hi = negatives.tree(x.astype(float), 32)
    assert sorted(order.tolist()) == list(range(1024)) and len(starts) == 32
    query = np.array([1, 1])
    scores = (x[order] @ query)
    near, far = np.maximum.reduceat(scores, starts).astype(float), np.minimum.reduceat(scores, starts).astype(float)
    read = []

    class Rows:
        def __getitem__(self, s):
            read.append(s)
            return x[order][s]

    out = list(negatives.nearest_first(Rows(), order, np.ones(1024, bool), np.append(starts, 1024), near, far, query, np.array([200]), np.array([-5000]), 5))
    best = sorted((-int(s), int(i)) for s, i in zip(scores, order) if s <= 200)[:5]
    assert [(-int(s), int(i)) for s, i in zip(out[0][1], out[0][2])] == best
    assert len(read) <= 3
