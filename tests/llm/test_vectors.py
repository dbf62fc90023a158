"""Hard negatives and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from armscope.llm import hard_negatives as hard
from armscope.llm import learned_partitions as lp
from armscope.llm import vector_blocks

ROWS = "vec_id long, embedding array<float>, label int, grp long, ids string, vec double, query int, score string"


def vectors(seed=5, n=400, dim=12):
    """Clusters, copies, repeated rows and ids, nulls, non-finite parts, zero and other-length vectors."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centers[i % 6] * (1 + i % 3) + rng.normal(size=dim) * 0.3
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    copy = rows[7][1]
    rows += [(1000 + i, copy, 1) for i in range(60)]
    rows += [rows[50], rows[50], (100, rows[3][1], 2), (150, [0.0] * dim, 1), (1500, [0.0] * dim, 2)]
    rows += [(None, copy, 1), (2000, None, 1), (2050, copy, None), (2100, [None] + copy[1:], 1), (2150, [math.nan] + copy[1:], 1)]
    rows += [(2200, [math.inf] + copy[1:], 1), (2250, [1.0, 2.0], 1), (2251, [2.0, 2.0], 1), (2252, [1.0, 1.0], 2), (2300, [], 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, 2, "y") for r in rows], ROWS)


def brute_negatives(rows, spec):
    own = [
        (i, label, tuple(math.floor(spec.scale * x) for x in v))
        for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, z in {r for r in own if r[0] % 50 == 0}:
        others = [(-sum(a * b for a, b in zip(z, y)), k, m) for k, m, y in own if k != i and len(y) == len(z)]
        positives = sorted((s, k) for s, k, m in others if m == label)[: spec.positives]
        for s, k in positives:
            fits = sorted((t, n) for t, n, m in others if m != label and spec.low * -s <= 100 * -t <= spec.high * -s)
            out += [(i, k, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(fits[: spec.negatives])]
    return sorted(out)


def mined(docs, spec):
    found = hard.hard_negatives(docs.withColumn("anchor", F.col("vec_id") % 50 == 0), spec)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.select(*names).collect())


@pytest.mark.parametrize("block,group", [(1 << 16, 128), (600, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(vector_blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(vector_blocks, "GROUP_BLOCKS", group)
    monkeypatch.setattr(vector_blocks, "VISITS", 3)
    spec = hard.HardNegatives(references=4, sample=64)
    assert mined(table(spark, vectors()), spec) == brute_negatives(vectors(), spec)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-4e5, 4e5))) for _ in range(6)], i % 3) for i in range(120)]
    spec = hard.HardNegatives()
    found = brute_negatives(rows, spec)
    assert found and max(abs(r[4]) for r in found) > 2**53
    assert mined(table(spark, rows), spec) == found


def test_no_vectors(spark):
    assert mined(table(spark, [(1, None, 1)]).limit(0), hard.HardNegatives()) == []
    assert mined(table(spark, [(50, None, 1), (100, [1.0], None)]), hard.HardNegatives()) == []


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 32)) * 100
    z = np.floor(np.concatenate([c + rng.normal(size=(80, 32)) * 3 for c in centers]))
    references = {32: hard.far_directions(z, 8)}
    boxes = np.array([np.frombuffer(hard.box_note(references)(z[k : k + 20]), np.float64) for k in range(0, 400, 20)])
    closed = 0
    for i in range(0, 400, 37):
        low, high = hard.score_bounds(z[i], hard.angles(z[i : i + 1], references[32])[0], boxes)
        scores = (z @ z[i]).reshape(20, 20)
        assert (low <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high).all()
        closed += int((high < scores.max() * 0.5).sum())
    assert closed > 100  # of 220: most blocks of other clusters need no scoring


def brute_nearest(rows, count=10):
    own = [
        (i, tuple(v)) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for i, v in sorted({r for r in own if r[0] % 100 == 0}):
        found = sorted((math.dist(v, y), k) for k, y in own if k != i and len(y) == len(v))[:count]
        out.setdefault(i, []).append([(k, d) for d, k in found])
    return out


def searched(docs, spec):
    found = lp.nearest_neighbours(docs.withColumn("query", F.col("vec_id") % 100 == 0), spec).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.query_no, r.rank)):
        out.setdefault(r.query_id, {}).setdefault(r.query_no, []).append((r.rank, r.vec_id, r.score))
    return out


def test_whole_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(vector_blocks, "GROUP_BLOCKS", 3)
    got = searched(table(spark, vectors()), lp.LearnedPartitions(sample=128, partitions=4, recall=1.0))
    want = brute_nearest(vectors())
    assert set(got) == {i for i, lists in want.items() if any(lists)}
    for i, lists in want.items():
        mine = [[(k, s) for _, k, s in sorted(rows)] for rows in got.get(i, {}).values()]
        lists = [rows for rows in lists if rows]
        assert sorted([k for k, _ in rows] for rows in mine) == sorted([k for k, _ in rows] for rows in lists)
        assert all(rank == n + 1 for rows in got.get(i, {}).values() for n, (rank, _, _) in enumerate(sorted(rows)))
        close = zip(sorted(mine), sorted(lists))
        assert all(abs(a - b) < 1e-12 for m, w in close for (_, a), (_, b) in zip(m, w))


def test_recall_with_few_parts_searched(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 16)) * 3
    x = (centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spec = lp.LearnedPartitions(sample=1500, partitions=16)
    docs = table(spark, rows)
    model = lp.router(lp.taking_part(docs.withColumn("query", F.lit(False))), spec)
    assert model.probes <= 8
    got, want = searched(docs, spec), brute_nearest(rows)
    hit = sum(len({k for _, k, _ in next(iter(got[i].values()))} & {k for k, _ in want[i][0]}) for i in want)
    assert hit >= 0.9 * sum(len(lists[0]) for lists in want.values())


def test_parts_are_equal_and_cut_few_edges():
    rng = np.random.default_rng(1)
    edges = np.array([(8 * (a // 8) + rng.integers(0, 8), a) for a in range(256) for _ in range(6)])
    shuffled = rng.permutation(256)
    part = lp.balanced_parts(256, shuffled[edges], 8, 3)
    assert set(np.bincount(part)) == {32}
    across = (part[shuffled[edges[:, 0]]] != part[shuffled[edges[:, 1]]]).mean()
    assert across < 0.3  # 0.875 by chance


def test_nothing_to_search(spark):
    assert searched(table(spark, [(1, None, 1)]).limit(0), lp.LearnedPartitions()) == {}
    assert searched(table(spark, [(100, [0.0], 1), (200, [1.0], 1), (201, None, 1)]), lp.LearnedPartitions()) == {}
