"""Hard negatives against brute force, and the bounds that save scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import hard_negatives

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=5):
    """All scores of all anchors; of rows with one id the smallest counts."""
    usable = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i] = min(usable.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a, (label, v) in whole.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in whole.items() if i != a)
        best = [(i, -s) for s, i in scores if whole[i][0] == label][:positives]
        for p, ps in best:
            hard = [(i, -s) for s, i in scores if whole[i][0] != label and 80 * ps <= 100 * -s <= 100 * ps][:negatives]
            out += [(a, p, n, i, ps, s) for n, (i, s) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, step):
    df = spark.createDataFrame(rows, VECTORS).withColumns({"tree": F.lit("clash"), "rank": F.lit(1), "_seat": F.lit(0), "anchor_id": F.lit(0)}).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % step == 0).collect())


@pytest.mark.parametrize("tree_anchors, pass_bytes", [(256, 1 << 24), (7, 1)])
def test_equals_brute_force(spark, monkeypatch, tree_anchors, pass_bytes):
    """Clusters, ties, repeated ids, null and odd values, short and empty vectors; one pass and many."""
    monkeypatch.setattr(hard_negatives, "TREE_ANCHORS", tree_anchors)
    monkeypatch.setattr(hard_negatives, "PASS_BYTES", pass_bytes)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(180):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c], rng.choice([0, 0, 0, 1, 2])))
    rows += [(200 + i, rows[20][1], i % 3) for i in range(12)]
    rows += [(300, [], 0), (301, [1.0, 2.0], 1), (-40, rows[3][1], 2), (20, rows[20][1], rows[20][2]), (20, [0.5] * 6, 0), (40, rows[41][1], 2)]
    rows += [(400, None, 1), (420, [1.0, None], 1), (440, [float("nan")] * 6, 0), (460, [float("inf")] * 6, 0), (480, rows[0][1], None), (None, rows[0][1], 1)]
    want = brute(rows, lambda i: i % 20 == 0)
    assert len(want) > 50 and mined(spark, rows, 20) == want


def test_empty_and_few(spark):
    assert mined(spark, [], 20) == []
    assert mined(spark, [(20, [1.0], 1), (21, [2.0], 2)], 20) == []
    assert mined(spark, [(20, [1.0], 1), (21, [2.0], 1), (22, [1.9], 2)], 20) == [(20, 21, 1, 22, 2 * 256 * 256, 486 * 256)]
    with pytest.raises(Exception):
        mined(spark, [(20, [1e30], 1), (21, [1e30], 1)], 20)


def test_bounds_are_right_and_save_scores():
    """In clusters far from the origin most rows are told by their bounds; none in the window is missed."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (12, 16))
    points = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 3, (1200, 16)))
    anchors = points[::15]
    order, parent, length = hard_negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(len(anchors))) and all(p < k for k, p in enumerate(parent))
    points_in_order = anchors[order]
    assert all(length[k] == pytest.approx(np.linalg.norm(points_in_order[k] - points_in_order[parent[k]])) for k in range(1, len(order)))
    trees = hard_negatives.Trees(order, np.zeros(len(order), np.int64), points_in_order, parent, length, np.array([0, len(order)]))
    top = (points_in_order @ points.T).max(1)
    taken = {}
    scored = hard_negatives.walk(
        trees, np.arange(1200), np.ones(1200, np.int64), points, lambda k: (0.9 * top[k], top[k]),
        lambda k, ids, labels: labels == 1, lambda k, near, found: taken.update({(k, i): s for i, s in zip(near.tolist(), found.tolist())}),
    )
    exact = points_in_order @ points.T
    for k in range(len(order)):
        for i in np.flatnonzero((exact[k] >= 0.9 * top[k]) & (exact[k] <= top[k])):
            assert taken[k, i] == exact[k, i]
    assert scored < 0.5 * exact.size
