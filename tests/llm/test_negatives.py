"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest

from affinity.llm.negatives import Best, RTree, bounds, hard_negatives, leaf_order, search_tree
from tests.llm import cases


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    q = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    label = {i: lab for i, lab, _ in rows}
    out = []
    for a in anchors:
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[i])), i) for i in q if i != a and len(q[i]) == len(q[a]))
        for s, p in [x for x in scored if label[x[1]] == label[a]][:positives]:
            fits = [x for x in scored if label[x[1]] != label[a] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits[:negatives])]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                  for r in df.collect())


@pytest.mark.parametrize("scale, tile_rows", [(1.0, 8192), (1.0, 20), (3e4, 20)])
def test_against_brute_force(spark, scale, tile_rows):
    """Clusters, copies, ties, a label of most rows; products beyond the exact range of doubles."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2])), (centers[i % 6] + 0.3 * rng.normal(size=8)) * scale) for i in range(300)]
    rows[100:140] = [(i, i % 2, rows[100][2]) for i in range(100, 140)]
    rows += [(i, i % 3, rng.integers(-1, 2, size=3).astype(float)) for i in range(400, 440)]
    rows = [(i, lab, [float(x) for x in v]) for i, lab, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives(df, df.filter("vec_id % 10 = 0"), tile_rows=tile_rows)
    assert found(got) == brute(rows, [i for i, _, _ in rows if i % 10 == 0])


def test_odd_rows(spark):
    odd = cases.embeddings(spark).selectExpr("*", "cast(vec_id % 2 as int) as label", "'z' as tile", "1 as q")
    got = hard_negatives(odd, odd, low=0, high=100)
    usable = [(1, 1, [1.0, 0, 0]), (2, 0, [1.0, 0, 0]), (3, 1, [2.0, 0, 0]), (4, 0, [0, 1.0, 0.5]), (6, 0, [0.0, 0, 0]),
              (10, 0, [0.5, 0.5, 0.10000000149]), (12, 0, [0, 1.0, 0.5]), (13, 1, [1.0, 1.0])]
    assert found(got) == brute(usable, [i for i, _, _ in usable], low=0, high=100)
    assert not hard_negatives(odd.limit(0), odd).collect() and not hard_negatives(odd, odd.limit(0)).collect()
    huge = spark.createDataFrame(
        [(1, 1, [1e30, 1.0]), (2, 1, [1.0, 1.0]), (3, 2, [0.9, 0.9]), (4, None, [1.0, 1.0]), (5, 1, [1.0, 1.0])],
        "vec_id long, label int, embedding array<double>")
    assert found(hard_negatives(huge, huge)) == [
        (2, 5, 1, 3, 131072, 117760), (5, 2, 1, 3, 131072, 117760)]


def test_boxes_bound_and_prune():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(64, 6)) * 200
    rows = np.floor(np.repeat(centers, 64, axis=0) + rng.normal(size=(4096, 6))).astype(np.int64)
    order = leaf_order(rows)
    assert sorted(order.tolist()) == list(range(4096))
    tree = RTree(order, rows[order])
    least, most = bounds(*tree.boxes, rows[:5])
    for b in range(tree.leaves):
        scores = rows[:5] @ tree.raw[tree.starts[b]:tree.starts[b + 1]].T
        assert (least[:, b] <= scores.min(axis=1)).all() and (most[:, b] >= scores.max(axis=1)).all()
    read = []
    for i in range(5):
        best = Best(np.array([-1 << 62]), np.array([1 << 62]), np.array([-1 << 62]), 5)
        read.append(search_tree(tree, rows[i], least[i], most[i], tree.raw, -1, best))
        scores = rows @ rows[i]
        assert best.kept[0][0].tolist() == np.lexsort((np.arange(4096), -scores))[:5].tolist()
    assert max(read) < tree.leaves // 4
