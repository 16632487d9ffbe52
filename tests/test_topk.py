import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.operators import interaction_matrix, top_k_scores, topk
from affinity.session import written


def frame(spark, vectors, kind="int"):
    data = [(i if kind == "int" else f"n{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, f"id {kind}, features array<double>")


def expected(left, right, k, exclude_self=False):
    out = {}
    for i, a in enumerate(left):
        scored = []
        for j, b in enumerate(right):
            if exclude_self and i == j:
                continue
            s = 0.0
            for x, y in zip(a, b):
                s += float(x) * float(y)
            scored.append((-s, j))
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", F.desc("score"), "other").collect():
        out.setdefault(r.id, []).append((r.other, r.score))
    return out


@pytest.mark.parametrize("n, block_rows", [(60, 7), (60, 16384), (150, 7)])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_against_brute_force(spark, n, block_rows, exclude_self):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(n, 6))
    vectors[20:40] = vectors[0]  # a third are copies: ties go to the smaller id
    df = frame(spark, vectors)
    got = found(top_k_scores(df, df, 5, exclude_self, block_rows))
    assert got == expected(vectors, vectors, 5, exclude_self)


def test_fewer_candidates_than_k(spark):
    df = frame(spark, [[1.0], [2.0]])
    assert found(top_k_scores(df, df, 5, True)) == {0: [(1, 2.0)], 1: [(0, 2.0)]}


def test_string_ids(spark):
    left, right = frame(spark, [[1.0, 0.0]], "string"), frame(spark, [[1.0, 0.0], [2.0, 5.0]], "string")
    assert found(top_k_scores(left, right, 1)) == {"n000": [("n001", 2.0)]}


def test_empty_sides(spark):
    df = frame(spark, [[1.0]])
    assert top_k_scores(df.filter("false"), df, 3).isEmpty()
    assert top_k_scores(df, df.filter("false"), 3).isEmpty()


def test_k_must_be_positive(spark):
    df = frame(spark, [[1.0]])
    with pytest.raises(ValueError):
        top_k_scores(df, df, 0)


def test_matrix_is_symmetric_and_bounded(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(15, 3))
    v[4] = 0.0
    params = frame(spark, v).select(
        F.col("id").alias("col"), F.lit("user").alias("block"), F.col("id").cast("string").alias("term"),
        F.col("features").alias("v"))
    m = {(r.col, r.sim_col): r.score for r in interaction_matrix(params, "user", 14, block_rows=6).collect()}
    assert len(m) == 14 * 13  # the zero row is similar to nothing
    for (a, b), s in m.items():
        assert a != b and abs(s) <= 1 + 1e-12
        assert m[b, a] == pytest.approx(s, abs=1e-12)


def test_broken_vectors_take_no_part(spark):
    """A NaN or null cell on the right must not cost the left its results."""
    right = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [0.0, 1.0]), (3, [None, 1.0]), (4, None)],
        "id int, features array<double>")
    left = spark.createDataFrame([(9, [1.0, 2.0]), (8, [None, 2.0])], "id int, features array<double>")
    got = top_k_scores(left, right, 2).collect()
    assert sorted((r.id, r.other, r.score) for r in got) == [(9, 0, 1.0), (9, 2, 2.0)]


@pytest.mark.parametrize("unit", [True, False])
def test_blocks_out_of_reach_are_skipped(spark, monkeypatch, unit):
    """Clusters of directions, or lengths that differ: few of the pairs of row and block are multiplied."""
    rng = np.random.default_rng(8)
    if unit:
        v = np.repeat(rng.normal(size=(16, 12)), 50, axis=0) + 0.05 * rng.normal(size=(800, 12))
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
    else:
        v = rng.normal(size=(800, 12)) * np.exp(-np.arange(800) / 60)[:, None]
    met, sizes = [], {}

    def kept(df, name, by=None):
        out = written(df, name, by)
        if name == "right-blocks":
            sizes.update((r.block, len(r.right_rows)) for r in out.collect())
        if name == "routes":
            met.append(sum(len(r.left_rows) * sizes[r.block] for r in out.collect()))
        return out

    monkeypatch.setattr(topk, "written", kept)
    df = frame(spark, v)
    assert found(top_k_scores(df, df, 5, True, 50)) == expected(v, v, 5, True)
    assert sum(sizes.values()) == 800 and sum(met) / 800 ** 2 < (0.2 if unit else 0.4)  # products of pairs of rows


def test_no_product_exceeds_the_reach():
    rng = np.random.default_rng(3)
    for _ in range(50):
        block, left = rng.normal(size=(20, 5)) + rng.normal(size=5), rng.normal(size=(9, 5))
        center = block.mean(axis=0)
        most = topk.reach(left, center[None], np.sqrt(((block - center) ** 2).sum(axis=1)).max()[None],
                          np.sqrt((block ** 2).sum(axis=1)).max()[None])
        assert ((left @ block.T).max(axis=1) <= most[:, 0]).all()


def test_known_floors_preselect(monkeypatch):
    """A floor that the best do not fall below changes none of them, ties by id included; few products are held at once."""
    from affinity.operators import topk

    monkeypatch.setattr(topk, "_SCORES", 300)
    rng = np.random.default_rng(3)
    left, right = rng.integers(-3, 4, (40, 3)).astype(float), rng.integers(-3, 4, (100, 3)).astype(float)
    ids = np.arange(40), rng.permutation(100)
    found = lambda floor: [
        (int(start), int(ids[1][j]), float(s)) for i, js, ss in topk.best_of_block(ids[0], left, ids[1], right, 4, False, floor)
        for start, j, s in zip(i, js, ss)]
    kth = np.sort(left @ right.T, axis=1)[:, -4]
    kth[::2] = -np.inf
    assert found(kth) == found(None)
