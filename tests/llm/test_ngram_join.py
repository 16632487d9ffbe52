"""The n-gram join against brute force over all pairs."""

import random

import numpy as np
import pytest

from affinity.llm.ngram_join import (
    STARTS, CountTree, all_cells, block_links, cells, counts, near_members, ngram_join, similar, subspaces)
from tests.llm import cases
from tests.llm.test_exact import least_reachable


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    least = least_reachable(list(texts), edges)
    return sorted((i, len(s), least[i]) for i, s in sets.items())


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at:at + rng.choice([0, 1, 1])] = [rng.choice(cases.WORDS) + str(rng.random())] * rng.choice([0, 1])
    return words


def test_against_brute_force(spark):
    """Families of sizes 3 to 900 whose similarities lie around the threshold, chains, copies, shared passages."""
    rng, texts = random.Random(4), {}
    for family, size in enumerate([3, 9, 10, 11, 12, 20, 31, 45, 64, 90, 140, 200, 333, 500, 900] * 2):
        base = cases.prose(size, family)
        for n in range(12):
            if n in (4, 8):
                base = near(rng, base, 1 + size // 40)
            words = near(rng, base, rng.randint(0, 1 + size // 50)) if n % 3 else base
            texts[100 * family + n] = " ".join(words)
    line = " ".join(cases.prose(14, 99))
    for n in range(60):
        texts[9000 + n] = " ".join([line] + cases.prose(n, 700 + n))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join(df).collect())
    assert got == brute(texts)
    assert 60 < len({c for _, _, c in got}) < len(got) - 100


def test_odd_rows(spark):
    docs = cases.odd_documents(spark).selectExpr("*", "'z' as `group`", "1 as shingles", "2 as cells")
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs).collect()}
    assert sorted(rows) == list(range(1, 12))
    assert rows[2] == (118, 1) and rows[7] == (1, 6) and rows[9] == (58, 9)
    assert all(rows[n] == (0, n) for n in (3, 4, 5)) and rows[8][0] > 29_000
    assert not ngram_join(cases.empty_documents(spark)).collect()
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c d e"), (2, "a b c d e"), (3, "a b c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join(twice).collect()) == [(1, 3, 1), (2, 3, 1), (3, 1, 3)]


@pytest.mark.parametrize("size", [10, 13, 19, 57, 190, 400])
def test_linked_sets_share_a_cell(size):
    """Also where the changes are spread over as many subspaces as they can reach."""
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        apart = len(a) * 2 // 19
        gone = rng.integers(0, apart + 1)
        b = np.unique(np.concatenate([
            rng.permutation(a)[gone:], rng.integers(0, 1 << 62, apart - gone).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if similar(shared, len(a), len(b)):
            assert set(all_cells(a).tolist()) & set(all_cells(b).tolist())
            assert similar(np.minimum(counts(a), counts(b)).sum(), len(a), len(b))


def test_levels_and_subspaces():
    for level in range(1, 60):
        n, spare = subspaces(level)
        assert n - 2 * spare == 2 * (STARTS[level + 1] - 1) // 19 + 1
        a = np.arange(STARTS[level], dtype=np.uint64) if STARTS[level] < 5000 else np.arange(10, dtype=np.uint64)
        assert len(cells(a, level)) == n - spare
        assert 10 * (STARTS[level + 1] - 1) // 9 < STARTS[level + 2]  # no pair skips a level


def test_tree_prunes_and_keeps_links():
    rng = np.random.default_rng(2)
    bases = [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.02], rng.integers(0, 1 << 62, 3).astype(np.uint64)]))
            for b in bases for _ in range(32)]
    points = np.array([counts(s) for s in sets])
    tree = CountTree(points)
    for i in range(0, len(sets), 50):
        found = set(tree.near(points[i]).tolist())
        linked = {j for j, s in enumerate(sets) if similar(len(np.intersect1d(sets[i], s)), len(sets[i]), len(s))}
        assert linked <= found and len(found) < 100
    ids, own = np.arange(len(sets)), np.arange(len(sets))
    family = own // 32
    family[5] = 99
    marked = near_members(family[:40], points[:40], family, points)
    assert np.nonzero(marked[0])[0].tolist() == list(range(32)) and marked[1].tolist() == [n < 32 for n in own]
    links = list(block_links(ids, own, sets, ids, own, sets))
    assert len(set(least_reachable(ids.tolist(), links).values())) == 20 and len(links) == len(sets) - 20
