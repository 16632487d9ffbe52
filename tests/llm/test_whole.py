"""Cases at the edge of what the operators' rules promise."""

import itertools
import math

import numpy as np
import pytest

from affinity.llm.decontaminate import MASKS, SHARE, contaminated
from affinity.llm.passages import MIN_WORDS, chains, repeated_passages
from tests.llm import cases


@pytest.mark.parametrize("n", sorted(MASKS))
def test_a_seed_for_each_way_to_change_words(n):
    placed = [{at + k for k in mask} for mask in MASKS[n] for at in range(n - mask[-1])]
    for gone in itertools.combinations(range(n), n - math.ceil(SHARE * n)):
        assert any(not p & set(gone) for p in placed), gone


def test_contaminated_by_changed_and_by_short_items(spark):
    items = {1: cases.prose(40, 1), 2: cases.prose(13, 2), 3: cases.prose(12, 3), 4: cases.prose(8, 4),
             5: cases.prose(5, 5), 6: cases.prose(1, 6), 7: cases.prose(13, 7)}
    gone = {1: range(3, 40, 4), 2: (1, 6, 11), 3: (0, 5, 9), 4: (2, 5), 5: (2,), 6: (), 7: (0, 4, 8, 12)}
    docs = [(n, " ".join(cases.prose(30, 10 + n) + [f"x{k}" if k in gone[n] else w for k, w in enumerate(words)]))
            for n, words in items.items()]
    docs.append((8, " ".join(items[2][:10])))
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        [(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.item_id != 6} == {(n, n) for n in range(1, 6)} | {(8, 2)}
    assert {r.doc_id for r in rows if r.item_id == 6} == {
        n for n, text in docs if items[6][0] in text.split()}


def test_chains_pass_over_long_matches_out_of_reach():
    frags = np.array([[0, 0, 200], [300, 300, 30], [331, 330, 30]])
    assert sorted(chains(frags)) == [[0], [1, 2]]


def uncovered(spark, texts):
    """(doc, at) of words in a row, ``MIN_WORDS`` of them, of an earlier document too, not all in found passages."""
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    covered = {i: bytearray(len(t)) for i, t in texts.items()}
    for r in repeated_passages(frame).collect():
        covered[r.doc_id][r.start_word:r.start_word + r.n_words] = b"\1" * r.n_words
    first = {}
    return [(i, at) for i in sorted(texts) for at in range(len(texts[i]) - MIN_WORDS + 1)
            if first.setdefault(tuple(texts[i][at:at + MIN_WORDS]), i) < i and 0 in covered[i][at:at + MIN_WORDS]]


def test_repeated_phrases_at_any_offset(spark):
    texts, last = {}, {}
    for n, (period, size) in enumerate(itertools.product((1, 3, 5, 10, 16), (50, 56, 75))):
        phrase = (cases.prose(period, 300 + n) * 80)[:size]
        for k in range(12):
            texts[20 * n + k] = cases.prose(40 + 3 * k, 500 + 20 * n + k) + phrase + cases.prose(30, 900 + 20 * n + k)
            last[20 * n + k] = 40 + 3 * k, 40 + 3 * k + size - MIN_WORDS
    assert not [(i, at) for i, at in uncovered(spark, texts) if last[i][0] <= at <= last[i][1]]


def test_passages_whose_halves_stand_in_earlier_documents(spark):
    texts = {}
    for n in range(12):
        whole = cases.prose(90, 2000 + n)
        for k, part in enumerate((whole[:45], whole[45:], whole, whole)):
            texts[4 * n + k] = cases.prose(40, 3000 + 4 * n + k) + part + cases.prose(40, 4000 + 4 * n + k)
    for n in range(12):  # parts of all sizes, whole ones in one of them elsewhere
        whole = cases.prose(60, 5000 + n)
        cut = 16 + 2 * n
        for k, part in enumerate((whole[:cut], whole[cut:], whole[:49] + cases.prose(30, 5100 + n) + whole, whole)):
            texts[100 + 4 * n + k] = cases.prose(70, 6000 + 4 * n + k) + part + cases.prose(40, 7000 + 4 * n + k)
    assert not uncovered(spark, texts)
