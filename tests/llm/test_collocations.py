"""Collocations and their automata against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from affinity.llm.automata import CountAutomaton, codes_of, lower_bound, summed, union
from affinity.llm import collocations as module
from affinity.llm.collocations import collocations, phrase_counts
from tests.llm import cases


def brute(rows, least=10, best=2000, share=50):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x.encode() for x in re.findall("[^ \t]+", piece)]
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and g in (h[:2], h[1:]) and 100 * c >= share * a for h, c in candidates.items()):
                continue
            score, _, l, r = min((10 ** 6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, b" ".join(g), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:best])]
    return sorted(out)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "and", "New", "York", "stock", "Éxchange", "zb\x01", "zb", "中文", *cases.WORDS[:6]]
    text = []
    for _ in range(n):
        text += rng.choice([["new", "York"], ["new", "york", "Stock"], ["of", "the"], [rng.choice(words)]])
        text.append(rng.choice([" ", " ", " ", "\t", ". ", ",\n", " ?!"]))
    return " ".join(text)


@pytest.mark.parametrize("range_grams, best", [(2_000_000, 2000), (300, 7)])
def test_against_brute_force(spark, range_grams, best):
    rows = [(("en", "de", None)[n % 3], prose(n, 120)) for n in range(40)]
    rows += [("en", "New York " * 400), ("xx", "a b a b"), ("en", None), ("en", ""), ("de", "!?.")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, best=best, range_grams=range_grams).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, best=best) and len(got) > 15


def test_odd_rows(spark):
    docs = cases.odd_documents(spark).selectExpr("*", "1 as rank", "2 as a", "'z' as range")
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in collocations(docs, least=2, range_grams=5000).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, least=2) and got
    assert not collocations(cases.empty_documents(spark)).collect()


def grams(seed, n, words=12):
    rng = np.random.default_rng(seed)
    lexicon = sorted(f"w{i}".encode() for i in range(words))
    columns = rng.integers(1, words + 1, size=(n, 3))
    size = rng.integers(1, 4, size=n)
    columns[size < 3, 2] = 0
    columns[size < 2, 1] = 0
    return lexicon, columns, rng.integers(1, 5, size=n)


def as_counts(automaton):
    columns, weights = automaton.paths()
    words = [b"", *automaton.lexicon]
    found = [tuple(words[c] for c in row) for row in columns.tolist()]
    assert found == sorted(found)
    return dict(zip(found, weights.tolist()))


def test_automata_unite_sum_and_compose():
    total, parts = collections.Counter(), []
    for seed in range(4):
        lexicon, columns, weights = grams(seed, 500, 8 + 4 * seed)
        for row, w in zip(columns.tolist(), weights.tolist()):
            total[tuple(lexicon[c - 1] if c else b"" for c in row)] += w
        parts.append(CountAutomaton.loads(summed(lexicon, columns, weights).dumps()))
    whole = union(parts)
    assert as_counts(whole) == dict(total)
    lexicon, columns, weights = grams(9, 300, 40)
    asked = summed(lexicon, columns, weights)
    found, answers = whole.compose(asked)
    words = [b"", *asked.lexicon]
    assert len(found) == len(as_counts(asked))
    for row, answer in zip(found.tolist(), answers.tolist()):
        assert answer == total.get(tuple(words[c] for c in row), 0)
    nothing = union([])
    assert as_counts(nothing) == {} and set(nothing.compose(asked)[1].tolist()) == {0}
    columns, _ = whole.paths()
    codes, ordered = codes_of(columns, len(whole.lexicon)), sorted(total)
    for gram in [*ordered[::50], (b"w", b"", b""), (b"w1", b"w", b"w"), (b"zz", b"", b""), (b"w3", b"w3", b"zz")]:
        assert lower_bound(whole.lexicon, codes, gram) == sum(g < gram for g in ordered)


def test_equal_ends_are_stored_once():
    lexicon = sorted(f"w{i:03d}".encode() for i in range(200))
    columns = np.array([(a, b, c) for a in range(1, 101) for b in (110, 120) for c in (130, 140, 150)])
    automaton = CountAutomaton.of_sorted(lexicon, columns, np.full(len(columns), 7))
    assert [len(level[1]) for level in automaton.levels] == [100, 2, 3]
    assert len(as_counts(automaton)) == 600


def test_ranges_are_even_where_shards_are_alike(spark, monkeypatch):
    """Shards of one language begin their chunks at the same n-grams; ranges are cut between those too."""
    monkeypatch.setattr(module, "MARK_GRAMS", 64)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400):03d}" for _ in range(3000)) for _ in range(8)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(8)
    counts, bounds = phrase_counts(df, range_grams=6000)
    sizes = [len(CountAutomaton.loads(bytes(r.automaton)).paths()[1]) for r in counts.collect()]
    assert len(bounds) > 6 and max(sizes) <= 2 * 6000
