"""Weighted acyclic automata over words: counts of n-grams of up to three words, shared from both ends.

Paths with a common prefix share its states, and states with equal arcs, weights and targets are registered
once. The weight of an n-gram stands on its last arc; 0 marks a prefix that is no n-gram of its own.
"""

import pickle
import sys
from bisect import bisect_left

import numpy as np
import zstandard
from pyspark import cloudpickle

from affinity.llm.text import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 3


def codes_of(columns: np.ndarray, words: int) -> np.ndarray:
    """Numbers that order rows of word ranks (from 1; 0 for none) as their words do."""
    base = words + 1
    pairs = columns[:, 0].astype(np.int64) * base + columns[:, 1]
    if base ** DEPTH >= 1 << 63:
        pairs = np.unique(pairs, return_inverse=True)[1]
    return pairs * base + columns[:, 2]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def registered(owner: np.ndarray, n: int, *arcs: np.ndarray):
    """States of ``n`` owners, equal ones registered once: each owner's state, state offsets, their arcs.

    ``arcs`` are columns (word, weight, target ...), ordered by owner and word.
    """
    sizes = np.bincount(owner, minlength=n)
    starts = np.cumsum(sizes) - sizes
    prints = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = np.full(len(owner), salt, np.uint64)
        for column in arcs:
            x = mixed(x + column.astype(np.uint64))
        total = np.zeros(n, np.uint64)
        held = np.nonzero(sizes)[0]
        if len(held):
            total[held] = np.add.reduceat(x, starts[held])
        prints.append(total)
    _, first, state = np.unique(prints[0], return_index=True, return_inverse=True)
    if not (prints[1][first][state] == prints[1]).all():  # equal prints of unequal states: share nothing
        first, state = np.arange(n), np.arange(n)
    at = spans(starts[first], sizes[first])
    offsets = np.concatenate([[0], np.cumsum(sizes[first])])
    return state, offsets, [column[at] for column in arcs]


class CountAutomaton:
    """Levels of arcs (state offsets, word, weight, target state); the root is the one state of level 0."""

    def __init__(self, lexicon: list[bytes], levels: list[tuple]):
        self.lexicon, self.levels = lexicon, levels

    @classmethod
    def of_sorted(cls, lexicon: list[bytes], columns: np.ndarray, weights: np.ndarray) -> "CountAutomaton":
        """From distinct n-grams in order, with ranks in a sorted lexicon, that may hold words without use."""
        used = np.unique(columns)
        used = used[used > 0]
        rank = np.zeros(len(lexicon) + 1, np.int64)
        rank[used] = np.arange(1, len(used) + 1)
        lexicon = [lexicon[u - 1] for u in used.tolist()]
        columns = rank[columns]
        runs, owner = [], np.zeros(len(columns), np.int64)
        for level in range(DEPTH):
            here = columns[:, level] > 0
            columns, weights, owner = columns[here], weights[here], owner[here]
            new = np.ones(len(columns), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (columns[1:, level] != columns[:-1, level])
            first = np.nonzero(new)[0]
            ends = columns[first, level + 1] == 0 if level + 1 < DEPTH else np.ones(len(first), bool)
            runs.append((owner[first], columns[first, level], np.where(ends, weights[first], 0)))
            owner = np.cumsum(new) - 1
        levels, target = [], None
        for level in reversed(range(DEPTH)):  # the deepest states are complete first
            of, word, weight = runs[level]
            target = np.zeros(len(word), np.int64) if target is None else target
            state, offsets, arcs = registered(of, len(runs[level - 1][0]) if level else 1, word, weight, target)
            levels.insert(0, (offsets, *arcs))
            target = state
        return cls(lexicon, levels)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, as columns of ranks, and their weights."""
        found, weights = [], []
        prefix, state = np.zeros((1, DEPTH), np.int64), np.zeros(1, np.int64)
        for level, (offsets, word, weight, target) in enumerate(self.levels):
            sizes = offsets[state + 1] - offsets[state]
            arcs = spans(offsets[state], sizes)
            prefix = np.repeat(prefix, sizes, axis=0)
            prefix[:, level] = word[arcs]
            state = target[arcs]
            ends = weight[arcs] > 0
            found.append(prefix[ends])
            weights.append(weight[arcs][ends])
        columns, weights = np.concatenate(found), np.concatenate(weights)
        order = np.argsort(codes_of(columns, len(self.lexicon)), kind="stable")
        return columns[order], weights[order]

    def compose(self, asked: "CountAutomaton") -> tuple[np.ndarray, np.ndarray]:
        """The paths of ``asked``, as its ranks, with their weights here; 0 where there is no such path.

        Both automata are walked together, a level at a time; arcs meet by state and word.
        """
        held = {w: n + 1 for n, w in enumerate(self.lexicon)}
        rank = np.array([0, *(held.get(w, 0) for w in asked.lexicon)], np.int64)
        base = len(self.lexicon) + 1
        found, weights = [], []
        prefix, theirs, mine = np.zeros((1, DEPTH), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(DEPTH):
            offsets, word, weight, target = asked.levels[level]
            sizes = offsets[theirs + 1] - offsets[theirs]
            arcs = spans(offsets[theirs], sizes)
            prefix = np.repeat(prefix, sizes, axis=0)
            prefix[:, level] = word[arcs]
            mine, theirs = np.repeat(mine, sizes), target[arcs]
            my_offsets, my_word, my_weight, my_target = self.levels[level]
            keys = np.repeat(np.arange(len(my_offsets) - 1), np.diff(my_offsets)) * base + my_word
            wanted = mine * base + rank[word[arcs]]
            at = np.searchsorted(keys, wanted)
            at[at == len(keys)] = 0
            met = (keys[at] == wanted) & (mine >= 0) if len(keys) else np.zeros(len(wanted), bool)
            ends = weight[arcs] > 0
            found.append(prefix[ends])
            weights.append(np.where(met, my_weight[at] if len(keys) else 0, 0)[ends])
            mine = np.where(met, my_target[at] if len(keys) else -1, -1)
        return np.concatenate(found), np.concatenate(weights)

    def dumps(self) -> bytes:
        small = [tuple(a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in level) for level in self.levels]
        return zstandard.compress(pickle.dumps((b" ".join(self.lexicon), small)), 3)

    @classmethod
    def loads(cls, data: bytes) -> "CountAutomaton":
        lexicon, levels = pickle.loads(zstandard.decompress(data))
        return cls(lexicon.split(), [tuple(a.astype(np.int64) for a in level) for level in levels])


def union(automata: list[CountAutomaton]) -> CountAutomaton:
    """One automaton of all n-grams, their weights summed."""
    lexicon = sorted(set().union(*(a.lexicon for a in automata)))
    held = {w: n + 1 for n, w in enumerate(lexicon)}
    columns, weights = [np.empty((0, DEPTH), np.int32)], [np.empty(0, np.int64)]
    while automata:
        a = automata.pop()
        rank = np.array([0, *map(held.__getitem__, a.lexicon)], np.int32)
        c, w = a.paths()
        columns.append(rank[c])
        weights.append(w)
    return summed(lexicon, np.concatenate(columns), np.concatenate(weights))


def summed(lexicon: list[bytes], columns: np.ndarray, weights: np.ndarray) -> CountAutomaton:
    """From n-grams in any order, repeated ones summed."""
    codes = codes_of(columns, len(lexicon))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    first = np.nonzero(new)[0]
    total = np.add.reduceat(weights[order], first) if len(first) else weights
    columns = columns[order[first]]
    del codes, order, new
    return CountAutomaton.of_sorted(lexicon, columns, total)


def lower_bound(lexicon: list[bytes], codes: np.ndarray, gram: tuple[bytes, ...]) -> int:
    """How many of the ordered n-grams stand before ``gram``; the lexicon is one of fewer than 2^21 words."""
    base, code = len(lexicon) + 1, 0
    for level, word in enumerate(gram):
        power = base ** (DEPTH - 1 - level)
        if not word:
            break
        at = bisect_left(lexicon, word)
        code += (at + 1) * power
        if at == len(lexicon) or lexicon[at] != word:
            break
    return int(np.searchsorted(codes, code))
