"""Phrase collocations from weighted acyclic automata of n-gram counts.

Tasks turn shards of the corpus into automata of their n-grams, in chunks of equal numbers, and mark n-grams
at even steps, which then say where the order of all n-grams is cut into even ranges. The chunks are cut there,
and each range unites its pieces and sums their weights. Candidates are read off the united automata; their parts
are an automaton per range in turn, composed with the counts there. Any prefix can be cut, so a hot one is no
group of its own, and an n-gram has one weight for each shard at most.
"""

import contextlib
import ctypes
import math
import sys
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.automata import DEPTH, CountAutomaton, codes_of, lower_bound, summed, union
from affinity.operators.skew import spread_join
from affinity.session import LARGE_ROWS, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_TOKENS = 1 << 19
CHUNK_GRAMS = 1 << 17
MARK_GRAMS = 1 << 12
RANGE_GRAMS = 2_000_000
_BATCH_BYTES = "8m"  # rows hold whole automata
_SPREAD = 64
_MARKS = pa.list_(pa.list_(pa.binary()))


def _table() -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = ord(".")
    table[ord("\t")] = ord(" ")
    return bytes(table)


_TABLE = _table()


def _give_back() -> None:
    """Returns freed memory to the system, which a worker would else hold between its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def shard_automata(parts: list[np.ndarray], words: list[bytes]):
    """Automata of a shard's n-grams, ``CHUNK_GRAMS`` each, with marked n-grams. 0 stands between pieces.

    Chunks of all shards begin near the same n-grams, so their first ones alone would leave wide gaps. Marks are the first
    n-gram and, from a step of the chunk's own, each ``MARK_GRAMS``-th."""
    ids = np.concatenate(parts)
    used = np.unique(ids)
    used = used[used > 0]
    names = sorted((words[u], u) for u in used.tolist())
    rank = np.zeros(len(words), np.int64)
    rank[[u for _, u in names]] = np.arange(1, len(names) + 1)
    lexicon, r = [w for w, _ in names], np.append(rank[ids], [0, 0])
    first, second, third = r[:-2], r[1:-1], r[2:]
    two = (first > 0) & (second > 0)
    three = two & (third > 0)
    base = len(lexicon) + 1
    if base < 1 << 21:
        pairs = first[two] * base + second[two]
        codes = np.concatenate([r[r > 0] * (base * base), pairs * base, pairs[three[two]] * base + third[three]])
        codes, weights = np.unique(codes, return_counts=True)
        columns = None
    else:  # a text of more words than a number can hold
        columns = np.zeros((int((r > 0).sum() + two.sum() + three.sum()), DEPTH), np.int64)
        columns[:, 0] = np.concatenate([r[r > 0], first[two], first[three]])
        columns[len(columns) - int(two.sum() + three.sum()):, 1] = np.concatenate([second[two], second[three]])
        columns[len(columns) - int(three.sum()):, 2] = third[three]
        codes, weights = summed(lexicon, columns, np.ones(len(columns), np.int64)).paths()
        columns = codes
    for at in range(0, len(codes), CHUNK_GRAMS):
        some = codes[at:at + CHUNK_GRAMS]
        if columns is None:
            some = np.stack([some // (base * base), some // base % base, some % base], axis=1)
        step = 1 + int((some.sum() + weights[at:at + CHUNK_GRAMS].sum()) % MARK_GRAMS)
        marks = [[lexicon[c - 1] if c else b"" for c in some[n].tolist()] for n in (0, *range(step, len(some), MARK_GRAMS))]
        yield marks, len(some), CountAutomaton.of_sorted(lexicon, some, weights[at:at + CHUNK_GRAMS])


def _shards(batches):
    numbers, parts, held = _Numbers({b".": 0}), {}, 0

    def flush():
        words = list(numbers)
        for lang, ids in parts.items():
            for marks, n, automaton in shard_automata(ids, words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([marks], _MARKS), pa.array([n], pa.int64()),
                     pa.array([automaton.dumps()], pa.binary())], names=["lang", "marks", "n", "automaton"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = text.translate(_TABLE).replace(b".", b" . ").split()
            tokens.append(b".")
            parts.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
            held += len(tokens)
            if held >= SHARD_TOKENS:
                yield from flush()
                numbers, parts, held = _Numbers({b".": 0}), {}, 0
                _give_back()
    yield from flush()
    _give_back()


def _range(bounds: list[tuple], gram: tuple) -> int:
    return max(0, bisect_right(bounds, gram) - 1)


def _slicer(bounds: list[tuple]):
    """Pieces of automata by range; ``bounds`` has the first (lang, words) of each range."""
    def cut(batches):
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = CountAutomaton.loads(data.as_buffer())
                columns, weights = whole.paths()
                ends = [(lang, *(whole.lexicon[c - 1] if c else b"" for c in columns[n].tolist())) for n in (0, -1)]
                low, high = _range(bounds, ends[0]), _range(bounds, ends[1])
                at, pieces = [0, len(columns)], [data.as_py()]
                if low < high:
                    codes = codes_of(columns, len(whole.lexicon))
                    at[1:1] = [lower_bound(whole.lexicon, codes, b[1:]) for b in bounds[low + 1:high + 1]]
                    pieces = [CountAutomaton.of_sorted(whole.lexicon, columns[a:b], weights[a:b]).dumps()
                              for a, b in zip(at, at[1:])]
                kept = [n for n in range(len(pieces)) if at[n] < at[n + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kept), pa.string()), pa.array([low + n for n in kept], pa.int32()),
                     pa.array([pieces[n] for n in kept], pa.binary())], names=["lang", "range", "automaton"])
            _give_back()
    return cut


def _united(group: pa.Table) -> pa.Table:
    whole = union([CountAutomaton.loads(d.as_buffer()) for d in group.column("automaton")]).dumps()
    _give_back()
    return pa.table({"lang": group.column("lang").slice(0, 1), "range": group.column("range").slice(0, 1),
                     "automaton": pa.array([whole], pa.binary())})


def _reader(least: int):
    """Phrases of two words or more that occur ``least`` times; words without number stand for all occurrences."""
    def read(batches):
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                automaton = CountAutomaton.loads(data.as_buffer())
                columns, weights = automaton.paths()
                kept = (columns[:, 1] > 0) & (weights >= least)
                words = np.array([b"", *automaton.lexicon], object)
                total = int(weights[columns[:, 1] == 0].sum())
                out = [words[columns[kept, n]].tolist() + [b""] for n in range(DEPTH)]
                counts = weights[kept].tolist() + [total]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), *(pa.array(o, pa.binary()) for o in out),
                     pa.array(counts, pa.int64())], names=["lang", "w1", "w2", "w3", "a"])
    return read


def _locator(bounds: list[tuple]):
    def locate(batches):
        for batch in batches:
            at = [_range(bounds, (*gram, b"")) for gram in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int32())], names=["lang", "w1", "w2", "range"])
    return locate


def _answered(asked: pa.Table, counts: pa.Table) -> pa.Table:
    lang, first, second = (asked.column(c).to_pylist() for c in ("lang", "w1", "w2"))
    if not counts.num_rows or not lang:
        found, lexicon, weights = np.zeros((0, DEPTH), np.int64), [], np.zeros(0, np.int64)
    else:
        lexicon = sorted({*first, *second} - {b""})
        rank = {w: n + 1 for n, w in enumerate(lexicon)} | {b"": 0}
        columns = np.array([[rank[a], rank[b], 0] for a, b in zip(first, second)], np.int64)
        request = summed(lexicon, columns, np.ones(len(columns), np.int64))
        found, weights = CountAutomaton.loads(counts.column("automaton")[0].as_py()).compose(request)
        lexicon = request.lexicon
    words = np.array([b"", *lexicon], object)
    return pa.table({
        "lang": pa.array(lang[:1] * len(found), pa.string()), "p1": pa.array(words[found[:, 0]].tolist(), pa.binary()),
        "p2": pa.array(words[found[:, 1]].tolist(), pa.binary()), "f": pa.array(weights, pa.int64())})


def _bounds(chunks: DataFrame, range_grams: int) -> list[tuple]:
    """First n-grams of ranges with equal numbers of marks, at most one for each ``range_grams`` n-grams of the shards."""
    total = chunks.agg(F.sum("n")).first()[0] or 0
    key = ["lang", "w1", "w2", "w3"]
    n = max(1, math.ceil(total / range_grams))
    marks = chunks.select("lang", F.explode("marks").alias("mark")).select(
        "lang", *[F.get("mark", F.lit(i)).alias(w) for i, w in enumerate(key[1:])])
    first = marks.repartitionByRange(n, *key).groupBy(F.spark_partition_id()).agg(
        F.min(F.struct(*key)).alias("k")).select("k.*").collect()
    return sorted((r.lang, *(bytes(r[w]) for w in key[1:])) for r in first)


def phrase_counts(docs: DataFrame, range_grams: int = RANGE_GRAMS) -> tuple[DataFrame, list[tuple]]:
    """(lang, range, automaton): counts of all n-grams of one to three words, and the ranges' first n-grams.

    Bounds are ``shard n-grams / range_grams`` in number and go with the tasks; larger executors take larger ranges.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    source = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    chunks = written(source.mapInArrow(
        _shards, "lang string, marks array<array<binary>>, n bigint, automaton binary"), "shards", **LARGE_ROWS)
    bounds = _bounds(chunks, range_grams)
    pieces = chunks.select("lang", "automaton").mapInArrow(_slicer(bounds), "lang string, range int, automaton binary")
    united = pieces.groupBy("lang", "range").applyInArrow(_united, "lang string, range int, automaton binary")
    return written(united, "ranges", **LARGE_ROWS), bounds


def part_counts(parts: DataFrame, counts: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(lang, p1, p2, f): how often the parts (lang, w1, w2), an empty ``w2`` for one word, occur."""
    placed = parts.distinct().mapInArrow(_locator(bounds), "lang string, w1 binary, w2 binary, range int")
    return placed.groupBy("lang", "range").cogroup(counts.groupBy("lang", "range")).applyInArrow(
        _answered, "lang string, p1 binary, p2 binary, f bigint")


def collocations(
    docs: DataFrame, least: int = 10, best: int = 2000, share: int = 50, range_grams: int = RANGE_GRAMS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of two or three words.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into words ``[^\\x20\\x09]+``.
    A phrase that occurs ``a >= least`` times is cut after its first words into parts that occur ``l`` and ``r``
    times; its score is the least floor(1000000 a a / (l r)) of all cuts, the first of equal ones. Phrases inside a longer
    candidate that occurs at ``share`` percent or more of their number are dropped. ``n`` is the language's
    number of words. Order: score, a (both falling), phrase (bytes). Counts are whole and sums exact.

    A null language is ``und``, a null text is empty; rows may repeat and count each time. Ids and other columns are
    not read. A table without candidates gives no rows.
    """
    counts, bounds = phrase_counts(docs, range_grams)
    rows = written(counts.select("lang", "automaton").mapInArrow(
        _reader(least), "lang string, w1 binary, w2 binary, w3 binary, a bigint"), "candidates")
    empty = F.lit(b"")
    totals = rows.filter(F.col("w1") == empty).groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = rows.filter(F.col("w1") != empty)
    two, three = F.col("w3") == empty, F.col("w3") != empty

    def cut(k, first, second, third, fourth):
        return F.struct(F.lit(k).alias("k"), F.array(
            F.struct(F.lit("l").alias("side"), first.alias("p1"), second.alias("p2")),
            F.struct(F.lit("r").alias("side"), third.alias("p1"), fourth.alias("p2"))).alias("parts"))

    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    cuts = F.when(two, F.array(cut(1, w1, empty, w2, empty))).otherwise(
        F.array(cut(1, w1, empty, w2, w3), cut(2, w1, w2, w3, empty)))
    opened = phrases.withColumn("cut", F.explode(cuts)).select(
        "lang", "w1", "w2", "w3", "a", "cut.k", F.explode("cut.parts").alias("part")).select(
        "lang", "w1", "w2", "w3", "a", "k", "part.*")
    found = written(part_counts(opened.select("lang", F.col("p1").alias("w1"), F.col("p2").alias("w2")), counts, bounds), "parts")
    sides = spread_join(opened, found, ["lang", "p1", "p2"]).groupBy("lang", "w1", "w2", "w3", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr(
        "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) "
        "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = sides.withColumn("score", score).groupBy("lang", "w1", "w2", "w3", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "w1", "w2", "w3", "a", "s.l", "s.r", "s.score")

    around = phrases.filter(three).select("lang", "a", F.explode(F.array(
        F.struct(w1.alias("p1"), w2.alias("p2")), F.struct(w2.alias("p1"), w3.alias("p2")))).alias("p")).groupBy(
        "lang", F.col("p.p1").alias("w1"), F.col("p.p2").alias("w2")).agg(F.max("a").alias("longer")).withColumn("w3", empty)
    kept = spread_join(scored, around, ["lang", "w1", "w2", "w3"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    phrase = F.when(two, F.concat(w1, F.lit(b" "), w2)).otherwise(F.concat(w1, F.lit(b" "), w2, F.lit(b" "), w3))
    named = kept.select("lang", phrase.cast("string").alias("phrase"), "a", "l", "r", "score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SPREAD))).orderBy(*order)
    short = named.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= best)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(
        F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
