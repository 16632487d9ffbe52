"""Toxicity by weak supervision.

Voters are lexicons (words, and word beginnings of 4, 5 and 6 signs, each cut by strength) and patterns. A
generative model of their votes, fitted on the vote patterns of all documents by expectation
maximization, learns how often each voter fires on toxic and on other texts and, along a tree of the most
correlated voters, how voters depend on each other. Its posteriors are the labels of a linear classifier
over the single lexicon units and patterns.
"""

import sys

import numpy as np

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.text import labelled, remainder
from affinity.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 20_000
UNITS = 4096
MIN_TOXIC = 4
MIN_RATIO = 8.0
MIN_EVIDENCE = 18.0
MIN_PRECISION = 0.85
KINDS = ("word", "begin4", "begin5", "begin6")
STRENGTHS = 2
PATTERNS = ("shouting", "marks", "very_short")
THRESHOLD = 0.7
_STRIP = b".,;:!?\"'()[]{}<>|*#$%&-_/\\=+~`^@"


def units_of(word: bytes) -> list[tuple[int, bytes]]:
    """(kind, unit): the word without outer marks, and its beginnings, counted in signs."""
    word = word.strip(_STRIP)
    if not word:
        return []
    found = [(0, word)]
    text = word.decode("utf-8", "replace")
    for kind, n in ((1, 4), (2, 5), (3, 6)):
        if len(text) >= n:
            found.append((kind, text[:n].encode()))
    return found


def unit_hash(kind: int, unit: bytes) -> int:
    return xxhash.xxh64_intdigest(unit, seed=kind)


def patterns_of(text: bytes, words: list[bytes]) -> list[int]:
    upper = sum(w.isupper() and len(w) > 2 for w in words)
    return [int(upper * 3 > len(words) > 0), int(text.count(b"!") * 5 > len(words) > 0), int(len(words) < 20)]


def _count_units(batches):
    for batch in batches:
        seen: dict[tuple[int, int], list[int]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {(k, unit_hash(k, u)) for w in set((text or b"").lower().split()) for k, u in units_of(w)}
            for key in found:
                seen.setdefault(key, [0, 0])[label] += 1
        keys, counts = list(seen), np.array(list(seen.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in keys], pa.int32()),
            pa.array(np.array([h for _, h in keys], np.uint64).view(np.int64)),
            pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["kind", "unit", "other", "toxic"])


class Features(dict):
    """Word -> numbers of the lexicon units it holds."""

    def __init__(self, units: dict[int, int]):
        self.units = units

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        at = (self.units.get(unit_hash(k, u)) for k, u in units_of(word))
        value = self[word] = tuple(n for n in at if n is not None)
        return value


def _features(units: dict[int, int]):
    def extract(batches):
        of = Features(units)
        for batch in batches:
            found, marks = [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                own = {n for some in map(of.__getitem__, {w.lower() for w in words}) for n in some}
                found.append(sorted(own))
                marks.append(patterns_of(text or b"", words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32()))],
                names=["doc_id", "units", "marks"])
    return extract


class LabelModel:
    """P(vote | label) of binary voters, each given at most one other voter."""

    def fit(self, votes: np.ndarray, counts: np.ndarray, prior: float, trusted: int, rounds: int = 40) -> "LabelModel":
        """``votes``: distinct patterns with their counts; the first ``trusted`` voters speak for toxicity."""
        voters = votes.shape[1]
        self.parent = np.full(voters, -1)
        q = np.where(votes[:, :trusted].any(axis=1), 0.9, 0.02)
        for r in range(rounds):
            if r == rounds // 2:
                self.parent = self._tree(votes, counts, q)
            self.prior = float(np.clip((counts * q).sum() / max(counts.sum(), 1), prior / 4, min(0.9, prior * 4)))
            self.tables = []
            for j in range(voters):
                given = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), np.int64)
                table = np.empty((2, 2))  # label, parent's vote
                for y, weight in ((0, 1 - q), (1, q)):
                    for g in (0, 1):
                        mass = counts * weight * (given == g)
                        table[y, g] = ((mass * votes[:, j]).sum() + 0.1) / (mass.sum() + 0.2)
                self.tables.append(table)
            q = self.posterior(votes)
        return self

    @staticmethod
    def _tree(votes: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each voter the parent in a spanning tree of largest correlations given the label."""
        voters = votes.shape[1]
        strength = np.zeros((voters, voters))
        for weight in (counts * q, counts * (1 - q)):
            total = max(weight.sum(), 1e-9)
            mean = (weight[:, None] * votes).sum(axis=0) / total
            centred = votes - mean
            cov = (centred * weight[:, None]).T @ centred / total
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            strength += np.abs(cov / np.outer(spread, spread)) * total / max(counts.sum(), 1)
        parent, tied = np.full(voters, -1), [0]
        while len(tied) < voters:
            i, j = max(((i, j) for i in tied for j in range(voters) if j not in tied), key=lambda e: strength[e])
            parent[j] = i if strength[i, j] > 0.05 else -1
            tied.append(j)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, table in enumerate(self.tables):
            given = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), np.int64)
            p = table[:, given]
            p = np.where(votes[:, j] == 1, p, 1 - p)
            odds += np.log(p[1] / p[0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(x_rows: list[np.ndarray], target: np.ndarray, width: int, ridge: float = 1e-4, rounds: int = 300):
    """Weights of a logistic regression on sparse binary rows with soft labels; the last is the intercept."""
    at = np.concatenate([np.append(r, width) for r in x_rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(x_rows)), [len(r) + 1 for r in x_rows])
    w, seen = np.zeros(width + 1), np.full(width + 1, 1e-8)
    for _ in range(rounds):
        margin = np.bincount(owner, weights=w[at], minlength=len(x_rows))
        error = (1 / (1 + np.exp(-margin)) - target) / len(x_rows)
        slope = np.bincount(at, weights=error[owner], minlength=width + 1) + ridge * w * (np.arange(width + 1) < width) / 10
        seen += slope * slope
        w -= 0.5 * slope / np.sqrt(seen)
    return w


def _vote_columns(kinds: np.ndarray, strengths: np.ndarray, units: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Votes of one document: lexicons by kind and strength, then patterns."""
    votes = np.zeros(len(KINDS) * STRENGTHS + len(PATTERNS), np.int64)
    if len(units):
        votes[kinds[units] * STRENGTHS + strengths[units]] = 1
    votes[len(KINDS) * STRENGTHS:] = marks
    return votes


def _feature_row(units: np.ndarray, votes: np.ndarray, base: int) -> np.ndarray:
    """Feature numbers: single units, votes, and how many units there are."""
    many = np.nonzero(np.array([1, 2, 4, 8]) <= len(units))[0]
    return np.concatenate([units, base + np.nonzero(votes)[0], base + len(votes) + many]).astype(np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text); labels (doc_id, toxic).

    Lexicons and the classifier are learned from a sample of about ``SAMPLE_ROWS`` labelled rows whose
    crc32(doc_id) mod 3 is not 1; the label model is fitted on the votes of all documents. Only the text is an
    input of a score. Null and empty texts get the score of a text without words. Rows with a null id
    are scored, not learned from, and not called held out. Repeated rows each give a row; other columns are
    ignored; an empty table gives no rows. Without labels of both kinds, or labelled documents, every
    score is 0.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = labelled(docs, labels, "toxic", 3, 1, SAMPLE_ROWS)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    if len(sizes) < 2:
        return texts.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    counted = texts.join(F.broadcast(known), "doc_id").select("text", "label").mapInArrow(
        _count_units, "kind int, unit bigint, other bigint, toxic bigint")
    ratio = (F.col("toxic") + 0.1) / (F.col("other") + 0.5) * (sizes[0] / sizes[1])
    # Twice the log likelihood ratio against a unit that has nothing to do with the label: of the very many
    # rare units, some stand in a few toxic texts by chance.
    share = sizes[1] / (sizes[0] + sizes[1])
    seen_in = F.col("toxic") + F.col("other")
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / (seen_in * share)) + F.when(
        F.col("other") > 0, F.col("other") * F.log(F.col("other") / (seen_in * (1 - share)))).otherwise(0.0))
    lexicon = (
        counted.groupBy("kind", "unit").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= MIN_TOXIC).withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO)
        .filter(evidence >= MIN_EVIDENCE)
        .filter((F.col("toxic") + 0.1) / (seen_in + 0.6) >= MIN_PRECISION)
        .orderBy(F.desc(F.col("toxic") * F.log("ratio")), "kind", "unit").limit(UNITS).toPandas())
    kinds = lexicon["kind"].to_numpy(np.int64)
    strengths = np.zeros(len(lexicon), np.int64)
    for k in range(len(KINDS)):
        own = np.nonzero(kinds == k)[0]
        strengths[own] = (np.arange(len(own)) * STRENGTHS >= len(own)).astype(np.int64)
    numbers = {int(u) & (1 << 64) - 1: n for n, u in enumerate(lexicon["unit"])}

    found = written(
        texts.mapInArrow(_features(numbers), "doc_id bigint, units array<int>, marks array<int>"), "toxic-features")
    width = len(KINDS) * STRENGTHS + len(PATTERNS)
    trusted = len(KINDS) * STRENGTHS

    def voted(units, marks):
        return np.stack([
            _vote_columns(kinds, strengths, np.asarray(u, np.int64), np.asarray(m, np.int64))
            for u, m in zip(units, marks)]) if len(units) else np.zeros((0, width), np.int64)

    def patterns(batches):
        for batch in batches:
            votes = voted(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            values, counts = np.unique(votes @ (1 << np.arange(width)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["pattern", "n"])

    # At most 2^11 patterns of votes, whatever the number of documents.
    seen = found.select("units", "marks").mapInArrow(patterns, "pattern bigint, n bigint").groupBy("pattern").agg(
        F.sum("n").alias("n")).orderBy("pattern").toPandas()
    votes = seen["pattern"].to_numpy()[:, None] >> np.arange(width) & 1
    sample = found.join(F.broadcast(known), "doc_id").orderBy("doc_id").toPandas()
    if sample.empty:
        return texts.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    mine = voted(sample["units"], sample["marks"])
    # A voter that is hardly more often right than chance on the labelled sample does not vote.
    right = (mine * (sample["label"].to_numpy() == 1)[:, None]).sum(axis=0) / np.maximum(mine.sum(axis=0), 1)
    heard = (right >= 2 * share).astype(np.int64)
    mine = mine * heard
    model = LabelModel().fit(votes * heard, seen["n"].to_numpy(float), share, trusted)

    base = len(lexicon)
    rows = [_feature_row(np.asarray(u, np.int64), v, base) for u, v in zip(sample["units"], mine)]
    weights = _logistic(rows, model.posterior(mine), base + width + 4)

    def scored(batches):
        for batch in batches:
            units = [np.asarray(u, np.int64) for u in batch.column(1).to_pylist()]
            votes = voted(units, batch.column(2).to_pylist()) * heard
            margin = [weights[_feature_row(u, v, base)].sum() + weights[-1] for u, v in zip(units, votes)]
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return found.mapInArrow(scored, "doc_id bigint, score double").select(
        "doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
