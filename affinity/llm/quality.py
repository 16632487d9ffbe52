"""Quality scores by a factorization machine over hashed words, structure statistics and metadata.

Inputs of a text: its distinct words in ``BUCKETS`` buckets, together of unit length, and one indicator for the
bin of each statistic. The score is the logistic of w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum
v_if^2 x_i^2), which is linear in the number of inputs.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.text import WordHashes, labelled, remainder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 13
BINS = 8
FACTORS = 8
EPOCHS = 8
THRESHOLD = 0.7
STATISTICS = (
    "n_chars", "n_words", "word_length", "distinct_words", "most_frequent_word", "repeated_neighbours",
    "letters", "upper_words", "marks", "digits", "bars", "closing_marks", "lines", "repeated_lines", "longest_word")
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def statistics(text: bytes, words: list[bytes], hashes: np.ndarray, n_chars: float) -> list[float]:
    """The values of ``STATISTICS``; shares of an empty text are 0."""
    n, size = max(len(words), 1), max(len(text), 1)
    lines = text.split(b"\n")
    _, counts = np.unique(hashes, return_counts=True)
    marks = size - len(text.translate(None, _MARKS))
    letters = len(text.translate(None, _MARKS + b"0123456789 \t\n\r\x0b\x0c"))
    return [
        np.log1p(n_chars), np.log1p(len(words)), letters / n, len(counts) / n,
        counts.max() / n if len(counts) else 0.0, float((hashes[1:] == hashes[:-1]).sum()) / n,
        letters / size, sum(w.isupper() for w in words) / n, marks / size,
        (size - len(text.translate(None, b"0123456789"))) / size, text.count(b"|") / n,
        (text.count(b"!") + text.count(b"?")) / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        np.log1p(max(map(len, words), default=0))]


def _inputs(hashes_of: WordHashes, text: bytes | None, n_chars: int | None):
    text = text or b""
    words = text.split()
    hashes = hashes_of.of(words)
    buckets = np.unique(hashes % np.uint64(BUCKETS)).astype(np.int64)
    chars = n_chars if n_chars is not None and n_chars >= 0 else len(text.decode("utf-8", "replace"))
    return buckets, statistics(text, words, hashes, chars)


def _extract(batches):
    hashes = WordHashes()
    for batch in batches:
        rows = [_inputs(hashes, t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([b for b, _ in rows], pa.list_(pa.int32())),
            pa.array([s for _, s in rows], pa.list_(pa.float64())), batch.column(3)],
            names=["doc_id", "buckets", "statistics", "label"])


class Machine:
    """The factorization machine; ``edges`` cut statistics into bins."""

    def __init__(self, edges: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.edges, self.width = edges, BUCKETS + len(STATISTICS) * BINS
        self.bias, self.linear = 0.0, np.zeros(self.width)
        self.factors = rng.normal(0, 0.02, (self.width, FACTORS))

    def row(self, buckets: np.ndarray, values) -> tuple[np.ndarray, np.ndarray]:
        bins = (np.asarray(values)[:, None] > self.edges).sum(axis=1) + np.arange(len(STATISTICS)) * BINS
        weight = np.full(len(buckets), 1 / np.sqrt(max(len(buckets), 1)))
        return np.concatenate([buckets, BUCKETS + bins]), np.concatenate([weight, np.ones(len(bins))])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        weighted = self.factors[at] * x[:, None]
        total = weighted.sum(axis=0)
        return self.bias + self.linear[at] @ x + 0.5 * float((total * total - (weighted * weighted).sum(axis=0)).sum())

    def fit(self, rows: list, target: np.ndarray, rate: float = 0.1, ridge: float = 1e-5, seed: int = 5) -> "Machine":
        """AdaGrad on batches of 64 rows; the rarer label is not weighted, so scores stay probabilities."""
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(self.width, 1e-6), np.full((self.width, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), 64):
                part = order[start:start + 64]
                at = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                ends = np.cumsum([0] + [len(rows[i][0]) for i in part])[:-1]
                owner = np.repeat(np.arange(len(part)), np.diff(np.append(ends, len(at))))
                weighted = self.factors[at] * x[:, None]
                total = np.add.reduceat(weighted, ends)
                margin = self.bias + np.add.reduceat(self.linear[at] * x, ends) + 0.5 * (
                    (total * total).sum(axis=1) - np.add.reduceat((weighted * weighted).sum(axis=1), ends))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[part]) / len(part)
                g = error[owner] * x
                slope_v = g[:, None] * (total[owner] - weighted) + ridge * self.factors[at]
                own, back = np.unique(at, return_inverse=True)
                g_w, g_v = np.zeros(len(own)), np.zeros((len(own), FACTORS))
                np.add.at(g_w, back, g + ridge * self.linear[at])
                np.add.at(g_v, back, slope_v)
                seen_w[own] += g_w * g_w
                seen_v[own] += g_v * g_v
                self.linear[own] -= rate * g_w / np.sqrt(seen_w[own])
                self.factors[own] -= rate / 2 * g_v / np.sqrt(seen_v[own])
                seen_b += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(seen_b)
        return self


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents (doc_id, text, n_chars); labels (doc_id, quality).

    Learns from about ``SAMPLE_ROWS`` labelled rows whose crc32(doc_id) mod 4 is not 2. Inputs are the whole text
    and ``n_chars``; a null or missing ``n_chars`` is counted from the text. Null and empty texts are
    scored by their statistics. Rows with a null id are scored, not learned from, and not called
    held out. Repeated rows each give a row; other columns are ignored; an empty table gives no
    rows. Without labels of both kinds every score is 1, so that nothing is rejected unlearned.
    """
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), n_chars.alias("n_chars"))
    known = labelled(docs, labels, "quality", 4, 2, SAMPLE_ROWS)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "n_chars", "label").mapInArrow(
        _extract, "doc_id bigint, buckets array<int>, statistics array<double>, label int").orderBy("doc_id").toPandas()
    if sample["label"].nunique() < 2:
        return texts.select("doc_id", held, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    values = np.stack(sample["statistics"])
    machine = Machine(np.quantile(values, np.arange(1, BINS) / BINS, axis=0).T)
    rows = [machine.row(np.asarray(b, np.int64), s) for b, s in zip(sample["buckets"], sample["statistics"])]
    machine.fit(rows, sample["label"].to_numpy(float))

    def scored(batches):
        hashes = WordHashes()
        for batch in batches:
            margin = [machine.margin(*machine.row(*_inputs(hashes, t, n)))
                      for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "score"])

    return texts.mapInArrow(scored, "doc_id bigint, score double").select(
        "doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
