"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Counts of 1-, 2- and 3-grams of lower-cased signs in ``BUCKETS`` buckets are weighted by inverse document
frequency over all documents to learn from, and scaled to unit length. Weights are learned by
follow-the-regularized-leader with an L1 and an L2 penalty, so most stay 0. A temperature,
fitted on rows kept apart, calibrates the probabilities.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.text import remainder
from affinity.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
SAMPLE_ROWS = 3_000
EPOCHS = 3
L1, L2, ALPHA, BETA = 0.02, 0.001, 0.5, 1.0
UNKNOWN = "und"
_ODD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, ascending, and their counts."""
    signs = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    rolled, found = np.zeros(len(signs), np.uint32), []
    for n in range(3):
        if len(signs) <= n:
            break
        rolled = (rolled[:len(signs) - n] ^ (signs[n:] + np.uint32(n + 1))) * _ODD[n]
        rolled ^= rolled >> np.uint32(15)
        found.append(rolled % np.uint32(BUCKETS))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS, np.int64)
    at = np.nonzero(counts)[0]
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _frequencies(batches):
    """One vector of document frequencies for each task, as 32-bit counts."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total[gram_counts(text)[0]] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def _added(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            total += np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


class Model:
    """Weights, document weights and the temperature; ``langs`` in order."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.temperature = langs, idf, 1.0
        self.weights = np.zeros((BUCKETS, len(langs)), np.float32)

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = gram_counts(text)
        x = (1 + np.log(counts)) * self.idf[at]
        return at, x / max(np.linalg.norm(x), 1e-12)

    def probabilities(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        margin = (x @ self.weights[at]) / self.temperature
        p = np.exp(margin - margin.max())
        return p / p.sum()

    def fit(self, rows: list, target: np.ndarray, seed: int = 3) -> "Model":
        """FTRL-proximal, one row at a time; the last fifth of the rows fits the temperature."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        apart = order[len(order) - len(order) // 5:] if len(order) >= 10 else order
        learn = order[:len(order) - len(order) // 5] if len(order) >= 10 else order
        z, n = np.zeros((BUCKETS, len(self.langs))), np.zeros((BUCKETS, len(self.langs)))

        def leader(at):
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
            return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

        for _ in range(EPOCHS):
            for i in rng.permutation(learn):
                at, x = rows[i]
                w = leader(at)
                margin = x @ w
                p = np.exp(margin - margin.max())
                p /= p.sum()
                p[target[i]] -= 1
                g = x[:, None] * p
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - step * w
                n[at] += g * g
        self.weights = leader(np.arange(BUCKETS)).astype(np.float32)
        margins = np.stack([rows[i][1] @ self.weights[rows[i][0]] for i in apart])

        def loss(t):
            scaled = margins / t
            scaled = scaled - scaled.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(apart)), target[apart]]))

        self.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        return self


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents (doc_id, text, lang).

    Document frequencies come from all rows with a language whose crc32(doc_id) mod 4 is not 2; the regression
    learns from about ``SAMPLE_ROWS`` of them, an equal share of each language, so at most that many
    languages. The score is the calibrated probability of the predicted language.

    A null or empty text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing
    to learn from. Rows with a null id are predicted, not learned from, and not called held out. Repeated
    rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
    learn = texts.filter("lang is not null and text is not null").filter(remainder(F.col("doc_id"), 4) != 2)
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()}
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    if not counts:
        return texts.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    each = max(1, SAMPLE_ROWS // len(counts))
    shares = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    # The sum of at most 32 vectors of fixed size is left to the driver.
    vectors = written(
        learn.select("text").mapInArrow(_frequencies, "counts binary").repartition(32).mapInArrow(
            _added, "counts binary"), "frequencies").toArrow()
    seen = sum(np.frombuffer(v, np.int64) for v in vectors.column(0).to_pylist())
    total = sum(counts.values())
    langs = sorted(counts)
    model = Model(langs, np.log((total + 1) / (seen + 1)) + 1)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000

    def prepared(batches):
        for batch in batches:
            rows = [model.row(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([a for a, _ in rows], pa.list_(pa.int32())),
                pa.array([x.astype(np.float32) for _, x in rows], pa.list_(pa.float32()))],
                names=["doc_id", "lang", "at", "x"])

    sample = learn.filter(chance < shares[F.col("lang")]).select("doc_id", "text", "lang").mapInArrow(
        prepared, "doc_id bigint, lang string, at array<int>, x array<float>").orderBy("doc_id", "lang").toArrow()
    rows = [(np.asarray(a.values), np.asarray(x.values, np.float64)) for a, x in zip(sample.column("at"), sample.column("x"))]
    target = np.searchsorted(np.array(langs), np.array(sample.column("lang").to_pylist(), dtype=np.array(langs).dtype)) \
        if rows else np.zeros(0, np.int64)
    if rows:
        model.fit(rows, target)

    def predicted(batches):
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1).to_pylist():
                if has_letter(text):
                    p = model.probabilities(*model.row(text))
                    names.append(langs[int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return texts.select("doc_id", "text").mapInArrow(
        predicted, "doc_id bigint, lang_pred string, score double").select("doc_id", held, "lang_pred", "score")
