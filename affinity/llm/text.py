"""Words, word hashes, shingles, data splits, and size-checked broadcasts shared by the operators."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.session import tune, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CACHED_WORDS = 300_000
_MIX = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def prepared(spark: SparkSession) -> SparkSession:
    """Session options of the text operators: adaptive joins, and Arrow batches of few rows,
    because one text can be very long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def checked_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Marks a narrow table for broadcast if it is counted at ``max_rows`` or fewer; a larger one
    is left to shuffled joins. ``df`` should be stored, for it is counted here."""
    return F.broadcast(df) if df.count() <= max_rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The documents, with all their columns, whose id is not in the table (doc_id), which is stored
    under ``name``. Rows with a null id stay."""
    gone = unused(docs, "gone")
    stored = checked_broadcast(written(ids.select(F.col("doc_id").alias(gone)).distinct(), name))
    return docs.join(stored, docs["doc_id"].cast("bigint") == stored[gone], "left_anti")


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes methods know ASCII only."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words; the cache empties itself when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``WordHashes`` of the words, as ``words_of`` has them, of texts (binary) one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().view(pa.binary()).dictionary_encode()
    _, ends, data = coded.dictionary.buffers()
    ends, data = np.frombuffer(ends, np.int32)[:len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(coded.dictionary))
    at = coded.indices.to_numpy(zero_copy_only=False)
    real = (np.diff(ends) > 0)[at]  # there are empty words beside white space at either end
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        at = at[real]
    return hashes[at], sizes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, at most eight, in order; empty for fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += mixed(hashes[j:j + n] + _MIX[j])
    return mixed(total)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word shingles; a shorter text is one shingle, an empty one none."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes, min(k, len(hashes))))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows of a table of at most ``bound`` rows, else the share ``bound / rows`` of them by a hash of
    ``key``: the same rows whatever the partitions, about ``bound`` in number at any size."""
    rows = df.count()
    if rows <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * bound / rows))


def labelled(docs: DataFrame, labels: DataFrame, label: str, split: int, held: int, bound: int) -> DataFrame:
    """(doc_id, label) of at most about ``bound`` rows to learn from: labels 0 or 1 of documents whose
    crc32 remainder is not ``held``. Conflicting labels of an id count as their maximum."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.filter("label in (0, 1)").filter(remainder(F.col("doc_id"), split) != held)
    return written(
        bounded_sample(usable.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", bound), "labelled")
