"""Append tracked events to the event store, from a batch or a stream."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.session import written
from affinity.validation import check_columns

#: The id index lies in the store; readers pass over names that begin with an underscore.
_IDS, _BUCKETS = "_ids", 256


def _dated(events: DataFrame) -> DataFrame:
    """Event time as ``timestamp`` (a watermark takes no other) and the date to store under."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withColumn("date", F.to_date("ts"))


def _unseen(dated: DataFrame, path: str) -> DataFrame:
    """The events whose id is not stored yet; only the dates they touch are read."""
    kept = [f for f in dated.schema if f.name == "event_id"] + [T.StructField("date", T.DateType())]
    try:
        stored = dated.sparkSession.read.schema(T.StructType(kept)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return dated
    touched = stored.join(dated.select("date").distinct(), "date", "left_semi")
    return dated.join(touched, ["date", "event_id"], "left_anti").select(*dated.columns)


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    """(event_id, bucket) of the store's id index; one made of the stored ids where there is none yet."""
    ids = f"{path}/{_IDS}"
    try:
        return spark.read.parquet(ids)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    _append_ids(stored.select("event_id").distinct(), path)
    return spark.read.parquet(ids)


def _bucket(event_id: str):
    return F.pmod(F.xxhash64(event_id), F.lit(_BUCKETS)).cast("int")


def _append_ids(ids: DataFrame, path: str) -> None:
    (ids.filter("event_id is not null").withColumn("bucket", _bucket("event_id")).hint("rebalance", "bucket")
     .sortWithinPartitions("bucket", "event_id").write.mode("append").partitionBy("bucket")
     .option("parquet.bloom.filter.enabled#event_id", "true").parquet(f"{path}/{_IDS}"))


def append_once(events: DataFrame, path: str) -> None:
    """Append the events of a batch whose id is not stored under any date.

    Of rows that repeat an id the earliest stays. Ids are looked up in the index beside the store, which
    is laid out by a hash of the id, so a batch reads the buckets of its ids only. First the
    events are appended, then their ids: if a run fails between, the batch can be sent again, for stored events of the
    same date are looked at too. Rows without an id are kept once a batch and date.
    """
    cells = F.struct(*events.columns)
    once = _dated(events).groupBy("event_id").agg(
        F.min_by(cells, F.struct("ts", F.xxhash64(*[F.col(c).cast("string") for c in events.columns]))).alias("e"))
    once = _dated(once.select("e.*"))
    spark = events.sparkSession
    index = _index(spark, path)
    if index is not None:
        placed = once.withColumn("bucket", _bucket("event_id"))
        # At most as many rows as there are buckets.
        asked = F.broadcast(placed.select("bucket").distinct())
        known = index.join(asked, "bucket", "left_semi").select("event_id", "bucket")
        once = placed.join(known, ["bucket", "event_id"], "left_anti").select(*once.columns)
    fresh = written(once, "tracked")
    new = _unseen(fresh, path)
    new.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)
    _append_ids(fresh.select("event_id"), path)


def track_events(
    events: DataFrame, path: str, checkpoint: str | None = None, lateness: str = "1 day",
    trigger: dict | None = None,
):
    """Append events to a Parquet store laid out by date, each event id once, whatever its date.

    A batch drops repeats within itself and of all stored events, so it can be sent again after a failure; it
    returns None. The rebalance hint cuts a busy date into even files and merges small
    ones. A stream drops repeats arriving within ``lateness`` in keyed state with timers, which that
    bounds, and appends each of its batches in the same way; it returns the running query.
    ``checkpoint`` must be a folder every executor can reach. Two writers of one store at the
    same time are not compared with each other.
    """
    check_columns(events, ["event_id", "ts"], "events")
    if not events.isStreaming:
        append_once(events, path)
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")
    once = (
        _dated(events).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]).drop("date")
    )
    return (
        once.writeStream.foreachBatch(lambda batch, _: append_once(batch, path))
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
