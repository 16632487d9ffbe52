import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity import functions as fn
from affinity.schemas import CONTEXT_PREF, EVENT, EVENT_ID, PREF
from affinity.sources import (
    read_context_preferences, read_events, read_points, read_preferences, write_context_preferences,
    write_points, write_preferences,
)
from affinity.streaming import track_events
from tests.conftest import rows


def prefs(spark):
    return spark.createDataFrame([("s", "a", 1, 2.5), ("t", "b", 2, 5.0)], PREF)


def test_preferences_by_name(spark, tmp_path):
    prefs(spark).select("score", "item", "site", "user", F.lit(1).alias("x")).write.parquet(str(tmp_path / "p"))
    back = read_preferences(spark, str(tmp_path / "p"))
    assert back.schema == PREF and rows(back) == rows(prefs(spark))


def test_preference_sinks(spark, tmp_path):
    write_preferences(prefs(spark), str(tmp_path / "s"), by_site=True)
    back = read_preferences(spark, str(tmp_path / "s"), by_site=True)
    assert rows(back) == rows(prefs(spark))
    plan = back.filter("site = 't'")._jdf.queryExecution().toString()
    assert "by_site" in plan.split("PartitionFilters: [")[1].split("]")[0]
    write_preferences(prefs(spark), str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    with pytest.raises(ValueError):
        write_preferences(prefs(spark), str(tmp_path / "d"), "avro")
    with pytest.raises(ValueError):
        write_preferences(prefs(spark).drop("score"), str(tmp_path / "d"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("by_site", [True, False])
def test_sites_keep_their_names(spark, tmp_path, fmt, by_site):
    sites = ["007", "7", "2024-01-02", "1e3", "true", "", None]
    sent = spark.createDataFrame([(s, "0", n, n / 7) for n, s in enumerate(sites)], PREF)
    write_preferences(sent, str(tmp_path / "p"), fmt, by_site=by_site)
    back = read_preferences(spark, str(tmp_path / "p"), fmt, by_site)
    assert back.schema == PREF
    assert sorted(map(str, back.collect())) == sorted(map(str, sent.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_context_preferences(spark, tmp_path, fmt):
    sent = spark.createDataFrame(
        [(1, "01", "u", "5", "view", 0, 9, None, 1.0), (2, "01", "u", "6", "view", 1, 9, "5", 2.0)],
        T.StructType([EVENT_ID, *CONTEXT_PREF]))
    write_context_preferences(sent, str(tmp_path / "c"), fmt)
    back = read_context_preferences(spark, str(tmp_path / "c"), fmt)
    assert back.schema == sent.schema and sorted(map(str, back.collect())) == sorted(map(str, sent.collect()))


def test_a_batch_sent_twice(spark, tmp_path):
    sent = spark.createDataFrame(
        [("s", "u", n, "view", dt.datetime(2024, 1, 1 + n % 3), n) for n in range(6)], EVENT)
    for batch in (sent, sent, sent.limit(0), sent.unionByName(sent)):
        track_events(batch, str(tmp_path / "e"))
    assert rows(spark.read.parquet(str(tmp_path / "e")), "event_id") == [(n,) for n in range(6)]


def test_an_id_is_stored_once_across_dates_and_runs(spark, tmp_path):
    def event(n, day):
        return ("s", "u", n, "view", dt.datetime(2024, 1, day), n)

    path = str(tmp_path / "e")
    track_events(spark.createDataFrame([event(1, 5), event(1, 3), event(2, 4)], EVENT), path)
    assert rows(spark.read.parquet(path), "event_id", "date") == [(1, dt.date(2024, 1, 3)), (2, dt.date(2024, 1, 4))]
    track_events(spark.createDataFrame([event(1, 9), event(2, 9), event(3, 9)], EVENT), path)
    assert rows(spark.read.parquet(path), "event_id") == [(1,), (2,), (3,)]
    spark.createDataFrame([event(3, 2), event(4, 2), event(4, 3)], EVENT).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    for run in ("a", "b"):  # a stream started anew sends all again
        track_events(stream, path, str(tmp_path / run), "30 days").awaitTermination()
        assert rows(spark.read.parquet(path), "event_id") == [(1,), (2,), (3,), (4,)]
    assert sorted(r.event_id for r in spark.read.parquet(f"{path}/_ids").collect()) == [1, 2, 3, 4]
    # A store without an index gets one; an index that misses a stored event does not store it twice.
    bare = str(tmp_path / "bare")
    spark.read.parquet(path).write.partitionBy("date").parquet(bare)
    track_events(spark.createDataFrame([event(1, 20), event(7, 20)], EVENT), bare)
    assert rows(spark.read.parquet(bare), "event_id") == [(1,), (2,), (3,), (4,), (7,)]


@pytest.mark.parametrize("fmt", ["text", "parquet"])
def test_points(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1.5, [1.0, 0.0]), (2.0, [0.25, 1.0])], "target double, features array<double>")
    write_points(df, str(tmp_path / "p"), fmt)
    assert rows(read_points(spark, str(tmp_path / "p"), fmt)) == rows(df)


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        read_points(spark, "x", "avro")


@pytest.mark.parametrize("fmt", ["json", "csv", "orc"])
def test_events_from_any_format(spark, tmp_path, fmt):
    raw = spark.createDataFrame([(7, "3", "view")], "who long, thing string, kind string")
    raw.write.format(fmt).option("header", True).save(str(tmp_path / "e"))
    got = read_events(
        spark, fmt, {"path": str(tmp_path / "e"), "header": "true"},
        {"user": "cast(who as string)", "item": "cast(thing as int)", "event": F.col("kind")}, raw.schema)
    assert rows(got) == [("7", 3, "view")]


def test_json_results(spark):
    docs = fn.to_result_json(prefs(spark).select(F.array(F.struct(*PREF.names)).alias("items")))
    assert '{"items":[{"site":"s","user":"a","item":1,"score":2.5}]}' in [r.json for r in docs.collect()]
    assert rows(docs.select(F.inline(fn.parse_result(F.col("json"), "preferences")["items"]))) == rows(prefs(spark))
    with pytest.raises(ValueError):
        fn.parse_result(F.col("json"), "unknown")


@pytest.mark.parametrize("kind, text", [
    ("scored_fields", '{"items":[{"name":"a","score":0.5}]}'),
    ("similar_columns", '{"items":[{"col":1,"items":[{"col":2,"score":0.5}]}]}'),
    ("similar_fields", '{"items":[{"name":"a","items":[{"name":"b","score":0.5}]}]}'),
    ("targeted_point", '{"features":[1.0,0.0],"target":0.5}'),
])
def test_result_kinds(spark, kind, text):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(F.to_json(fn.parse_result(F.col("j"), kind))).first()[0] == text


def test_user_rules(spark):
    text = ('{"items":[{"site":"s","user":"u","items":[{"antecedent":[1],"consequent":[2,3],"support":4,'
            '"confidence":0.5,"weight":1.0}]}]}')
    got = fn.parse_user_rules(spark.createDataFrame([(text,)], "j string"), "j")
    assert [tuple(r) for r in got.collect()] == [("s", "u", [1], [2, 3], 4, 0.5, 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12)
    data = [("s", "u", n % 5, "view", t0 + dt.timedelta(hours=n), n) for n in range(60)]
    sent = spark.createDataFrame(data, EVENT)
    for part in range(3):
        sent.filter(F.col("event_id") % 3 == part).unionByName(sent.filter(F.col("event_id") < 5)).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        track_events(stream, str(tmp_path / "out"))
    track_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "10 days").awaitTermination()
    track_events(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "batch"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 60
    assert rows(got, "event_id", "item") == rows(spark.read.parquet(str(tmp_path / "batch")), "event_id", "item")
    # A second batch is appended.
    track_events(sent.limit(0), str(tmp_path / "batch"))
    assert spark.read.parquet(str(tmp_path / "batch")).count() == 60


def test_wide_points_have_small_row_groups(spark, tmp_path):
    """Equal cells shrink to nothing on disk, so rows of a group are limited by what they decode to."""
    import pyarrow.parquet as pq

    width = 1 << 17
    df = spark.range(0, 100, 1, 1).select(
        F.col("id").cast("double").alias("target"), F.array_repeat(F.lit(0.5), width).alias("features"))
    write_points(df, str(tmp_path / "p"), "parquet", width=width)
    sizes = [
        pq.ParquetFile(f).metadata.row_group(n).num_rows for f in (tmp_path / "p").glob("*.parquet")
        for n in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(sizes) == 100 and max(sizes) <= 32
    got = read_points(spark, str(tmp_path / "p"), "parquet").select("target", F.size("features").alias("n"))
    assert rows(got) == [(float(n), width) for n in range(100)]


def test_compressed_text_points(spark, tmp_path):
    df = spark.createDataFrame([(1.0, [0.0, 1.0, 0.5]), (2.5, [1.0, 0.0, 0.0])], "target double, features array<double>")
    write_points(df, str(tmp_path / "p"), "text", compression="gzip")
    assert list((tmp_path / "p").glob("*.gz"))
    assert rows(read_points(spark, str(tmp_path / "p"), "text")) == rows(df)


def test_wide_points_decode_to_little_memory():
    """Readers hold levels and nulls beside the cells and grow by doubling, so a row group is 8 MB of doubles at most."""
    from affinity.session import wide_rows

    for width in (1, 9335, 1 << 20, 1 << 24):
        rows_of_group = int(wide_rows(width)["parquet.block.row.count.limit"])
        assert rows_of_group == 1 or rows_of_group * width * 8 <= 8 << 20
