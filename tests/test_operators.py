"""Operators on small cases with known results, and streams against batches."""

import datetime as dt
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregates, joins, ranks, road, windows
from millrace.plans.catalogue import _spread
from millrace.sources import readers
from millrace.streaming import run

BASE = dt.datetime(2002, 1, 10)


def at(s):
    return BASE + dt.timedelta(seconds=s)


@pytest.mark.parametrize(
    "offsets,expected",
    [
        ([0, 4, 8], [(0, 3), (4, 7), (8, 11)]),
        ([0, 4, 8, 2, 6], [(0, 11)]),
        ([10, 14, 18, 9, 13], [(9, 13), (13, 17), (18, 21)]),
        ([10, 14, 18, 1, 10, 14, 18, 19, 50], [(1, 4), (10, 13), (14, 17), (18, 22), (50, 53)]),
        ([0, 3], [(0, 3), (3, 6)]),
    ],
)
def test_sessions_touching_stay_apart(spark, offsets, expected):
    df = spark.createDataFrame([(at(s),) for s in offsets], "ts timestamp")
    got = df.groupBy(windows.session("ts", 3).alias("w")).count().select(*windows.session_bounds("w")).collect()
    assert sorted((r.start, r.end) for r in got) == [(at(a), at(b)) for a, b in expected]


def test_interval_bounds_are_half_open(spark):
    us = dt.timedelta(microseconds=1)
    left = spark.createDataFrame([(1, 0, at(10))], "key long, value long, ts timestamp")
    times = [at(9), at(9) - us, at(11), at(11) - us, at(10)]
    right = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "key long, value long, ts timestamp")
    got = joins.interval_join(left, right, "1 second")
    assert {r.right_value for r in got.collect()} == {0, 3, 4} and got.columns == ["key", "left_value", "right_value", "left_ts", "right_ts"]


def test_interval_join_is_the_plain_one(spark):
    rng = random.Random(1)
    rows = lambda n: [(rng.choice([1, 1, 1, 2, None]), i, at(rng.randrange(200))) for i in range(n)]
    a, b = rows(150), rows(150)
    kind = "key long, value long, ts timestamp"
    got = joins.interval_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "7 seconds").collect()
    w = dt.timedelta(seconds=7)
    assert sorted((r.left_value, r.right_value) for r in got) == sorted((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[2] - w <= y[2] < x[2] + w)


def test_count_windows(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    sizes = lambda d: [r["count"] for r in d.groupBy("win_id").count().orderBy("win_id").collect()]
    assert sizes(windows.count_windows(df, 4, ["i"])) == [4, 4, 2]
    assert sizes(windows.count_windows(df, 4, ["i"], compat=True)) == [3, 4, 3]


def test_words_and_lines(spark):
    df = spark.createDataFrame([("It's 'a b2c\nx\n\ny\nz",)], "text string")
    got = df.select(T.words("text").alias("w"), T.inner_lines("text").alias("l")).first()
    assert got.w == ["IT'S", "A", "B", "C", "X", "Y", "Z"] and got.l == ["x", "y"]


def test_packed_records(spark):
    bid = struct.pack("<4q", 1007, -2, 89, 5)
    trip = b"m".ljust(30, b"\0") + b"h".ljust(30, b"\0") + b"VTS\0" + struct.pack("<5q", 1, 60, 120, 2, 9) + struct.pack("<5d", 5.5, -73.25, 40.75, 0.0, -0.5) + b"\x01"
    rtt = b"1.2.3.4-5.6.7.8".ljust(32, b"\0") + struct.pack("<q", 77)
    ad = bytes(range(48)) + b"banner78\0" + b"view\0\0\0\0\0" + struct.pack("<q", 1500) + struct.pack("<I", 0x01020304)
    one = lambda b: spark.createDataFrame([(bytearray(b),)], "value binary")
    assert tuple(readers.bids(one(bid)).first()) == (1007, -2, 89, 5)
    t = readers.trips(one(trip)).first()
    assert (t.medallion, t.vendor_id, t.distance, t.pickup_lon, t.pickup_lat, t.dropoff_lon, t.dropoff_lat, t.store_flag) == ("m", "VTS", 5.5, -73.25, 40.75, 0.0, -0.5, 1)
    assert tuple(readers.round_trips(one(rtt)).first()) == (int.from_bytes(bytes([1, 2, 3, 4, 5, 6, 7, 8]), "little"), 77)
    a = readers.ad_events(one(ad)).first()
    assert (a.ad_type, a.event_type, a.ip) == ("banner78", "view", 0x01020304)
    assert readers.ad_events(one(ad)).select(T.low_uint64(F.col("campaign_id"))).first()[0] == str(int.from_bytes(bytes(range(40, 48)), "little"))


def test_road_stops_and_accidents(spark):
    rows = [(v, t, 0, 5280) for v, ts in ((1, range(0, 5)), (2, range(2, 8)), (3, range(0, 3))) for t in ts] + [(1, 5, 30, 6000)]
    df = spark.createDataFrame(rows, "vid long, time long, speed int, pos long")
    stops = road.stops(df)
    assert sorted(tuple(r) for r in stops.collect()) == [(1, 5280, 1, 3, 5), (2, 5280, 1, 5, None)]
    assert road.accidents(stops).count() == 0
    more = spark.createDataFrame([(9, 5280, 1, 4, 7)], stops.schema)
    assert sorted(tuple(r) for r in road.accidents(stops.unionByName(more)).collect()) == [(5280, 1, 4, 7)]


def _stream(spark, df, tmp_path, times=1):
    df.repartition(times).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(at(i * 7 % 600), i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, k long, v long")
    want = aggregates.keyed(df, "1 minute", ["k"], n=F.count("*"), s=F.sum("v"))
    end = spark.createDataFrame([(at(10**6), 0, 0)], df.schema)
    stream = run.watermarked(_stream(spark, df.unionByName(end), tmp_path))
    got = run.to_memory(aggregates.keyed(stream, "1 minute", ["k"], n=F.count("*"), s=F.sum("v")), "agg", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranks_over_the_whole_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), i, "x") for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "k string, i long, range string")
    got = ranks.with_rank(df, ["k", "i"], "r", 16)
    assert got.columns == ["k", "i", "range", "r"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [r.i for r in got.orderBy("r").collect()] == [r[1] for r in want] and sorted(r.r for r in got.collect()) == list(range(3000))
    tied = spark.range(20_000).select(F.lit(at(0)).alias("ts"), "id")
    edges = ranks._edges(tied, ["ts", "id"], 8)
    sizes = [r["count"] for r in tied.groupBy(ranks._bucket(tied, ["ts", "id"], edges)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    assert ranks.with_rank(tied.limit(0), ["ts", "id"], "r").count() == 0


def test_folds_and_reducers(spark):
    class Longest(aggregates.Fold):
        def add(self, state, values):
            return max([state or "", *values.dropna()], key=lambda x: (len(x), x))

        def merge(self, a, b):
            return max(a, b, key=lambda x: (len(x), x))

    rows = [(i % 3 if i % 7 else None, "x" * (i % 50)) for i in range(500)] + [(9, None)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    got = {r.k: r.longest for r in aggregates.fold(df, Longest(), ["k"], "v", "longest").collect()}
    want = {}
    for k, v in rows:
        want[k] = max(want.get(k, ""), v or "", key=len)
    assert got == {k: f'"{v}"' for k, v in want.items()}
    mean = aggregates.reducer("double")(_mean)
    assert df.groupBy("k").agg(mean(F.length("v")).alias("m")).count() == 5
    near = df.agg(aggregates.sketch_distinct("v")).first()[0]
    assert abs(near - 50) <= 5


def test_reducers_take_many_groups_a_batch(spark):
    def told(x: pd.Series) -> str:
        return f"{x.dtype} {list(x.index)} {sorted(map(str, x))}"

    big = 2**60 + 1
    rows = [(i % 700, big + i, i / 3, str(i), at(i), i % 2 == 0) for i in range(2100)] + [(900, None, None, None, None, None), (901, 5, 1.0, "a", None, True), (901, None, None, None, at(1), None), (None, 7, float("nan"), "b", at(2), False)]
    df = spark.createDataFrame(rows, "k long, i long, d double, s string, t timestamp, b boolean").repartition(5)
    for c in ("i", "d", "s", "t", "b"):
        got = df.groupBy("k").agg(aggregates.reducer("string")(told)(c).alias("told"))
        assert sorted(got.collect(), key=str) == sorted(df.groupBy("k").agg(F.pandas_udf(told, "string")(c).alias("told")).collect(), key=str)
    got = df.groupBy("k").agg(aggregates.reducer("long")(_spread)(F.col("i")).alias("spread"), F.count("*").alias("n"))
    assert {r.k: (r.spread, r.n) for r in got.collect()} == {**{k: (1400, 3) for k in range(700)}, 900: (None, 1), 901: (0, 2), None: (0, 1)}
    folded = aggregates.fold(df, aggregates.Fold(), ["k"], "i", "f")
    for frame in (got, folded):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" in plan and "AggregatePython" not in plan and "AggregateInPandas" not in plan
    assert df.where("k < 0").groupBy("k").agg(aggregates.reducer("long")(_spread)("i").alias("spread")).collect() == []
    assert [r.spread for r in df.where("k < 0").agg(aggregates.reducer("long")(_spread)("i").alias("spread")).collect()] == [None]


def _mean(x: pd.Series) -> float:
    return float(x.mean())


def test_windows_by_arrival_and_sliding(spark):
    df = spark.createDataFrame([(at(0),), (at(59),), (at(61),)], "ts timestamp")
    w = windows.processing_time(df, "1 hour").select("window.start", "window.end").distinct().collect()
    assert all(r.end - r.start == dt.timedelta(hours=1) for r in w) and 1 <= len(w) <= 2
    got = df.groupBy(windows.sliding("ts", "2 minutes", "1 minute").alias("w")).count().select(F.col("w.start"), "count").collect()
    assert sorted(map(tuple, got)) == [(at(-60), 2), (at(0), 3), (at(60), 1)]


@pytest.mark.parametrize("size,stretch", [("1 second", None), ("5 minutes", None), ("35 minutes", None), ("1 day", None), ("5 minutes", 1), ("5 minutes", 3)])
def test_dense_windows(spark, monkeypatch, size, stretch):
    monkeypatch.setattr(aggregates, "STRETCH", stretch or aggregates.STRETCH)
    step, epoch = dt.timedelta(microseconds=windows.micros(size)), dt.datetime(1970, 1, 1)
    rows = [(epoch + 7.5 * step, 1), (epoch - 2.5 * step, 2), (epoch + 7.25 * step, 4), (epoch + 2 * step, None), (None, 8)]

    def dense(rows):
        df = spark.createDataFrame(rows, "ts timestamp, v long")
        return aggregates.dense(aggregates.windowed(df, size, total=F.sum("v")), size, total=0)

    want = [(epoch + i * step, epoch + (i + 1) * step, {-3: 2, 7: 5}.get(i, 0)) for i in range(-3, 8)]
    assert sorted(map(tuple, dense(rows).collect())) == want
    assert dense([]).count() == 0 and dense(rows[-1:]).count() == 0


def test_dense_windows_over_a_long_span(spark):
    df = spark.createDataFrame([(0, 1), (99_999, 2)], "s long, v long").select(F.timestamp_seconds("s").alias("ts"), "v")
    got = aggregates.dense(aggregates.windowed(df, "1 second", total=F.sum("v")), "1 second", total=0)
    a = F.unix_seconds("start")
    assert tuple(got.agg(F.count("*"), F.countDistinct("start"), F.min(a), F.max(a), F.sum("total")).first()) == (100_000, 100_000, 0, 99_999, 3)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_dense_windows_keep_their_length_as_clocks_change(spark):
    df = spark.createDataFrame([(1711670400, 1), (1711929600, 2)], "s long, v long").select(F.timestamp_seconds("s").alias("ts"), "v")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = aggregates.dense(aggregates.windowed(df, "1 day", total=F.sum("v")), "1 day", total=0)
        days = got.select(F.unix_seconds("start").alias("a"), F.unix_seconds("end").alias("z"), "total").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, days)) == [(1711670400 + i * 86400, 1711756800 + i * 86400, (1, 0, 0, 2)[i]) for i in range(4)]


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('12\nx\n-7\n{"text": "hi", "n": 3}\n{"limit": 1}\n')
    path = str(tmp_path / "in")
    assert readers.lines(spark, path).count() == 5
    assert sorted(r.value for r in readers.numbers(spark, path).collect()) == [-7, 12]
    assert [tuple(r) for r in readers.tweets(spark, path).collect()] == [("hi",)]
    got = run.to_memory(readers.numbers(spark, path, stream=True), "numbers", str(tmp_path / "cp"))
    assert sorted(r.value for r in got.collect()) == [-7, 12]
    text = spark.createDataFrame([("abcdefgh", 5), ("ab", 6), (None, 7)], "value string, k int")
    assert [tuple(r) for r in readers.byte_ranges(text, 3).collect()] == [(5, 0, "abc"), (5, 1, "def")]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "b").write_bytes(struct.pack("<8q", 1007, 1, 2, 3, 2001, 4, 5, 6))
    assert [tuple(r) for r in readers.bids(readers.fixed_records(spark, str(tmp_path / "bin"), 32)).collect()] == [(1007, 1, 2, 3), (2001, 4, 5, 6)]


def test_texts_of_events(spark):
    packed = b"u".ljust(36, b"\0") + b"p".ljust(36, b"\0") + b"a" * 36 + b"banner78".ljust(16, b"\0") + b"purchase" + struct.pack("<I", 0xFFFFFFFE)
    got = readers.ad_texts(spark.createDataFrame([(bytearray(packed),)], "value binary")).first()
    assert tuple(got) == ("u", "p", "a" * 36, "banner78", "purchase", 0xFFFFFFFE, 0)
    csv = readers.ad_csv(spark.createDataFrame([("17,a-b,c,d-e-f,mail,view,1.2.3.4",)], "value string")).first()
    assert (csv.user_id, csv.ad_id, csv.num_event_type) == ("ab", "def", 2)
    assert readers.generated_ads(spark, 300).groupBy("event_type").count().where("count = 100").count() == 3
    assert readers.counter(spark, 2050).groupBy("ts").count().count() == 3
    lines = spark.createDataFrame([("good\t3",), ("not good -2",), ("bad",), ("",), (None,), ("x y z",)], "value string")
    lexicon = T.lexicon_lines(lines)
    assert sorted(map(tuple, lexicon.collect())) == [("good", 3), ("not good", -2)]
    said = spark.createDataFrame([(1, "good not\tgood"), (2, None), (3, "")], "i int, text string")
    got = T.token_scores(said, "text", lexicon).groupBy("i").agg(F.sum("score").alias("s")).collect()
    assert sorted(map(tuple, got)) == [(1, 6), (2, 0), (3, 0)]


def _closing(spark, df):
    """The rows and one far later, which closes all windows before it."""
    return df.unionByName(spark.createDataFrame([(at(10**7), *[None] * (len(df.columns) - 1))], df.schema))


def test_stream_windows_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([(at(rng.randrange(3600)), i % 4, i) for i in range(800)], "ts timestamp, k long, v long")
    kinds = {
        "sliding": lambda d: aggregates.sliding_sum(d, "v", 3, "1 minute", keys=["k"]),
        "session": lambda d: d.groupBy("k", windows.session("ts", 20).alias("w")).agg(F.count("*").alias("n")).select("k", *windows.session_bounds("w"), "n"),
        "sets": lambda d: aggregates.windowed(d, "5 minutes", n=F.size(F.collect_set("k"))),
        "tumbling": lambda d: aggregates.keyed(d, "90 seconds", ["k"], n=F.sum("v")),
    }
    for name, of in kinds.items():
        stream = run.watermarked(_stream(spark, _closing(spark, df).coalesce(1), tmp_path / name))
        got = run.to_memory(of(stream), name, str(tmp_path / name / "cp"))
        assert sorted(map(tuple, got.where(f"{'end'} < '2002-03-01'").collect())) == sorted(map(tuple, of(df).collect())), name


def test_stream_top_k(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(at(rng.randrange(600)), rng.randrange(30)) for _ in range(900)], "ts timestamp, k long")
    want = windows.top_k(aggregates.keyed(df, "1 minute", ["k"], n=F.count("*")), 3, "start", "n", "k").select("start", "k", "n").collect()
    of = lambda name: aggregates.keyed(run.watermarked(_stream(spark, _closing(spark, df).coalesce(1), tmp_path / name)), "1 minute", ["k"], keep_window=True, n=F.count("*"))
    got = run.to_memory(run.top_k(of("a"), 3, "n", "k").select("window.start", "k", "n"), "top", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.where("k IS NOT NULL").collect())) == sorted(map(tuple, want))
    seen = []
    run.top_k_batches(of("b"), 3, "n", "k", lambda d, i: seen.extend(map(tuple, d.select("start", "k", "n").collect())), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r for r in seen if r[1] is not None) == sorted(map(tuple, want))


def test_late_rows_are_dropped(spark, tmp_path):
    for i, rows in enumerate([[(at(10), 1), (at(70), 1)], [(at(500), 1)], [(at(20), 1), (at(490), 1)], [(at(10**6), 1)]]):
        spark.createDataFrame(rows, "ts timestamp, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, v long").parquet(str(tmp_path / "in"))
        counts = aggregates.windowed(run.watermarked(stream, delay="30 seconds"), "1 minute", n=F.count("*"))
        run.to_parquet(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {at(0): 1, at(60): 1, at(480): 2}  # the row of 20 s came after 470 s had been declared past


def test_stream_join_with_late_state(spark, tmp_path):
    kind = "key long, value long, ts timestamp"
    rows = lambda seed: [(i % 5, i, at((i * seed) % 900)) for i in range(200)]
    a, b = spark.createDataFrame(rows(7), kind), spark.createDataFrame(rows(11), kind)
    side = lambda d, n: run.watermarked(_stream(spark, d, tmp_path / n, 3), delay="1 hour")
    got = run.to_memory(joins.interval_join(side(a, "a"), side(b, "b"), "10 seconds"), "joined", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joins.interval_join(a, b, "10 seconds").collect()))


def test_stream_count_windows_go_on_after_a_restart(spark, tmp_path):
    out = []
    for i in range(3):
        spark.range(25 * i, 25 * i + 25).withColumn("rank", F.lit("mine")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, rank string").parquet(str(tmp_path / "in"))
        run.count_windows(stream, 10, ["id"], str(tmp_path / "cp"), lambda d, i: out.extend((r.id, r.win_id, r.rank) for r in d.collect())).awaitTermination()
    assert sorted(out) == [(i, i // 10, "mine") for i in range(75)]


def _road(spark):
    rng, rows = random.Random(5), []
    for v in range(12):
        pos, stands = 0, 0
        for t in range(0, 1500, 30):
            stands = stands - 1 if stands else (rng.randrange(3, 9) if rng.random() < 0.15 else 0)
            pos = rng.choice([100, 200, 6000]) if not stands or pos not in (100, 200, 6000) else pos
            rows.append((v, t, 0 if stands else 70 + v, pos, at(t)))
    return spark.createDataFrame(rows, "vid long, time long, speed int, pos long, ts timestamp")


def test_stream_road_equals_batch(spark, tmp_path):
    reports = _road(spark)
    stopped = road.stops(reports)
    assert stopped.count() > 5 and road.accidents(stopped).count() > 1
    rows = reports.orderBy("time").collect()
    for low in range(0, 1500, 500):
        spark.createDataFrame([r for r in rows if low <= r.time < low + 500], reports.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = run.watermarked(spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    events = run.collected(run.road_stops(stream), str(tmp_path / "stops"), str(tmp_path / "cp1"))
    want = [(r.vid, r.pos, r.seg, r.stopped_at, True) for r in stopped.collect()] + [(r.vid, r.pos, r.seg, r.left_at, False) for r in stopped.collect() if r.left_at is not None]
    assert sorted(map(tuple, events.collect())) == sorted(want)
    again = spark.readStream.schema(run.STOPS).parquet(str(tmp_path / "stops"))
    turns = run.collected(run.road_accidents(again), str(tmp_path / "crashes"), str(tmp_path / "cp2"))
    spans = sorted(map(tuple, run.accident_spans(turns).collect()), key=str)
    assert spans == sorted(map(tuple, road.accidents(stopped).collect()), key=str)
    out, speeds = [], road.segment_speeds(reports)
    speeds.write.parquet(str(tmp_path / "speeds"))
    slots = spark.readStream.schema(speeds.schema).parquet(str(tmp_path / "speeds"))
    run.road_tolls(slots, lambda: run.accident_spans(turns), lambda d, i: out.extend(map(tuple, d.collect())), str(tmp_path / "cp3")).awaitTermination()
    assert sorted(out) == sorted(map(tuple, road.tolls(speeds, road.accidents(stopped)).collect()))
    assert road.toll_sums(reports, "1 second").agg(F.sum("total")).first()[0] == sum(r[2] for r in out)


def test_stream_vehicles_are_forgotten(spark, tmp_path):
    parts = [[(1, t, 0, 5, at(t)) for t in range(3)], [(2, 9000, 9, 9, at(9000))], [(3, 9001, 9, 9, at(9001))], [(1, t, 0, 5, at(t)) for t in (9002, 9003)]]
    for rows in parts:
        spark.createDataFrame(rows, "vid long, time long, speed int, pos long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = run.watermarked(spark.readStream.schema("vid long, time long, speed int, pos long, ts timestamp").parquet(str(tmp_path / "in")))
        got = run.collected(run.road_stops(stream, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.count() == 0  # three reports before and two after a long silence aren't five
    nulls = spark.createDataFrame([(None, 1, 0, 5, at(0)), (4, None, 0, 5, at(0))], "vid long, time long, speed int, pos long, ts timestamp")
    assert run.to_memory(run.road_stops(_stream(spark, nulls, tmp_path / "n"), None), "none", str(tmp_path / "n" / "cp")).count() == 0


def test_sinks_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([(at(i), i) for i in range(300)], "ts timestamp, v long")
    stream = _stream(spark, df, tmp_path, 3)
    seen = []
    query = run.counting(run.observed(stream.where("v >= 100"), "kept"), str(tmp_path / "cp"), lambda i, n: seen.append(n))
    query.awaitTermination()
    assert sum(seen) == 200 and len(run.progress(query)) == 3
    stats = {r["name"]: r for r in run.statistics(query, 16)}
    assert set(stats) == {"source", "kept"} and stats["source"]["avg_krec_s"] > stats["kept"]["avg_krec_s"] > 0 and stats["source"]["mb_s"] > 0
    counts = aggregates.windowed(run.watermarked(stream), "1 minute", n=F.count("*"))
    assert 0 < run.first_result_ms(counts, str(tmp_path / "cp2")) < 120_000
    twice = readers.replayed(spark, str(tmp_path / "in"), "ts timestamp, v long", 2)
    assert run.to_memory(twice.groupBy("pass").count(), "twice", str(tmp_path / "cp3"), "complete").where("count = 300").count() == 2
    rate = readers.rate(spark, 5)
    query = rate.writeStream.format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "cp4")).trigger(processingTime="200 milliseconds").start()
    query.awaitTermination(3)
    query.stop()
    assert spark.table("rate").count() % 5 == 0


def test_lookups_by_size(spark):
    rows, table = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    plan = lambda most: joins.lookup_join(rows, table, "k", most)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1 << 20) and "strategy=broadcast" not in plan(10)
    assert joins.lookup_join(rows, table, "k").count() == 50
