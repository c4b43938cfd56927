import datetime as dt
import random
from collections import deque

from quarry.operators import guard
from quarry.streaming import requests as streams

REQUEST = "request_id string, ts timestamp, method string, path string, client string, origin string"
NOON = dt.datetime(2025, 1, 1, 12, tzinfo=dt.UTC)


def requests(n, seed=0):
    random.seed(seed)
    rows = []
    for i in range(n):
        at = NOON + dt.timedelta(seconds=random.choice([0, 1, 59, 60, 61, 300]) + 20 * (i // 3))
        rows.append((f"r{i:04}", at, random.choice(["POST", "POST", "GET"]), random.choice(["/query", "/other"]), random.choice(["a", "b", None]), None))
    return [*rows, rows[0], (None, NOON, "POST", "/query", "a", None), ("late", None, "POST", "/query", "a", None)]


def plainly(rows, most, window):
    logs, out = {}, {}
    seen = {r[0]: r for r in rows if r[0] and r[1] and r[2] == "POST" and r[3] == "/query"}
    for r in sorted(seen.values(), key=lambda r: (r[1], r[0])):
        log = logs.setdefault(r[4] or "unknown", deque())
        out[r[0]] = guard.decide(log, int(r[1].timestamp() * 1e6), most, window * 1_000_000)
    return out


def test_limits_as_a_plain_loop(spark):
    rows = requests(400)
    df = spark.createDataFrame(rows, REQUEST)
    got = {r.request_id: (r.accepted, r.remaining, r.retry_after) for r in guard.limited(df, (("query", "/query", 3, 60),)).collect()}
    assert got == plainly(rows, 3, 60)
    assert guard.limited(df.limit(0)).count() == 0


def test_an_event_a_window_old_is_expired():
    log = deque([0])
    assert guard.decide(log, 60_000_000, 1, 60_000_000) == (True, 0, 0)
    assert guard.decide(log, 60_000_001, 1, 60_000_000) == (False, 0, 60)


def test_streamed_limits_equal_batch(spark, tmp_path):
    rows = requests(120, 3)
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.parquet(str(tmp_path / "requests.parquet"))
    policies = (("query", "/query", 3, 60),)
    stream = streams.limited_stream(streams.read_requests(spark, str(tmp_path)), policies)
    got = {r.request_id: r.accepted for r in streams.collected(stream, str(tmp_path / "work")).collect()}
    assert got == {k: v[0] for k, v in plainly(rows, 3, 60).items()}
    assert len(streams.collected(stream, str(tmp_path / "again")).collect()) == len(got)
    counts = streams.collected(streams.counted_stream(streams.read_requests(spark, str(tmp_path))), str(tmp_path / "counts"), "complete")
    assert sum(r.n for r in counts.collect()) == len(rows)


def test_late_requests_of_later_files_are_decided(spark, tmp_path):
    at = lambda s: NOON + dt.timedelta(seconds=s)
    first = [("a", at(0), "POST", "/query", "c", None), ("b", at(86_400 * 3), "POST", "/query", "c", None)]
    late = [("d", at(10), "POST", "/query", "c", None), ("e", at(20), "POST", "/query", "c", None), ("f", at(86_400 * 3 + 1), "POST", "/query", "c", None)]
    folder = tmp_path / "requests.parquet"
    spark.createDataFrame(first, REQUEST).coalesce(1).write.parquet(str(folder))
    stream = lambda: streams.limited_stream(streams.read_requests(spark, str(tmp_path)), (("query", "/query", 2, 60),))
    assert streams.collected(stream(), str(tmp_path / "work")).count() == 2
    spark.createDataFrame(late, REQUEST).coalesce(1).write.mode("append").parquet(str(folder))
    got = {r.request_id: r.accepted for r in streams.collected(stream(), str(tmp_path / "work")).collect()}
    assert set(got) == set("abdef") and got["f"]


def test_counters_of_the_pipeline(spark):
    rows = [(f"r{i}", NOON + dt.timedelta(seconds=i), "POST", "/query", "a", None) for i in range(4)] + [("g", NOON, "GET", "/query", None, None), (None, NOON, "GET", "/x", None, None)]
    df = spark.createDataFrame([*rows, rows[0]], REQUEST)
    got = sorted((r.name, r.labels, r.value) for r in guard.request_counters(df, (("query", "/query", 3, 60),)).collect())
    assert got == [
        ("http_requests_total", 'method="GET",path="/query",status_code="200"', 1.0), ("http_requests_total", 'method="POST",path="/query",status_code="200"', 3.0),
        ("http_requests_total", 'method="POST",path="/query",status_code="429"', 1.0), ("rate_limit_rejections_total", 'path="/query",policy="query"', 1.0),
    ]


def test_histograms_come_after_counters_in_order(spark):
    df = spark.createDataFrame([("b", v) for v in (1.0, 2.0, 2.5)] + [("a", 20_000_000.5), ("a", None)], "k string, v double")
    told = guard.histograms(df, ["k"], "v", "ms").unionByName(guard.counters(df, ["k"], "zeta"), allowMissingColumns=True)
    assert [r.line for r in guard.exposition(told, "q").collect()] == [
        'q_zeta{k="a"} 2', 'q_zeta{k="b"} 3', 'q_ms_count{k="a"} 1', 'q_ms_sum{k="a"} 20000000.5', 'q_ms_avg{k="a"} 20000000.5', 'q_ms_p95{k="a"} 20000000.5',
        'q_ms_count{k="b"} 3', 'q_ms_sum{k="b"} 5.5', 'q_ms_avg{k="b"} 1.8333333333333333', 'q_ms_p95{k="b"} 2.5',
    ]


def test_client_key_and_exposition(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "h"), ("", "h"), (None, None)], "f string, h string")
    assert [r[0] for r in df.select(guard.client_key(F.col("f"), F.col("h"))).collect()] == ["1.1.1.1", "h", "unknown"]
    m = spark.createDataFrame([("n", 'a="1"', 2.0), ("m", "", 0.5)], "name string, labels string, value double")
    assert sorted(r.line for r in guard.exposition(m).collect()) == ["quarry_m 0.5", 'quarry_n{a="1"} 2']
