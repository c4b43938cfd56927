"""Request limits over sliding windows, request counters and latency histograms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Policy name, path, accepted requests and seconds of the window.
POLICIES = (("query", "/query", 180, 60), ("index", "/repos/index", 20, 600), ("eval", "/evals/run", 20, 600))


def client_key(forwarded, host):
    """The first hop of a forwarded-for header, else the host, else ``unknown``."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.when(first != "", first), F.when(host != "", host), F.lit("unknown"))


def matched(requests: DataFrame, policies=POLICIES) -> DataFrame:
    """Distinct POST requests with their policy: ``request_id, policy, client, at`` (microseconds), ``most, window``.

    Requests on other paths or of null id or time don't come out; a null client counts as ``unknown``.
    """
    policy = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(p).alias("p"), F.lit(m).alias("most"), F.lit(w * 1_000_000).cast("long").alias("window")) for n, p, m, w in policies])
    found = F.get(F.filter(policy, lambda x: x["p"] == F.col("path")), F.lit(0))
    return (
        requests.where((F.col("method") == "POST") & F.col("request_id").isNotNull() & F.col("ts").isNotNull())
        .dropDuplicates(["request_id"])
        .withColumn("__p", found)
        .where(F.col("__p").isNotNull())
        .select("request_id", "__p.policy", F.coalesce("client", F.lit("unknown")).alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "__p.most", "__p.window")
    )


def decide(log: deque, at: int, most: int, window: int) -> tuple[bool, int, int]:
    """Whether a request at ``at`` is accepted, how many remain, and the seconds to wait; accepted ones enter the log."""
    while log and log[0] <= at - window:
        log.popleft()
    if len(log) >= most:
        wait = window - (at - log[0])
        return False, 0, max(1, -(-wait // 1_000_000))
    log.append(at)
    return True, most - len(log), 0


def limited(requests: DataFrame, policies=POLICIES) -> DataFrame:
    """``request_id, policy, client, accepted, remaining, retry_after`` of every request under a policy, by event time.

    A log of accepted times decides, so requests depend on those before them. The dependence ends where a client
    pauses for a whole window: runs between pauses are found from counts per client and window-long bucket of
    time, and decided independently, in time order, with a log no longer than the limit. A hot client so
    spreads over as many tasks as it has runs. Requests of the same time go by id.
    """
    rows = matched(requests, policies).withColumn("bucket", F.floor(F.col("at") / F.col("window")))
    key = ["policy", "client"]
    spans = rows.groupBy(*key, "bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("window").alias("w"))
    by_key = Window.partitionBy(*key).orderBy("bucket")
    starts = F.coalesce((F.lag("hi").over(by_key) <= F.col("lo") - F.col("w")).cast("long"), F.lit(1))
    runs = spans.withColumn("s", starts).select(*key, "bucket", F.sum("s").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    placed = rows.join(runs, [*key, "bucket"]).repartition(*key, "run").sortWithinPartitions(*key, "run", "at", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for pdf in batches:
            decided = []
            for *group, at, most, window in zip(*(pdf[c].tolist() for c in ("policy", "client", "run", "at", "most", "window"))):
                if group != current:
                    current, log = group, deque()
                decided.append(decide(log, at, most, window))
            made = pd.DataFrame(decided, columns=["accepted", "remaining", "retry_after"])
            yield pd.concat([pdf[["request_id", "policy", "client"]].reset_index(drop=True), made], axis=1)

    return placed.select("request_id", *key, "run", "at", "most", "window").mapInPandas(
        run, "request_id string, policy string, client string, accepted boolean, remaining bigint, retry_after bigint"
    )


def _said(labels: list[str]) -> Column:
    return F.array_join(F.array(*[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in sorted(labels)]), ",")


def counters(events: DataFrame, labels: list[str], name: str) -> DataFrame:
    """``name, labels, value``: events per combination of label columns, labels as sorted ``key="value"`` text."""
    return events.groupBy(_said(labels).alias("labels")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("name"), "labels", "value")


def request_counters(requests: DataFrame, policies=POLICIES, limits=None) -> DataFrame:
    """``name, labels, value`` of the request pipeline: every distinct request by method, path and status, and rejections.

    A request that its limit rejects has status 429, any other 200. ``limits`` are decisions of ``limited`` if there
    are any yet.
    """
    decided = (limited(requests, policies) if limits is None else limits).select("request_id", "policy", "accepted")
    seen = requests.where(F.col("request_id").isNotNull()).dropDuplicates(["request_id"]).join(decided, "request_id", "left")
    told = seen.withColumn("status_code", F.when(~F.col("accepted"), "429").otherwise("200"))
    return counters(told, ["method", "path", "status_code"], "http_requests_total").unionByName(
        counters(told.where(F.col("status_code") == "429"), ["path", "policy"], "rate_limit_rejections_total")
    )


def histograms(events: DataFrame, labels: list[str], value: str, name: str) -> DataFrame:
    """``name, labels, nth, value``: count, sum, mean and nearest-rank 95th percentile of ``value`` per combination of labels.

    The four lines of a histogram are told apart by ``nth``. Null values are left out; equal ones are counted before they meet.
    """
    counts = events.where(F.col(value).isNotNull()).groupBy(_said(labels).alias("labels"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("labels").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("labels", "v", "c", upto.alias("upto"), F.sum("c").over(Window.partitionBy("labels")).alias("n"))
    index = F.bround(0.95 * (F.col("n") - 1)).cast("long")
    one = placed.groupBy("labels").agg(
        F.max("n").cast("double").alias("count"), F.sum(F.col("v") * F.col("c")).alias("sum"), F.min(F.when(F.col("upto") > index, F.col("v"))).alias("p95")
    )
    values = F.array(F.col("count"), F.col("sum"), F.col("sum") / F.col("count"), F.col("p95"))
    names = F.array(*[F.lit(f"{name}_{x}") for x in ("count", "sum", "avg", "p95")])
    return one.select("labels", F.posexplode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("nth", "m")).select("m.name", "labels", "nth", "m.value")


def exposition(metrics: DataFrame, namespace: str = "quarry") -> DataFrame:
    """``line``: the text form of metrics ``name, labels, value``.

    Counters come first, by name and labels, then histograms, which have a column ``nth``, by name and labels with
    their lines in order.
    """
    if "nth" in metrics.columns:
        stem = F.when(F.col("nth").isNotNull(), F.regexp_replace("name", "_[^_]+$", "")).otherwise(F.col("name"))
        metrics = metrics.orderBy(F.col("nth").isNotNull(), stem, "labels", "nth")
    else:
        metrics = metrics.orderBy("name", "labels")
    shown = F.when(F.col("labels") == "", F.lit("")).otherwise(F.concat(F.lit("{"), F.col("labels"), F.lit("}")))
    plain = F.regexp_replace(F.col("value").cast("decimal(38,9)").cast("string"), "0+$", "")  # large doubles would be written with an exponent
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).when(F.abs("value") >= 1e7, plain).otherwise(F.col("value").cast("string"))
    return metrics.select(F.concat(F.lit(namespace + "_"), F.col("name"), shown, F.lit(" "), number).alias("line"))
