"""Request streams: limits with state per client, counters, and incremental embedding."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.guard import POLICIES, decide


COLUMNS = ["request_id", "policy", "client", "accepted", "remaining", "retry_after"]


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table as a stream of its files."""
    path = f"{sf_dir}/requests.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def limited_stream(requests: DataFrame, policies=POLICIES, delay: str = "30 days") -> DataFrame:
    """``request_id, policy, client, accepted, remaining, retry_after`` per request, with a log of accepted times per policy and client as state.

    Requests of one micro-batch are taken in time order, later batches as they arrive; ``delay`` covers the known
    lateness, so that none is dropped, however the requests lie in files. The state is no longer than a limit and
    expires when a client pauses for ``delay`` and a window. Repeated ids are dropped within the watermark. Of a
    client's requests in a batch only ids and times are held, so the size of batches bounds the memory.
    """
    policy = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(p).alias("p"), F.lit(m).alias("most"), F.lit(w * 1_000_000).cast("long").alias("window")) for n, p, m, w in policies])
    found = F.get(F.filter(policy, lambda x: x["p"] == F.col("path")), F.lit(0))
    rows = (
        requests.where((F.col("method") == "POST") & F.col("request_id").isNotNull() & F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["request_id"])
        .withColumn("__p", found)
        .where(F.col("__p").isNotNull())
        .select("request_id", "ts", "__p.policy", F.coalesce("client", F.lit("unknown")).alias("client"), F.unix_micros("ts").alias("at"))
    )
    limits = {n: (m, w * 1_000_000) for n, _, m, w in policies}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        most, window = limits[key[0]]
        log = deque(state.get[0]) if state.exists else deque()
        asked = sorted((at, name) for pdf in batches for at, name in zip(pdf["at"].tolist(), pdf["request_id"].tolist()))
        decided = []
        for at, _ in asked:
            late = bool(log) and log[-1] > at
            decided.append(decide(log, at, most, window))
            if late:
                log = deque(sorted(log))
        state.update((list(log),))
        if log:
            state.setTimeoutTimestamp(max((log[-1] + window) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(name, *key, *d) for (_, name), d in zip(asked, decided)], columns=COLUMNS)

    return rows.groupBy("policy", "client").applyInPandasWithState(
        step, "request_id string, policy string, client string, accepted boolean, remaining bigint, retry_after bigint", "log array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def counted_stream(requests: DataFrame) -> DataFrame:
    """Running counts per method and path, for output mode complete or update."""
    return requests.groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))


def windowed_stream(requests: DataFrame, delay: str = "2 days", width: str = "1 day") -> DataFrame:
    """Counts per path and tumbling window; requests later than the watermark are left out."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "path").agg(F.count(F.lit(1)).alias("n")).select("w.start", "path", "n")


def collected(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all data there is now, by way of files in ``folder``.

    In complete mode each batch replaces the result.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces what it had written
        batch.write.mode("overwrite").parquet(f"{folder}/out" + ("" if mode == "complete" else f"/batch={number}"))

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
