import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import quantiles


def exact(values, q):
    values = sorted(values)
    return values[int(q * (len(values) - 1))]


def test_error_bound_and_merging(spark):
    random.seed(2)
    days = [dt.date(2025, 1, d) for d in (1, 2, 3)]
    data = [("hot" if random.random() < 0.7 else f"g{random.randrange(3)}", random.choice(days), random.choice([-1, 1, 1, 1]) * random.lognormvariate(3, 2)) for _ in range(6000)]
    data += [("hot", days[0], 0.0), ("hot", days[0], None), ("hot", days[0], float("nan")), ("hot", days[0], float("inf")), (None, None, 5.0)]
    df = spark.createDataFrame(data, "k string, d date, v double")
    wanted = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    parts = [quantiles.sketch(df.where(F.col("d") == d), F.col("v"), {"k": F.col("k"), "d": F.col("d")}) for d in days]
    parts.append(quantiles.sketch(df.where("d is null"), F.col("v"), {"k": F.col("k"), "d": F.col("d")}))
    got = {r.k: r for r in quantiles.percentiles(quantiles.merge(parts, ["k"]), ["k"], wanted).collect()}
    direct = {r.k: r for r in quantiles.percentiles(quantiles.sketch(df, F.col("v"), {"k": F.col("k")}), ["k"], wanted).collect()}
    assert got == direct
    for key, row in got.items():
        values = [v for k, _, v in data if k == key and v is not None and abs(v) < float("inf")]
        assert row.n == len(values)
        for name, q in wanted.items():
            assert row[name] == pytest.approx(exact(values, q), rel=0.01, abs=0)


def test_small_and_large_values_keep_their_relative_error(spark):
    random.seed(3)
    for low, high in ((-20, -12), (-300, -290), (300, 308)):
        values = [10 ** random.uniform(low, high) for _ in range(500)]
        df = spark.createDataFrame([(v,) for v in values] + [(0.0,)], "v double")
        row = quantiles.percentiles(quantiles.sketch(df, F.col("v"), {}), [], {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}).first()
        assert row.n == 501 and row.p0 == 0
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)):
            assert row[name] == pytest.approx(exact([0.0, *values], q), rel=0.01, abs=0)


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "k string, v bigint")
    assert quantiles.percentiles(quantiles.sketch(df, F.col("v"), {"k": F.col("k")}), ["k"], {"p50": 0.5}).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketch(df, F.col("v"), {}, accuracy=1.5)
