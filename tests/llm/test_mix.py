import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mix
from quarry.llm.tokens import encoding, n_tokens


def test_chances_are_those_of_a_poisson_number():
    for rate in (0.01, 1.7, 40.0, 2500.0):
        most = int(rate * 3) + 5
        p = mix.chances(rate, most)
        assert list(p) == sorted(p) and sum(1 - x for x in p) == pytest.approx(rate, rel=1e-3)
    assert list(mix.chances(0, 2)) == [1, 1] and len(mix.chances(1, 0)) == 0


def test_the_mean_is_solved_for_real_tokens():
    random.seed(1)
    for n, most in ((40, 3), (3000, 1), (3000, 5), (200, 1200)):
        levels = np.unique([random.randrange(mix.LEVELS) for _ in range(n)])
        tokens = np.array([int(random.paretovariate(1.1) * 20) for _ in levels], dtype="float64")
        for wanted in (0.1, 0.7 * most):
            turn, steps = mix.solved(levels, tokens, wanted * tokens.sum(), most)
            numbers = ((levels + turn * (mix.LEVELS // mix.TURNS)) % mix.LEVELS + 0.5) / mix.LEVELS
            given = sum(t * sum(s < u for s in steps) for t, u in zip(tokens, numbers))
            assert given == pytest.approx(wanted * tokens.sum(), rel=0.02)
    assert mix.solved(levels, tokens, 0, 3) == (0, [1.0] * 3) and mix.solved(levels, tokens, 1e12, 3) == (0, [0.0] * 3)
    assert mix.solved(levels[:0], tokens[:0], 5, 1) == (0, [1.0]) and mix.solved(levels, tokens, 5, 0) == (0, [])


def test_shares_caps_and_order(spark):
    random.seed(5)
    data = [(i, "hot" if i % 3 == 0 else random.choice(["a", "b", "rare"] if i % 40 == 1 else ["a", "b"]), f"text {i // 2 if i < 200 else i}", random.randint(20, 80)) for i in range(4000)]
    data += [(9000, None, "x", 5), (9001, "none", "y", 5), (9002, "a", "", 0), (9003, "a", None, 0)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, n_tokens long")
    targets = spark.createDataFrame([("hot", 0.3, 2), ("a", 0.4, 1), ("b", 0.25, 3), ("rare", 0.05, 4), ("gone", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    unique = mix.unique_texts(docs)
    assert unique.count() == len({t for _, _, t, n in data if n})
    planned = mix.plan(unique, targets)
    mixed = mix.mix(unique, planned).cache()
    report = {r.source: r for r in mix.shares(mixed, planned).collect()}
    assert set(report) == {"hot", "a", "b", "rare", "gone"}
    for name, share, most in (("hot", 0.3, 2), ("a", 0.4, 1), ("b", 0.25, 3), ("rare", 0.05, 4)):
        assert report[name].most_repeats <= most and report[name].actual_share == pytest.approx(share, rel=0.02)
    times = mixed.join(docs, "doc_id").groupBy("text").count().agg(F.max("count")).first()[0]
    assert times <= 4
    records = mix.shuffled(mixed, docs).select("position_key", "text").collect()
    assert [r.position_key for r in records] == sorted(r.position_key for r in records) and all(r.text for r in records)
    assert mix.mix(unique, planned).collect() == mixed.collect() or sorted(mix.mix(unique, planned).collect()) == sorted(mixed.collect())
    assert mix.shares(mix.mix(unique.limit(0), mix.plan(unique.limit(0), targets)), planned).agg(F.sum("tokens")).first()[0] == 0


def test_a_copy_in_an_untargeted_source_takes_no_text(spark):
    data = [(1, None, "x", 5), (2, "none", "y", 6), (3, "zero", "z", 7), (4, "b", "x", 5), (5, "a", "x", 5), (6, "a", "y", 6), (7, "a", "z", 7), (8, "none", "w", 9)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 2), ("zero", 0.0, 1), ("none", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    unique = mix.unique_texts(docs, targets)
    assert sorted((r.doc_id, r.source) for r in unique.collect()) == [(4, "b"), (6, "a"), (7, "a")]
    assert {r.source: r.available for r in mix.plan(unique, targets).collect()} == {"a": 13, "b": 5, "zero": 0, "none": 0}


def test_tokens(spark):
    texts = ["Hello world, it's 42!", "", None, "naïve 😀 " * 50]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(n_tokens(F.col("t"))).collect()
    encode = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    assert [r[0] for r in got] == [len(encode(t)) if t else 0 for t in texts]
