import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quarry.llm.pack import pack, pack_sizes
from quarry.llm.tokens import n_tokens


def least_bins(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        for choice in itertools.product(range(n), repeat=len(sizes)):
            room = [capacity] * n
            for s, b in zip(sizes, choice):
                room[b] -= s
            if min(room) >= 0:
                return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=6))
def test_small_instances_against_all_packings(sizes):
    bins = pack_sizes(sizes, 10)
    for b in set(bins):
        assert sum(s for s, x in zip(sizes, bins) if x == b) <= 10
    assert len(set(bins)) <= least_bins(sizes, 10) + (len(sizes) > 5)


def test_large_instance_is_nearly_full():
    random.seed(3)
    sizes = [random.randint(1, 512) for _ in range(3000)]
    assert len(set(pack_sizes(sizes, 512))) <= -(-sum(sizes) // 512) * 1.03


def test_contexts(spark):
    random.seed(4)
    sizes = {i: random.choice([3, 40, 100, 250, 511, 512, 513, 1300, 5000]) for i in range(500)} | {900: 0, 901: None}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "doc_id long, n_tokens long, size int")
    rows = pack(df, [("small", 512, 0), ("large", 2048, 64)], shard_items=60).collect()
    for name, capacity, overlap in (("small", 512, 0), ("large", 2048, 64)):
        mine = [r for r in rows if r.limit_name == name]
        used = {}
        for r in mine:
            used[r.context_id] = used.get(r.context_id, 0) + r["size"]
        assert max(used.values()) <= capacity and all(used[r.context_id] == r.used for r in mine)
        for doc, n in sizes.items():
            parts = sorted((r for r in mine if r.doc_id == doc), key=lambda r: r.piece_no)
            if not n:
                assert not parts
                continue
            assert len(parts) == 1 if n <= capacity else all(p["size"] == capacity for p in parts[:-1])
            at = 0
            for p in parts:
                assert p.start_token == max(0, at - overlap * (p.piece_no > 0))
                at = p.start_token + p["size"]
            assert at == n
        assert sum(used.values()) / (len(used) * capacity) > 0.9
    assert pack(df.limit(0), [("small", 512, 0)]).count() == 0


def test_tokens_are_counted_once(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    used = docs.withColumn("n_tokens", n_tokens(F.col("text"))).where(F.col("n_tokens") > 0).select("doc_id", F.col("n_tokens") + 1)
    assert used._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
