"""Problem 6: texts packed into contexts of fixed capacity with little space unused.

Bin packing by Martello and Toth's dominance reduction. Documents are spread over shards of a bounded number of
items, each shard is reduced (a set of items that provably is in some best packing is fixed and removed) and
its remainder placed by best fit, largest first. Contexts that a shard leaves too empty are opened again and
their items packed together with those of other shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.lineage import cut_lineage

#: Items of one task of the packing, and the share of a context that must be full after the first round.
SHARD_ITEMS = 4096
FULL_ENOUGH = 0.97


def _largest(sizes: list[int], most: int, but: int) -> int:
    """Index of the largest element up to ``most`` other than index ``but``; -1 if none."""
    k = bisect_right(sizes, most) - 1
    return k - 1 if k == but else k


def _best_pair(sizes: list[int], gap: int, but: int) -> int:
    """Largest sum, up to ``gap``, of two elements other than index ``but``; 0 if none."""
    i, j, best = 0, bisect_right(sizes, gap) - 1, 0
    while i < j:
        if i == but:
            i += 1
        elif j == but:
            j -= 1
        else:
            total = sizes[i] + sizes[j]
            if total <= gap:
                best, i = max(best, total), i + 1
            else:
                j -= 1
    return best


def _dominating(sizes: list[int], p: int, capacity: int) -> list[int] | None:
    """Indices of a set with item ``p`` that dominates every feasible set with it, or None if none is proven."""
    gap = capacity - sizes[p]
    others = [sizes[i] for i in range(min(4, len(sizes))) if i != p][:3]
    if not others or others[0] > gap:
        return [p]
    k = _largest(sizes, gap, p)
    if sizes[k] == gap or len(others) < 2 or others[0] + others[1] > gap:
        return [p, k]
    if len(others) < 3 or sum(others) > gap:  # two more at most
        if _best_pair(sizes, gap, p) <= sizes[k]:
            return [p, k]
        left = gap - sizes[k]
        b = bisect_right(sizes, left) - 1
        while b >= 0 and b in (p, k):
            b -= 1
        half = _largest(sizes, gap // 2, p)
        if b >= 0 and (half in (-1, b, k) or sizes[half] <= sizes[b]):
            return [p, k, b]
    return None


def pack_sizes(items: list[int], capacity: int) -> list[int]:
    """A bin number for each item, none of which may exceed ``capacity``."""
    if any(not 0 < s <= capacity for s in items):
        raise ValueError("every item must be of size 1 to capacity")
    of_size: dict[int, list[int]] = {}
    for i in range(len(items) - 1, -1, -1):
        of_size.setdefault(items[i], []).append(i)
    sizes, bins, n = sorted(items), [0] * len(items), 0
    progress = True
    while progress and sizes:
        progress, p = False, len(sizes) - 1
        while p >= 0:
            fixed = _dominating(sizes, p, capacity)
            if fixed is None:
                p -= 1
                continue
            for i in sorted(fixed, reverse=True):
                bins[of_size[sizes.pop(i)].pop()] = n
            n, progress = n + 1, True
            p = min(p, len(sizes)) - 1
    room: list[tuple[int, int]] = []
    for size in reversed(sizes):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b, n = capacity, n, n + 1
        bins[of_size[size].pop()] = b
        insort(room, (left - size, b))
    return bins


def _place(parts: DataFrame, stage: int) -> DataFrame:
    schema = parts.drop("used", "context_id").schema

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece_no"], kind="stable")
        name, shard, capacity = pdf["limit_name"].iloc[0], int(pdf["shard"].iloc[0]), int(pdf["capacity"].iloc[0])
        bins = np.asarray(pack_sizes(pdf["size"].tolist(), capacity), dtype="int64")
        used = np.bincount(bins, weights=pdf["size"].to_numpy()).astype("int64")
        return pdf.assign(used=used[bins], context_id=[f"{name}:{stage}:{shard}:{b}" for b in bins])

    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, used bigint, context_id string"
    return parts.drop("used", "context_id").groupBy("limit_name", "shard").applyInPandas(place, out)


def pack(
    sizes: DataFrame, limits: list[tuple[str, int, int]], shard_items: int = SHARD_ITEMS, full_enough: float = FULL_ENOUGH
) -> DataFrame:
    """Contexts for documents ``doc_id, n_tokens`` under each limit ``(name, capacity, overlap)``.

    One row per document or piece: ``limit_name, capacity, context_id, doc_id, piece_no, start_token, size,
    used``, where ``used`` is what the whole context holds. A document is split only if it alone exceeds the
    capacity: into pieces of exactly the capacity, each but the first beginning ``overlap`` tokens before the
    end of the one before, and a last, shorter piece, which is packed like a document. Documents of null or 0
    tokens are in no context. Rows of equal ``doc_id`` are packed as so many documents.

    A shard holds about ``shard_items`` rows of two numbers, whatever the input, and is one task of the packing.
    """
    if any(not 0 <= overlap < capacity for _, capacity, overlap in limits):
        raise ValueError("an overlap must be at least 0 and below its capacity")
    choices = F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity"), F.lit(o).cast("long").alias("overlap")) for n, c, o in limits])
    step = F.col("capacity") - F.col("overlap")
    n_pieces = F.when(F.col("n_tokens") <= F.col("capacity"), F.lit(1)).otherwise(F.ceil((F.col("n_tokens") - F.col("overlap")) / step).cast("int"))
    parts = (
        sizes.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
        .where(F.col("n_tokens") > 0)
        .select("*", F.inline(choices))
        .select("*", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece_no"))
        .withColumn("start_token", F.col("piece_no") * step)
        .withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("start_token")))
        .select("limit_name", "capacity", "doc_id", "piece_no", "start_token", "size")
    )
    parts = cut_lineage(parts)
    is_full = F.col("size") == F.col("capacity")
    full = parts.where(is_full).withColumns(
        {"used": F.col("size"), "context_id": F.format_string("%s:0:%s:%s", "limit_name", F.col("doc_id").cast("string"), "piece_no")}
    )

    def sharded(df: DataFrame, seed: int) -> DataFrame:
        most = df.groupBy("limit_name").count().agg(F.max("count")).first()[0] or 0
        shards = max(1, -(-most // shard_items))
        return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece_no"), F.lit(shards)))

    first = cut_lineage(_place(sharded(parts.where(~is_full), 1), 1))
    enough = F.col("used") >= F.col("capacity") * full_enough
    second = _place(sharded(first.where(~enough).drop("shard"), 2), 2)
    columns = ["limit_name", "capacity", "context_id", "doc_id", "piece_no", "start_token", "size", "used"]
    return full.select(columns).unionByName(first.where(enough).select(columns)).unionByName(second.select(columns))
