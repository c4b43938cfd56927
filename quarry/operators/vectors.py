"""Hashing embeddings, cached embeddings and cosine search."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ids import DIMENSIONS, placed
from quarry.functions.text import RAW_TOKEN
from quarry.operators.tokens import best_places
from quarry.plans.lineage import cut_lineage


_RAW = re.compile(RAW_TOKEN)


def embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Sparse signed feature hashing of a text: arrays ``ix`` and ``v`` of integer sums, by bucket; without empty buckets.

    Null texts and texts without tokens have none. Hashed in Arrow batches, as ``tokens.terms``.
    """

    @F.pandas_udf("ix array<int>, v array<bigint>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                sums: dict[int, int] = {}
                for token, n in Counter(_RAW.findall(t.lower())).items() if t else ():
                    ix, sign = placed(token, dimensions)
                    sums[ix] = sums.get(ix, 0) + n * sign
                out.append({ix: v for ix, v in sorted(sums.items()) if v})
            yield pd.DataFrame({"ix": [list(s) for s in out], "v": [list(s.values()) for s in out]})

    return hashed.asNondeterministic()(text)


def hash_embedding(df: DataFrame, keys: Sequence[str], text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``keys..., ix, v``: the ``embedding`` of each row, which ``keys`` identify. Rows without tokens have no rows."""
    made = df.select(*keys, embedding(F.col(text), dimensions).alias("__vector"))
    return made.select(*keys, F.inline(F.arrays_zip("__vector.ix", "__vector.v")))


def cosines(documents: pd.DataFrame, queries: pd.DataFrame, most: int, dimensions: int = DIMENSIONS) -> pd.DataFrame:
    """``q, seq, score``: the ``most`` documents of highest cosine for each query; ties go to the smaller ``seq``.

    ``documents`` has ``seq, ix, v``, ``queries`` has ``q, ix, v``, both of one block, with arrays of buckets and
    integer sums. Every document is ranked: without a shared bucket its score is 0, above negative ones. Integer
    products make scores independent of the order of summation. One matrix product per 64 queries: pairs of query
    and document are never spelt out.
    """
    if documents.empty or queries.empty:
        return pd.DataFrame({"q": [], "seq": [], "score": []})

    def dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.zeros((len(rows), dimensions))
        sizes = rows["ix"].map(len).to_numpy()
        if sizes.sum():
            matrix[np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows["ix"].to_numpy()).astype("int64")] = np.concatenate(rows["v"].to_numpy())
        return matrix, np.sqrt((matrix * matrix).sum(axis=1))

    documents = documents.sort_values("seq")
    (a, long_a), (b, long_b) = dense(documents), dense(queries)
    seqs, out = documents["seq"].to_numpy(), []
    for begin in range(0, len(b), 64):
        dots = b[begin : begin + 64] @ a.T
        sizes = long_a[None, :] * long_b[begin : begin + 64, None]
        for q, row in zip(queries["q"].iloc[begin : begin + 64], np.divide(dots, sizes, out=np.zeros_like(dots), where=sizes > 0)):
            found = best_places(row, most)
            out.append((q, seqs[found], row[found]))
    return pd.DataFrame({"q": np.repeat([q for q, _, _ in out], [len(s) for _, s, _ in out]), "seq": np.concatenate([s for _, s, _ in out]), "score": np.concatenate([r for _, _, r in out])})


def missing_from_cache(chunks: DataFrame, cache: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """Each hash of ``chunks`` without a cached vector, once, with its text. Null hashes are left out."""
    return chunks.where(F.col(key).isNotNull()).dropDuplicates([key]).join(cache, key, "left_anti")


def known_vectors(cache: DataFrame, new: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """``key, vector``: the cached vectors and those newly made whose key the cache lacks, each key once."""
    made = new.select(key, "vector").dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    return cache.select(key, "vector").dropDuplicates([key]).unionByName(made)


def with_vectors(chunks: DataFrame, cache: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """``chunks`` with the column ``vector`` of ``cache``, null where there is none."""
    return chunks.join(cache.select(key, "vector"), key, "left")


def embed_with(df: DataFrame, key: str, text: str, make_provider, batch: int = 256) -> DataFrame:
    """``key, vector`` by a provider with ``embed_documents(list of texts)``, made once per task from a factory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "vector": [list(map(float, v)) for v in provider.embed_documents(part[text].fillna("").tolist())]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<float>")


def _units(rows: pd.Series) -> np.ndarray:
    matrix = np.vstack(rows.to_numpy()).astype("float64")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1, lengths)


def _centers(sample: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """Unit centers of a sample of unit vectors, by a few rounds of spherical k-means from evenly spaced members."""
    centers = sample[:: max(1, len(sample) // most)][:most]
    for _ in range(rounds):
        mine = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, mine, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(lengths > 0, sums / np.where(lengths == 0, 1, lengths), centers)
    return centers


def nearest(
    vectors: DataFrame, queries: DataFrame, most: int, vector: str = "embedding", key: str = "vec_id",
    shard_rows: int = 20_000, block_rows: int = 1_000, centers: int = 64, sample_rows: int = 4_096,
) -> DataFrame:
    """``query_id, key, score, rank``: for each query the ``most`` vectors of highest cosine, itself excluded; exact.

    Vectors lie in the cells of ``centers`` centers, which are fitted on a sample of at most ``sample_rows`` vectors.
    A query searches its own cell first. Of the other cells it visits those that may hold something as good as
    what it found: by the triangle inequality no vector of a cell is nearer than the center less the cell's radius.
    Cells are cut into shards and queries into blocks of bounded size; each pair is one matrix product in one task
    and sends only its best rows on. Null vectors are left out, zero vectors have cosine 0, ties go to the smaller key.
    """
    usable, asked = vectors.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    kind = vectors.schema[key].dataType.simpleString()
    rows = usable.select(vector).orderBy(F.xxhash64(key)).limit(sample_rows).toPandas()
    sample = _units(rows[vector]) if len(rows) else np.zeros((0, 1))
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    fitted = _centers(sample, centers) if len(sample) else np.zeros((0, 1))
    n_cells = len(fitted) + 1  # the last cell is that of zero vectors

    def angles(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        units = _units(pdf["x"])
        cosine = units @ fitted.T if len(fitted) else np.zeros((len(pdf), 0))
        return units, np.arccos(np.clip(cosine, -1, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units, angle = angles(pdf)
                zero = ~units.any(axis=1)
                cell = np.where(zero, n_cells - 1, angle.argmin(axis=1) if angle.shape[1] else 0)
                yield pdf.assign(cell=cell, angle=np.where(zero, 0.0, angle.min(axis=1, initial=np.pi)))

    placed = cut_lineage(usable.select(F.col(key).alias("k"), F.col(vector).alias("x")).mapInPandas(place, f"k {kind}, x {vectors.schema[vector].dataType.simpleString()}, cell int, angle double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # one row a cell
    radius, shards = np.full(n_cells, -1.0), [1] * n_cells
    for c in cells:
        radius[c.cell], shards[c.cell] = c.radius, -(-c.n // shard_rows)
    blocks = max(1, -(-asked.count() // block_rows))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units, angle = angles(pdf)
                best = np.zeros((len(pdf), n_cells))
                best[:, :-1] = np.cos(np.maximum(0, angle - radius[:-1]))
                zero = ~units.any(axis=1)
                best[zero] = 0
                best[:, radius < 0] = -2  # empty cells
                yield pdf.assign(home=best.argmax(axis=1), bounds=list(best))

    seek = asked.select(F.col(key).alias("query_id"), F.col(vector).alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    seek = cut_lineage(seek.mapInPandas(bound, f"query_id {kind}, x {vectors.schema[vector].dataType.simpleString()}, block int, home int, bounds array<double>"))
    n_shards = F.get(F.array(*map(F.lit, shards)), F.col("cell"))
    data = placed.select("k", "x", "cell", F.pmod(F.xxhash64("k"), n_shards).alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "k": [], "score": []})
        left = left.sort_values("k")
        ids, out = left["k"].to_numpy(), []
        for row, q in zip(np.round(_units(right["x"]) @ _units(left["x"]).T, 9), right["query_id"].to_numpy()):
            row = np.where(ids == q, -np.inf, row)
            top = best_places(row, most)
            out.append(pd.DataFrame({"query_id": q, "k": ids[top], "score": row[top]}))
        found = pd.concat(out)
        return found[np.isfinite(found["score"])]

    def searched(visits: DataFrame) -> DataFrame:
        pairs = visits.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), n_shards.cast("long") - 1)))
        group = ["cell", "shard", "block"]
        return data.groupBy(*group).cogroup(pairs.groupBy(*group)).applyInPandas(best, f"query_id {kind}, k {kind}, score double")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "k")
    at_home = cut_lineage(searched(seek.select("query_id", "x", "block", F.col("home").alias("cell"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))
    worst = at_home.where(F.col("rank") == most).select("query_id", F.col("score").alias("worst"))
    elsewhere = (
        seek.join(worst, "query_id", "left").select("*", F.posexplode("bounds").alias("cell", "bound"))
        .where((F.col("cell") != F.col("home")) & (F.col("bound") > -2) & (F.col("bound") >= F.coalesce("worst", F.lit(-2.0)) - 1e-7))
    )
    pairs = at_home.drop("rank").unionByName(searched(elsewhere.select("query_id", "x", "block", "cell")))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumnRenamed("k", key)
