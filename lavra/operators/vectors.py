"""Vectors: exact cosine search of a stated set of queries against all rows, unit vectors, and encoding of misses only.

Defined results: null, empty and zero vectors, and those of another dimension than the query's, have no distance;
equal distances (to twelve decimals) rank by id; an empty query set or table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lavra.session import cut

#: Query vectors that are broadcast at once, as one matrix; more are searched in several passes over the rows.
QUERY_BLOCK = 20_000
#: Cells of the matrix of distances that a task holds at a time.
CELLS = 4_000_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector scaled to length one; null where it is null, empty, zero or not finite."""
    length = F.sqrt(dot(vector, vector))
    good = (length > 0) & (length < float("inf"))
    return F.when(good, F.transform(vector, lambda x: x.cast("double") / length))


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of equal dimension and where they stand; vectors without length or of another dimension than the most are left out."""
    sizes = [0 if v is None else len(v) for v in vectors]
    size = max(set(sizes), key=sizes.count, default=0)
    at = np.array([k for k, n in enumerate(sizes) if n == size and n], dtype=int)
    if not len(at):
        return np.zeros((0, 0)), at
    rows = np.array([vectors[k] for k in at], dtype=float)
    norms = np.linalg.norm(rows, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return rows[good] / norms[good, None], at[good]


def _searcher(shared, k: int, same: str | None):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, labels = shared.value
        for batch in batches:
            out: list[tuple] = []
            groups = batch.groupby(same, sort=False) if same else [(None, batch)]
            for label, rows in groups:
                mine = np.arange(len(ids)) if same is None else np.flatnonzero(labels == label)
                vectors, at = _matrix(rows["embedding"].tolist())
                if not len(mine) or not len(at) or vectors.shape[1] != matrix.shape[1]:
                    continue
                vec_ids = rows["vec_id"].to_numpy()[at]
                step = max(1, CELLS // len(at))
                for begin in range(0, len(mine), step):
                    part = mine[begin : begin + step]
                    far = np.maximum(0.0, np.round(1 - matrix[part] @ vectors.T, 12))
                    for q, row in zip(part, far):
                        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                        best = near[np.lexsort((vec_ids[near], row[near]))[:k]]
                        out += zip([ids[q]] * len(best), vec_ids[best], row[best])
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "distance"]).astype({"query_id": "int64", "vec_id": "int64"})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the ``k`` nearest vectors of each query.

    ``same`` names a column that must be equal (the metadata filter).  Queries go out as a matrix of at most about
    ``block`` rows; every Arrow batch of vectors is one matrix product and leaves its best ``k`` a query, so that only
    these are shuffled.
    """
    spark = vectors.sparkSession
    q = queries.select("vec_id", "embedding", *([same] if same else [])).where("vec_id IS NOT NULL AND size(embedding) > 0").distinct()
    blocks = -(-q.count() // block) or 1
    if blocks > 1:
        q = cut(q)
    passes = []
    for n in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n)).collect()  # about one block
        matrix, at = _matrix([r["embedding"] for r in rows])
        labels = np.array([rows[i][same] for i in at], dtype=object) if same else np.array([])
        shared = spark.sparkContext.broadcast((np.array([rows[i]["vec_id"] for i in at], dtype="int64"), matrix, labels))
        base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", *([same] if same else [])).where("vec_id IS NOT NULL AND size(embedding) > 0")
        passes.append(base.mapInPandas(_searcher(shared, k, same), "query_id bigint, vec_id bigint, distance double"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    near = reduce(DataFrame.unionByName, passes).distinct()
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


def encode_misses(texts: DataFrame, cache: DataFrame, model: str, encoder: Callable[[pd.Series], pd.Series], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors, misses): ``texts`` with ``text_hash`` and ``embedding``, and the rows (model, text_hash, embedding) to add to the cache.

    Each distinct text that the cache lacks under ``model`` is encoded once, whatever the number of rows that hold it;
    only its hash travels beyond that.  Null texts have no vector; an encoder's vectors are scaled to length one, and
    one that cannot be is null.
    """
    encode = F.pandas_udf(encoder, "array<float>")
    hashed = texts.withColumn("text_hash", F.sha2(text, 256))
    known = cache.where(F.col("model") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    wanted = hashed.where(F.col("text_hash").isNotNull()).select("text_hash", F.col(text).alias("_t")).join(known.select("text_hash"), "text_hash", "left_anti")
    once = wanted.groupBy("text_hash").agg(F.any_value("_t").alias("_t"))
    raw = cut(once.select("text_hash", encode("_t").alias("_v")))  # the encoder runs once, before anything reads its vectors
    misses = raw.select(F.lit(model).alias("model"), "text_hash", unit(F.col("_v")).cast("array<float>").alias("embedding"))
    return hashed.join(known.unionByName(misses.select("text_hash", "embedding")), "text_hash", "left"), misses
