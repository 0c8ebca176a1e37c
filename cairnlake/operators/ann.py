"""Approximate nearest neighbours: inverted lists around centres, exact scores inside them.

Centres are fitted on a bounded, seeded sample; every vector is put in its nearest list, so nothing is left
out of the index. A query probes the lists of its nearest centres; its candidates are scored exactly. Equal
vectors are indexed once and expanded at the end. Recall grows with `probes`; with all lists it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from cairnlake.functions.vectors import unit
from cairnlake.operators.similarity import best_matches, matrices

MOST_SAMPLED = 20_000
MOST_LISTS = 4096


def fit_centers(vectors: DataFrame, lists: int | None = None, rounds: int = 8, sample: int = MOST_SAMPLED) -> np.ndarray:
    """Centres of spherical k-means over at most `sample` vectors, chosen by a hash of their ids."""
    rows = vectors.select("id", unit(F.col("v")).alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = np.array([r.v for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    k = min(MOST_LISTS, len(x), lists or max(1, int(np.sqrt(len(x)))))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c)
    return c


def assigned(vectors: DataFrame, centers: np.ndarray, probes: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(id, v, *keep, list): each vector with its nearest lists; centres travel with the tasks, MOST_LISTS at most."""
    some = vectors.select("id", unit(F.col("v")).alias("v"), *(keep or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            if not f.num_rows:
                continue
            x = f.column("v").flatten().to_numpy(zero_copy_only=False).reshape(f.num_rows, -1)
            n = min(probes, len(centers))
            order = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :n]
            yield f.take(pa.array(np.repeat(np.arange(f.num_rows), n))).append_column("list", pa.array(order.ravel().astype(np.int32)))

    return some.mapInArrow(run, StructType([*some.schema.fields, StructField("list", IntegerType())]))


def probes_for(vectors: DataFrame, centers: np.ndarray, k: int, recall: float = 0.95, sample: int = 128) -> int:
    """How many lists a query must probe for a recall, measured: the true neighbours of `sample` vectors, by a hash of
    their ids, are found among all vectors, and the least number of lists that holds such a share of them is taken."""
    some = vectors.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample).select("id", "v")
    true = best_matches(some, vectors, k + 1).where("id <> other").select("id", "other")
    where = true.join(assigned(vectors, centers).select(F.col("id").alias("other"), "list"), "other").join(some.select("id", unit(F.col("v")).alias("v")), "id")
    rows = where.select("v", "list").collect()  # sample * (k + 1) at most
    if not rows:
        return 1
    order = np.argsort(-(np.array([r.v for r in rows]) @ centers.T), axis=1, kind="stable")
    place = np.sort((order == np.array([r.list for r in rows])[:, None]).argmax(axis=1))
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


def ann_top_k(vectors: DataFrame, queries: DataFrame, k: int, probes: int | None = None, centers: np.ndarray | None = None, recall: float = 0.95) -> DataFrame:
    """(query, id, score, rank): k near vectors of each query, the query's own id left out.

    Without `probes` as many lists are probed as the recall takes, measured on these vectors.

    Lists are split into chunks of a few thousand vectors by a hash, so a list that holds a third of all vectors
    is still many small tasks; a query meets every chunk of the lists it probes.
    """
    if centers is None:
        centers = fit_centers(vectors)
    if not len(centers):
        return queries.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).where("false")
    if probes is None:
        probes = probes_for(vectors, centers, k, recall)
    classes = vectors.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("id").alias("id"))
    index = assigned(classes, centers)
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / 4096).cast("int").alias("chunks"))
    parts = index.join(F.broadcast(sizes), "list").withColumn("chunk", F.abs(F.xxhash64("id") % F.col("chunks")).cast("int"))
    packed = lambda x, *by: x.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("r"))
    flat = lambda a, b: [F.transform("r", lambda r: r["id"]).alias(a), F.flatten(F.transform("r", lambda r: r["v"])).alias(b)]
    blocks = packed(parts, "list", "chunk").select("list", *flat("a", "x"))
    asked = packed(assigned(queries, centers, probes), "list", F.abs(F.xxhash64("id") % 64).alias("part")).select("list", *flat("b", "y"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for (ids, x), (q, y) in zip(matrices(f, "a", "x"), matrices(f, "b", "y"), strict=True):
                s = np.round(y @ x.T, 9)
                order = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, axis=1).ravel())], names=["query", "first", "score"])

    found = asked.join(blocks, "list").select("a", "x", "b", "y").mapInArrow(score, "query bigint, first bigint, score double")
    members = vectors.select("id", F.xxhash64("v").alias("h"), "v").join(classes.select("h", "v", F.col("id").alias("first")), ["h", "v"]).select("id", "first")
    each = found.join(members, "first").where("id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return each.select("query", "id", "score", rank.cast("long").alias("rank")).where(F.col("rank") <= k)
