"""Connected components and survivor choice over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.session import drop_staged, released, staged

#: Edges of a graph that a task joins by itself, where a caller lets it; larger graphs take rounds.
FEW_EDGES = 200_000


def _signature(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two folds of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a task's edges (u, v)."""
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
        kind = batch.schema.field("u").type
    if above:
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "component"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, in_task: int = 0) -> DataFrame:
    """(node, component) for every node that an edge touches; component is its smallest reachable node.

    Alternates large-star and small-star steps: every step links nodes to the least neighbour they see, so
    a chain of n nodes takes about log n rounds. All steps are grouped minima and equi-joins, edges never
    exceed their first number, and each round is a written table, so lost executors cost one round at most.
    Null ends and loops are left out; repeated edges count once; no edges give no rows. A graph of in_task edges at most
    is joined by one task: rounds over few edges cost the driver a plan and several stages each, whatever they hold.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    spark, before = e.sparkSession, _signature(e)
    if before[0] <= in_task:
        found = staged(e.coalesce(1).mapInArrow(_joined, f"node {e.schema['u'].dataType.simpleString()}, component {e.schema['u'].dataType.simpleString()}"))
        drop_staged(e)
        return found
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every greater neighbour of u is linked to the least of u and its neighbours; a row for each edge
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its lesser neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        new = staged(small)
        now = _signature(new)
        drop_staged(e)
        e = new
        released(spark)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def survivors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, survivor) of merged groups: named before unnamed, then more files, then the lower id.

    pairs: (src, dst); nodes: (id, named, files). Components come first; the survivor is a grouped maximum.
    """
    found = components(pairs).join(nodes.withColumnRenamed("id", "node"), "node")
    best = found.groupBy("component").agg(F.max(F.struct("named", "files", (-F.col("node")).alias("back"))).alias("x"))
    return found.join(best, "component").select(F.col("node").alias("id"), (-F.col("x.back")).alias("survivor"))
