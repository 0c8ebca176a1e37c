"""A written index of vectors that takes changes: lists of blocks about centres, and the changes since they were built.

A folder holds versions of the lists, batches of changes, and manifests, each a small table whose _SUCCESS makes it
valid; the highest valid manifest is the index. What a manifest names is written before it and never changed, so
readers of an older one go on undisturbed, and a writer that is lost leaves nothing valid behind. Two writers of one
manifest conflict, and the later one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.operators.ann import assigned, fit_centers, probes_for
from cairnlake.operators.similarity import best_matches
from cairnlake.session import importable

#: Vectors of a block. Changes that an index always takes, and the share of its vectors beyond that; vectors that are searched whole.
BLOCK, MIN_PENDING, PENDING_SHARE, EXACT = 4096, 256, 10, 50_000


@dataclass(frozen=True)
class Manifest:
    """lists: the folder of the lists, of n vectors, with the probes that the recall takes; changes: folders of later changes, oldest first."""

    number: int
    lists: str
    n: int
    probes: int
    changes: tuple[str, ...]


class VectorIndex:
    """An index over (id, v). recall: of the k nearest, measured at each build; up to `exact` vectors all lists are probed."""

    def __init__(self, spark: SparkSession, path: str, k: int = 10, recall: float = 0.95, exact: int = EXACT) -> None:
        importable(spark)
        self.spark, self.path, self.k, self.recall, self.exact = spark, path.rstrip("/"), k, recall, exact

    # what is written

    def manifest(self) -> Manifest | None:
        """The highest valid manifest."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.path}/manifests")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(hadoop.Path(f"{self.path}/manifests/m-*/_SUCCESS")) or []
        names = [x.getPath().getParent().getName() for x in found]
        if not names:
            return None
        r = self.spark.read.parquet(f"{self.path}/manifests/{max(names)}").first()
        return Manifest(r.number, r.lists, r.n, r.probes, tuple(r.changes))

    def _commit(self, m: Manifest) -> Manifest:
        row = self.spark.createDataFrame([(m.number, m.lists, m.n, m.probes, list(m.changes))], "number bigint, lists string, n bigint, probes int, changes array<string>")
        row.coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/m-{m.number:09d}")
        return m

    def _centers(self, m: Manifest) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/{m.lists}/centers").orderBy("list").collect()  # some thousands at most
        return np.array([r.center for r in rows]) if rows else np.zeros((0, 0))

    def _blocks(self, m: Manifest) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{m.lists}/blocks")

    def _changes(self, m: Manifest) -> DataFrame:
        """(id, v): the last change of each id; a null v removes it."""
        none = self.spark.createDataFrame([], "id bigint, v array<double>, at int")
        every = none
        for at, folder in enumerate(m.changes):
            every = every.union(self.spark.read.parquet(f"{self.path}/{folder}").select("id", "v", F.lit(at).alias("at")))
        return every.groupBy("id").agg(F.max_by("v", "at").alias("v"))

    def vectors(self) -> DataFrame:
        """(id, v): the indexed vectors, of unit length, with all changes."""
        m = self.manifest()
        if m is None:
            return self.spark.createDataFrame([], "id bigint, v array<double>")
        changes = self._changes(m)
        size = F.floor(F.size("flat") / F.size("ids")).cast("int")
        base = self._blocks(m).select(F.explode(F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.slice("flat", i * size + 1, size).alias("v")))).alias("x")).select("x.*")
        kept = base.join(changes.select("id"), "id", "left_anti")
        return kept.union(changes.where("v IS NOT NULL").select("id", "v")).select("id", F.col("v").cast("array<double>").alias("v"))

    # writing

    def build(self, vectors: DataFrame) -> Manifest:
        """A new version of the lists from (id, v); earlier versions and changes are superseded."""
        old, folder = self.manifest(), f"lists-{uuid.uuid4().hex}"
        real = vectors.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select("id", F.col("v").cast("array<double>").alias("v"))
        centers = fit_centers(real)
        rows = [(i, c.tolist()) for i, c in enumerate(centers)]
        self.spark.createDataFrame(rows, "list int, center array<double>").write.parquet(f"{self.path}/{folder}/centers")
        placed = assigned(real, centers) if len(centers) else self.spark.createDataFrame([], "id bigint, v array<double>, list int")
        sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        dealt = placed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        packed = dealt.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("r"))
        flat = F.flatten(F.transform("r", lambda r: r["v"]))
        packed.select("list", "block", F.transform("r", lambda r: r["id"]).alias("ids"), flat.alias("flat")).write.parquet(f"{self.path}/{folder}/blocks")
        n = self.spark.read.parquet(f"{self.path}/{folder}/blocks").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        probes = len(centers) if n <= self.exact or not n else probes_for(real, centers, self.k, self.recall)
        return self._commit(Manifest(old.number + 1 if old else 0, folder, n, probes, ()))

    def update(self, changes: DataFrame) -> Manifest:
        """Take changes (id, v), of which a null v removes an id; too many of them since the last build build it anew."""
        m = self.manifest()
        if m is None:
            return self.build(changes.where("v IS NOT NULL"))
        folder = f"changes-{uuid.uuid4().hex}"
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        unit = F.transform("v", lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))
        last = changes.where("id IS NOT NULL").groupBy("id").agg(F.any_value("v").alias("v"))
        last.select("id", F.when(F.size("v") > 0, unit).alias("v")).write.parquet(f"{self.path}/{folder}")
        m = self._commit(replace(m, number=m.number + 1, changes=(*m.changes, folder)))
        return self.build(self.vectors()) if self.pending() > max(MIN_PENDING, m.n // PENDING_SHARE) else m

    def pending(self) -> int:
        """Vectors beside the lists, and vectors of the lists that are gone or superseded."""
        m = self.manifest()
        changes = self._changes(m)
        gone = self._blocks(m).select(F.explode("ids").alias("id")).join(changes.select("id"), "id", "left_semi").count()
        return gone + changes.where("v IS NOT NULL").count()

    # reading

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """(query, id, score, rank): the k nearest of each query (id, v), its own id left out.

        The lists of a query's nearest centres are scored exactly, but for vectors that are gone, and those beside the
        lists all.
        """
        k, m = k or self.k, self.manifest()
        none = self.spark.createDataFrame([], "query bigint, id bigint, score double, rank bigint")
        if m is None:
            return none
        changes = self._changes(m)
        asked = queries.where("v IS NOT NULL AND size(v) > 0").select("id", F.col("v").cast("array<double>").alias("v"))
        near = best_matches(asked, changes.where("v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v")), k + 1).select(F.col("id").alias("query"), F.col("other").alias("id"), F.col("cosine").alias("score"))
        centers = self._centers(m)
        if len(centers):
            blocks = self._blocks(m)
            gone = blocks.select("list", "block", F.explode("ids").alias("id")).join(changes.select("id"), "id").groupBy("list", "block").agg(F.collect_list("id").alias("gone"))
            live = blocks.join(gone, ["list", "block"], "left")
            parts = assigned(asked, centers, m.probes).groupBy("list", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.collect_list("id").alias("q"), F.flatten(F.collect_list("v")).alias("y"))
            met = parts.join(live, "list").select("ids", "flat", "gone", "q", "y")
            near = near.union(met.mapInArrow(_scored(k), "query bigint, id bigint, score double"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
        return near.where("id <> query").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _scored(k: int):
    """The k + 1 nearest of a block to each query of a part, but for those that are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for ids, flat, gone, q, y in zip(*(f.column(c) for c in ("ids", "flat", "gone", "q", "y")), strict=True):
                ids, q = (x.values.to_numpy(zero_copy_only=False) for x in (ids, q))
                x, y = (v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) for v, n in ((flat, len(ids)), (y, len(q))))
                if gone.is_valid:
                    live = ~np.isin(ids, gone.values.to_numpy(zero_copy_only=False))
                    ids, x = ids[live], x[live]
                s = np.round(y @ x.T, 6)
                order = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]  # ids rise within a block
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, axis=1).ravel())], names=["query", "id", "score"])

    return run
