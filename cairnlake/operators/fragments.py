"""Small groups of faces that rejoin the identity they were cut from, by the votes of single faces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.vectors import dot, unit
from cairnlake.operators.graph import components
from cairnlake.operators.similarity import cosine_links
from cairnlake.session import staged


@dataclass(frozen=True)
class Limits:
    """Limits of fragment recovery. The defaults."""

    centroid: float = 0.75
    margin: float = 0.05
    member: float = 0.75
    cohesion: float = 0.70
    most_small: int = 12
    least_large: int = 16
    most_large: int = 256
    large_centroid: float = 0.85
    large_ratio: int = 16
    large_voters: float = 0.80
    large_captures: float = 0.25
    source_voters: int = 2
    target_voters: int = 3
    witnesses: int = 64
    #: How far below the limit a centre may lie at first and still be looked at again as groups grow.
    reach: float = 0.10


ROWS_SQL = "component bigint, kind int, cluster bigint, n bigint, x bigint, key string, quality double, v array<double>, large boolean, target boolean, barred boolean"


def witnesses(faces: DataFrame, most: int) -> DataFrame:
    """(cluster, id, quality, content_hash, v): of each cluster the best `most` faces of different content and vector.

    Of each content hash the best face counts, of those each vector once; faces without a hash are no witnesses.
    """
    order = [F.col("quality").desc(), F.col("id")]
    first = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy("cluster", *by).orderBy(*order)))
    one = first(faces.where("content_hash IS NOT NULL"), "content_hash").where("r = 1")
    one = first(one, "v").where("r = 1")
    return first(one).where(F.col("r") <= most).select("cluster", "id", "quality", "content_hash", "v")


def cluster_facts(faces: DataFrame) -> DataFrame:
    """(cluster, n, sum, cohesion, captures): members, the sum of their unit vectors, its length by member, and different captures."""
    sums = faces.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    total = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"))
    capture = F.when(F.length("content_hash") > 0, F.concat(F.lit("c"), "content_hash")).otherwise(F.concat(F.lit("f"), F.col("file_id").cast("string")))
    n = faces.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(capture).alias("captures"))
    norm = F.sqrt(dot(F.col("sum"), F.col("sum")))
    return n.join(total, "cluster").where(norm > 1e-30).select("cluster", "n", "sum", (norm / F.col("n")).alias("cohesion"), "captures")


def recovered_fragments(faces: DataFrame, blocked: DataFrame | None = None, owners: DataFrame | None = None, barred: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(cluster, into) of fragments that join a larger identity.

    faces: (id, v, cluster, file_id, content_hash, quality); blocked: (a, b) clusters that are different people; owners:
    (cluster) that belong to a person and never move; barred: (cluster) that take no fragment.

    A cluster of most_small faces at most, each of its own capture, or one of least_large to most_large, is a fragment if
    its vectors cohere. It goes to the cluster of more than most_small faces with the nearest centre, if that is near
    enough, clear of the second by `margin`, shares no file with it and is not blocked, and if its faces vote for it: each
    witness of a small fragment (large_voters of a large one) must be near to target_voters witnesses of the target.
    Fragments are taken in order of size, then number, and judged again by what the targets have become.

    Fragments and the targets within `reach` of their limit make connected parts; a part, of which a task holds the
    centres and 64 witnesses of each cluster, is one ordered pass, and parts do not touch each other.
    """
    spark, p = faces.sparkSession, limits
    f = staged(faces.where("cluster IS NOT NULL").select("id", "cluster", "file_id", "content_hash", F.col("quality").cast("double").alias("quality"), unit(F.col("v")).alias("v")))
    own = spark.createDataFrame([], "cluster bigint") if owners is None else owners.select("cluster").distinct()
    shut = spark.createDataFrame([], "cluster bigint") if barred is None else barred.select("cluster").distinct()
    facts = cluster_facts(f).join(own.withColumn("owned", F.lit(True)), "cluster", "left").join(shut.withColumn("barred", F.lit(True)), "cluster", "left")
    small = (F.col("n") >= p.source_voters) & (F.col("n") <= p.most_small) & (F.col("captures") == F.col("n"))
    large = (F.col("n") >= p.least_large) & (F.col("n") > p.most_small) & (F.col("n") <= p.most_large) & (F.col("captures") >= p.large_captures * F.col("n"))
    fits = (F.col("cohesion") >= p.cohesion) & F.col("owned").isNull()
    facts = staged(facts.select(
        "cluster", "n", "sum", F.when(fits & small, False).when(fits & large, True).alias("large"),
        ((F.col("n") > p.most_small) & (F.col("cohesion") >= p.cohesion)).alias("target"), F.coalesce("barred", F.lit(False)).alias("barred"),
    ))
    of = lambda rows: rows.select(F.col("cluster").alias("id"), F.col("sum").alias("v"))
    near = cosine_links(of(facts.where("large IS NOT NULL")), of(facts.where("target")), p.centroid - p.reach)
    parts = staged(components(near.select(F.col("id").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "cluster"))
    mine = staged(f.join(parts, "cluster"))

    def rows(df: DataFrame, kind: int, **given) -> DataFrame:
        names = [c.split(" ", 1) for c in ROWS_SQL.split(", ")]
        return df.select("component", F.lit(kind).alias("kind"), "cluster", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in names[3:]])

    col = F.col
    every = rows(facts.join(parts, "cluster"), 0, n=col("n"), v=col("sum"), large=col("large"), target=col("target"), barred=col("barred"))
    seen = witnesses(mine.select("cluster", "id", "quality", "content_hash", "v"), p.witnesses).join(parts, "cluster")
    every = every.union(rows(seen, 1, x=col("id"), key=col("content_hash"), quality=col("quality"), v=col("v")))
    every = every.union(rows(mine.select("component", "cluster", "file_id").distinct(), 2, x=col("file_id")))
    if blocked is not None:
        both = blocked.select(F.explode(F.array(F.struct(F.col("a").alias("cluster"), F.col("b").alias("other")), F.struct(F.col("b").alias("cluster"), F.col("a").alias("other")))).alias("p")).select("p.*")
        every = every.union(rows(both.join(parts, "cluster"), 3, x=col("other")))
    return every.groupBy("component").applyInPandas(lambda part: recover(part, p), "cluster bigint, into bigint")


class _Group:
    """A cluster and what has joined it."""

    def __init__(self, row) -> None:
        self.cluster, self.n, self.sum = row.cluster, row.n, np.asarray(row.v, float)
        self.target, self.barred, self.members, self.files, self.blocked, self.seen = bool(row.target), bool(row.barred), {row.cluster}, set(), set(), []

    @property
    def length(self) -> float:
        return float(np.linalg.norm(self.sum))


def _votes(source: list, target: list, large: bool, p: Limits) -> bool:
    """Whether witnesses (quality, id, key, v) of a fragment are near enough to those of a target."""
    if len(source) < (p.least_large if large else p.source_voters) or len(target) < p.target_voters:
        return False
    near = np.stack([s[3] for s in source]) @ np.stack([t[3] for t in target]).T >= p.member
    voters = int((near.sum(axis=1) >= p.target_voters).sum())
    return voters >= max(int(np.ceil(np.float32(len(source)) * np.float32(p.large_voters))), p.least_large) if large else voters == len(source)


def _merged(a: list, b: list, most: int) -> list:
    """Witnesses of two groups: the best of each content, then each vector once."""
    keys, vectors, out = set(), set(), []
    for w in sorted(a + b, key=lambda w: (-w[0], w[1])):
        new = w[2] not in keys
        keys.add(w[2])
        if new and w[3].tobytes() not in vectors:
            vectors.add(w[3].tobytes())
            out.append(w)
    return out[:most]


def recover(part: pd.DataFrame, p: Limits) -> pd.DataFrame:
    """The ordered pass over one part."""
    groups = {r.cluster: _Group(r) for r in part[part.kind == 0].itertuples()}
    for r in part[part.kind == 1].sort_values(["quality", "x"], ascending=[False, True]).itertuples():
        groups[r.cluster].seen.append((r.quality, r.x, r.key, np.asarray(r.v, float)))
    for kind, name in ((2, "files"), (3, "blocked")):
        for r in part[part.kind == kind].itertuples():
            getattr(groups[r.cluster], name).add(r.x)
    large_of = {r.cluster: bool(r.large) for r in part[part.kind == 0].itertuples() if r.large is not None and r.large == r.large}
    root = {c: c for c in groups}
    open_ = {c for c, g in groups.items() if g.target}

    def best(source: _Group, large: bool) -> int | None:
        """The target that is near enough and clear of the second."""
        need, hits = max(p.centroid, p.large_centroid) if large else p.centroid, []
        for c in {root[c] for c in open_}:
            g = groups[c]
            if g is source or g.n <= p.most_small or g.barred or (large and g.n < p.large_ratio * source.n) or source.blocked & g.members or not source.files.isdisjoint(g.files) or g.length / g.n < p.cohesion:
                continue
            s = float(source.sum @ g.sum) / (source.length * g.length)
            if s >= need:
                hits.append((-s, min(g.members), c))
        hits.sort()
        clear = hits and (-hits[0][0]) - (-hits[1][0] if len(hits) > 1 else -1.0) >= p.margin
        return hits[0][2] if clear else None

    wishes = [(-groups[c].n, c, t) for c, large in large_of.items() if (t := best(groups[c], large)) is not None and _votes(groups[c].seen, groups[t].seen, large, p)]
    out = []
    for _, c, wish in sorted(wishes):
        source, large = groups[c], large_of[c]
        if root[c] != c or best(source, large) != root[wish]:
            continue
        g = groups[root[wish]]
        total = source.sum + g.sum
        if not _votes(source.seen, g.seen, large, p) or np.linalg.norm(total) / (source.n + g.n) < p.cohesion:
            continue
        g.sum, g.n, g.seen = total, g.n + source.n, _merged(g.seen, source.seen, p.witnesses)
        g.files |= source.files
        g.barred |= source.barred
        for m in source.members:
            root[m] = g.cluster
        g.members |= source.members
        g.blocked |= source.blocked
        out.append(c)
    return pd.DataFrame({"cluster": out, "into": [root[c] for c in out]}, dtype="int64")
