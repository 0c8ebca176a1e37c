"""Identity clustering, suggestions and review decisions over face vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.vectors import dot, unit
from cairnlake.operators.constrained import constrained_components
from cairnlake.operators.graph import components
from cairnlake.operators.similarity import best_matches, centroids, cohesion, cosine_links, cosine_pairs, nearest, two_nearest
from cairnlake.session import staged


def merge_suggestions(centers: DataFrame, seen: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs of people (id, v) whose cosine lies in [low, high) and who never share a file of seen (file_id, person_id)."""
    pairs = cosine_pairs(centers, low).where(F.col("cosine") < high)
    once = seen.distinct()
    met = once.select("file_id", F.col("person_id").alias("a")).join(once.select("file_id", F.col("person_id").alias("b")), "file_id").where("a < b").select("a", "b").distinct()
    return pairs.join(met, ["a", "b"], "left_anti")


def review_decision(score: Column, margin: Column, suggest: float, floor: float, least_margin: float, assign: bool = False) -> Column:
    """What to do with a face whose best person has a score and a margin to the next one; without another (null) it is clear."""
    sure = "assigned" if assign else "suggested"
    return F.when(score.isNull() | (score < floor), "unmatched").when(margin < least_margin, "ambiguous").when(score >= suggest, sure).otherwise("uncertain")


def reviewed(faces: DataFrame, persons: DataFrame, barred: DataFrame, suggest: float = 0.55, floor: float = 0.40, least_margin: float = 0.05, assign: bool = False) -> DataFrame:
    """(id, person_id, score, decision, runner, runner_score): the person that a face is offered to.

    faces: (id, v); persons: (person_id, v, unknown); barred: (id, person_id) that the face was taken from or refused by. A
    face nearest to an unknown person is unmatched; else the best person that is not unknown and not barred is offered,
    against the best other one, whoever that is. Each face is compared with as many persons as it is barred from, and two.
    """
    most = barred.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    unknown = persons.where("unknown").select(F.col("person_id").alias("other"), F.lit(True).alias("u"))
    k = most + 2 + unknown.count()  # unknown persons are a few, by hand
    near = best_matches(faces, persons.select(F.col("person_id").alias("id"), "v"), k)
    near = near.join(F.broadcast(unknown), "other", "left").join(barred.select("id", F.col("person_id").alias("other"), F.lit(True).alias("b")).distinct(), ["id", "other"], "left")
    free = F.col("u").isNull() & F.col("b").isNull()
    near = near.withColumn("offer", F.min(F.when(free, F.col("rank"))).over(Window.partitionBy("id")))
    at = lambda r, c: F.max(F.when(r, F.col(c)))
    best, other = F.col("rank") == F.col("offer"), F.col("rank") == F.when(F.col("offer") == 1, 2).otherwise(1)
    g = near.groupBy("id").agg(at(best, "other").alias("person_id"), at(best, "cosine").alias("score"), at(other, "other").alias("runner"), at(other, "cosine").alias("runner_score"), F.bool_or((F.col("rank") == 1) & F.col("u").isNotNull()).alias("stranger"))
    told = F.when(F.coalesce("stranger", F.lit(False)) | F.col("person_id").isNull(), "unmatched").otherwise(review_decision(F.col("score"), F.col("score") - F.col("runner_score"), suggest, floor, least_margin, assign))
    g = g.withColumn("decision", told)
    keep = lambda c: F.when(F.col("decision") != "unmatched", F.col(c)).alias(c)
    return faces.select("id").join(g, "id", "left").select("id", keep("person_id"), keep("score"), F.coalesce("decision", F.lit("unmatched")).alias("decision"), keep("runner"), keep("runner_score"))


def admitted(classes: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """A10: classes (size_bytes, n, first_id) admitted whole, largest first, while both caps hold; one too large does not stop later ones.

    The fold depends on order. At most most_files // 2 classes can be admitted, but which ones needs one pass in
    order: the sorted classes stream through one task, which holds two numbers.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = size = 0
        for f in frames:
            keep = []
            for n, b in zip(f.n, f.size_bytes, strict=True):
                ok = files + n <= most_files and size + n * b <= most_bytes
                files, size = files + n * ok, size + n * b * ok
                keep.append(bool(ok))
            yield f[keep]

    return classes.orderBy(F.col("size_bytes").desc(), "first_id").coalesce(1).mapInPandas(fold, classes.schema)


ALIKE = 0.999
ROUNDS = 10


def _halves(v: np.ndarray, ids: np.ndarray) -> np.ndarray | None:
    """Which unit vectors are nearer to the first of two centres, as halves() finds them; None if all are on one side."""
    s = np.round(v @ _unit(v.mean(axis=0)), 9)
    far = np.lexsort((ids, s))[0]
    t = np.round(v @ v[far], 9)
    t[far] = np.inf
    a, b = v[far], v[np.lexsort((ids, t))[0]]
    for _ in range(ROUNDS):
        p, q = np.round(v @ a, 9), np.round(v @ b, 9)
        side = (p > q) | ((p == q) & (ids % 2 == 0))
        if side.all() or not side.any():
            return None
        x, y = _unit(v[side].mean(axis=0)), _unit(v[~side].mean(axis=0))
        if x @ a > ALIKE and y @ b > ALIKE:
            break
        a, b = x, y
    return side


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x) or 1.0)


def _split(v: np.ndarray, ids: np.ndarray, mean: float, variance: float, depth: int) -> np.ndarray:
    """Labels from splitting in two until a group's cosines to its centre are high and even."""
    labels, todo, n = np.zeros(len(v), dtype=int), [(np.arange(len(v)), 0)], 0
    while todo:
        rows, d = todo.pop()
        s = v[rows] @ _unit(v[rows].mean(axis=0))
        even = len(rows) < 4 or d >= depth or (s.mean() >= mean and s.var() <= variance)
        side = None if even else _halves(v[rows], ids[rows])
        if side is None:
            labels[rows] = n
            n += 1
        else:
            todo += [(rows[side], d + 1), (rows[~side], d + 1)]
    return labels


def halves(faces: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Two groups within each group of (id, v): (by, id, v, side) and (by, a, b), their centres; groups that do not part are left out.

    Spherical 2-means from the face farthest from the centre and the one farthest from that; faces as near to both
    go by whether their id is even. Sums of a group are combined before each shuffle, so no task holds a group.
    """
    u = staged(faces.select(by, "id", unit(F.col("v")).alias("v")))
    score = lambda c: F.round(dot(F.col("v"), F.col(c)), 9)
    center = centroids(u, by).select(by, F.col("centroid").alias("c"))
    far = u.join(center, by).groupBy(by).agg(F.min(F.struct(score("c").alias("s"), "id", "v")).alias("x")).select(by, F.col("x.id").alias("far"), F.col("x.v").alias("next_a"))
    other = u.join(far, by).where("id <> far").groupBy(by).agg(F.min(F.struct(score("next_a").alias("s"), "id", "v")).alias("y")).select(by, F.col("y.v").alias("next_b"))
    at = staged(far.join(other, by).select(by, F.col("next_a").alias("a"), F.col("next_b").alias("b"), "next_a", "next_b", F.lit(False).alias("done")))
    nearer = F.when(score("a") > score("b"), 0).when(score("a") < score("b"), 1).otherwise(F.when(F.col("id") % 2 == 0, 0).otherwise(1))
    for _ in range(ROUNDS):
        now = at.select(by, *[F.when(F.col("done"), F.col(x)).otherwise(F.col(f"next_{x}")).alias(x) for x in "ab"], F.col("done").alias("was"))
        sided = u.join(now, by).withColumn("key", F.struct(by, nearer.alias("side")))
        new = centroids(sided.select("key", "id", "v"), "key").select(F.col(f"key.{by}").alias(by), F.col("key.side").alias("side"), "centroid")
        pair = new.groupBy(by).agg(*[F.first(F.when(F.col("side") == i, F.col("centroid")), ignorenulls=True).alias(f"next_{x}") for i, x in enumerate("ab")])
        alike = (dot(F.col("next_a"), F.col("a")) > ALIKE) & (dot(F.col("next_b"), F.col("b")) > ALIKE)
        at = staged(now.join(pair.where("next_a IS NOT NULL AND next_b IS NOT NULL"), by).select(by, "a", "b", "next_a", "next_b", (F.col("was") | alike).alias("done")))
        if at.where("NOT done").isEmpty():
            break
    return u.join(at.select(by, "a", "b"), by).select(by, "id", "v", nearer.alias("side")), at.select(by, F.col("next_a").alias("a"), F.col("next_b").alias("b"))


def half_facts(sided: DataFrame, centers: DataFrame, by: str, percentile: float = 0.05) -> DataFrame:
    """(by, size_a, size_b, cosine, mean_a, mean_b, margin): of two groups their sizes, likeness, mean cosines to their own
    centre, and the low percentile of how much nearer faces are to their own centre than to the other."""
    j = sided.join(centers, by)
    own, other = [F.when(F.col("side") == 0, dot(F.col("v"), F.col(x))).otherwise(dot(F.col("v"), F.col(y))) for x, y in ("ab", "ba")]
    scored = j.select(by, "side", own.alias("own"), (own - other).alias("m"), dot(F.col("a"), F.col("b")).alias("cosine"))
    w = Window.partitionBy(by)
    ranked = scored.withColumn("r", F.row_number().over(w.orderBy("m"))).withColumn("n", F.count(F.lit(1)).over(w))
    of = lambda i, x: F.avg(F.when(F.col("side") == i, x))
    return ranked.groupBy(by).agg(
        F.count_if(F.col("side") == 0).alias("size_a"), F.count_if(F.col("side") == 1).alias("size_b"), F.max("cosine").alias("cosine"), of(0, F.col("own")).alias("mean_a"), of(1, F.col("own")).alias("mean_b"),
        F.max(F.when(F.col("r") == F.least(F.floor(F.col("n") * percentile), F.col("n") - 1) + 1, F.col("m"))).alias("margin"),
    )


def bimodal_parts(faces: DataFrame, least: int = 5000, least_group: int = 500, share: float = 0.20, apart: float = 0.74, margin: float = 0.02) -> DataFrame:
    """(id, cluster) of (id, v, cluster) with very large clusters parted where they are plainly two people.

    A cluster of `least` faces or more falls in two if both groups have `least_group` faces and a `share` of it, their
    centres' cosine is `apart` or less, and all but a twentieth of the faces are nearer to their own by `margin`.
    The part is named by its least face.
    """
    large = faces.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    sided, centers = halves(faces.join(large, "cluster", "left_semi"), "cluster")
    f = half_facts(sided, centers, "cluster")
    small = F.least("size_a", "size_b")
    parted = f.where((small >= least_group) & (small / (F.col("size_a") + F.col("size_b")) >= share) & (F.col("cosine") <= apart) & (F.col("margin") >= margin)).select("cluster")
    own = sided.join(parted, "cluster").select("cluster", "side", "id")
    named = own.join(own.groupBy("cluster", "side").agg(F.min("id").alias("part")), ["cluster", "side"]).select("id", "part")
    return faces.join(named, "id", "left").select("id", F.coalesce("part", "cluster").alias("cluster"))


def _large_split(named: DataFrame, mean: float, variance: float, depth: int, most: int) -> DataFrame:
    """(id, v, cluster, depth): clusters of more than `most` faces split in two, as _split does, until they are even or small."""
    named = named.withColumn("depth", F.lit(0))
    for d in range(depth):
        sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("cluster")
        if sizes.isEmpty():
            break
        members = named.join(sizes, "cluster", "left_semi").where(F.col("depth") == d)
        spread = cohesion(members, centroids(members, "cluster"), "cluster")
        uneven = spread.where((F.col("mean") < mean) | (F.col("variance") > variance)).select("cluster")
        sided, _ = halves(members.join(uneven, "cluster", "left_semi").select("cluster", "id", "v"), "cluster")
        parts = sided.groupBy("cluster", "side").agg(F.min("id").alias("part"))
        moved = sided.join(parts, ["cluster", "side"]).select("id", "part")
        named = staged(named.join(moved, "id", "left").select("id", "v", F.coalesce("part", "cluster").alias("cluster"), F.when(F.col("part").isNotNull(), d + 1).otherwise(F.col("depth")).alias("depth")))
    return named


def _joined(single: DataFrame, grouped: DataFrame, exclusive: DataFrame, assign: float, margin: float) -> DataFrame:
    """(id, joined): single faces (id, v) to the best centre of grouped (id, v, component) that holds none of their keys.

    Of faces that share a key and want the same centre the least id has it; the others choose again without it. A face
    asks for more centres until it has two that hold none of its keys, or there are no more.
    """
    centers = staged(centroids(grouped, "component").select(F.col("component").alias("id"), F.col("centroid").alias("v")))
    taken = staged(grouped.select("id", "component").join(exclusive.withColumnRenamed("node", "id"), "id").select("component", "key").distinct())
    own = staged(single.select("id").join(exclusive.withColumnRenamed("node", "id"), "id").select("id", "key"))
    open_, out, n = staged(single.select("id", "v")), None, centers.count()
    k = 4
    while True:
        near = staged(best_matches(open_, centers, min(k, n)))
        barred = near.join(own, "id").join(taken.withColumnRenamed("component", "other"), ["other", "key"]).select("id", "other").distinct()
        ranked = near.join(barred, ["id", "other"], "left_anti").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("rank")))
        at = lambda i, c: F.max(F.when(F.col("at") == i, F.col(c)))
        two = staged(open_.select("id").join(ranked.groupBy("id").agg(at(1, "other").alias("other"), at(1, "cosine").alias("score"), at(2, "cosine").alias("second")), "id", "left"))
        short = two.where("second IS NULL").select("id") if k < n else two.select("id").limit(0)
        wants = two.join(short, "id", "left_anti").where((F.col("score") >= assign) & (F.col("score") - F.coalesce("second", F.lit(-2.0)) >= margin)).select("id", "other")
        asks = wants.join(own, "id")
        first = asks.groupBy("other", "key").agg(F.min("id").alias("first"))
        later = asks.join(first, ["other", "key"]).where("id <> first").select("id").distinct()
        won = staged(wants.join(later, "id", "left_anti"))
        out = won if out is None else staged(out.union(won))
        taken = staged(taken.union(won.join(own, "id").select(F.col("other").alias("component"), "key")).distinct())
        # those without a centre that fits stay single; those beaten or short of centres ask again
        again = staged(open_.join(short.union(later).distinct(), "id", "left_semi"))
        if again.isEmpty():
            return out.select("id", F.col("other").alias("joined"))
        k = min(n, 4 * k) if not short.isEmpty() else k
        open_ = again


def cluster(
    faces: DataFrame, core: float = 0.66, assign: float = 0.54, margin: float = 0.10, k: int = 32, mean: float = 0.60, variance: float = 0.04, depth: int = 7, most: int = 5000, exclusive: DataFrame | None = None
) -> DataFrame:
    """(id, cluster) in three passes over (id, v): components of mutual nearest neighbours at `core`, single
    faces to the best centre at `assign` with a margin, and splitting of uneven groups.

    exclusive: (node, key), faces with a key in common that never share a cluster: the core graph is merged in the order
    of similarity around them, and a single face joins no core that holds one of its keys. Centres are those of the cores.

    The id of a cluster is the least id in it. Groups of more than `most` faces are split by jobs over all faces of a
    group (halves), smaller ones in a task each; both follow the same rule, so `most` does not change a result.
    """
    near = nearest(faces, k).where(F.col("cosine") >= core).select("id", "other")
    near = near if exclusive is None else nearest(faces, k).where(F.col("cosine") >= core).select("id", "other", "cosine")
    mutual = near.join(near.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"]).where("id < other")
    if exclusive is None:
        found = components(mutual.select(F.col("id").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "id")
    else:
        links = mutual.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("cosine").alias("weight"))
        found = constrained_components(links, exclusive)
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        found = found.join(sizes, "component", "left_semi").select(F.col("node").alias("id"), "component")
    labelled = staged(faces.join(found, "id", "left"))
    grouped = labelled.where("component IS NOT NULL")
    single = labelled.where("component IS NULL")
    if exclusive is None:
        best = two_nearest(single, centroids(grouped, "component"), "component").where((F.col("score") >= assign) & (F.coalesce("margin", F.lit(2.0)) >= margin)).select("id", F.col("center").alias("joined"))
    else:
        best = _joined(single, grouped, exclusive, assign, margin)
    named = staged(labelled.join(best, "id", "left").select("id", "v", F.coalesce("component", "joined", "id").alias("cluster")))
    named = _large_split(named, mean, variance, depth, most)
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    named = named.join(sizes, "cluster")

    def split(f: pd.DataFrame) -> pd.DataFrame:
        v = np.array([np.asarray(x, dtype=float) for x in f.v])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        order = np.argsort(f.id.to_numpy())
        ids = f.id.to_numpy()[order]
        out = pd.DataFrame({"id": ids, "part": _split(v[order], ids, mean, variance, depth - int(f.depth.iloc[0]))})
        return pd.DataFrame({"id": out.id, "cluster": out.groupby("part").id.transform("min")})

    small = named.where((F.col("n") >= 4) & (F.col("n") <= most)).groupBy("cluster").applyInPandas(split, "id bigint, cluster bigint")
    return small.unionByName(named.where((F.col("n") < 4) | (F.col("n") > most)).select("id", "cluster"))


def protected_partition(faces: DataFrame, owners: DataFrame, different: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(face, part) of raw clusters (face, cluster) under rulings: owners (face, person) and pairs that differ (a, b).

    A cluster with two owners or a differing pair falls apart: owned faces go to their owner's part, others stand
    alone. An owner with a differing pair among its faces is no part at all: its faces stand alone. Faces of a
    whole cluster with one owner join that owner. The part's name is its least face.
    """
    f = faces if excluded is None else faces.join(excluded.select("face"), "face", "left_anti")
    f = f.join(owners, "face", "left")
    of = lambda x, y: f.select(F.col("face").alias(x), F.col("cluster").alias(f"c{y}"), F.col("person").alias(f"p{y}"))
    pairs = different.join(of("a", 1), "a").join(of("b", 2), "b")
    broken_owner = pairs.where("p1 = p2").select(F.col("p1").alias("person")).distinct().withColumn("bad_owner", F.lit(True))
    broken = pairs.where("c1 = c2").select(F.col("c1").alias("cluster")).union(f.groupBy("cluster").agg(F.countDistinct("person").alias("n")).where("n > 1").select("cluster")).distinct().withColumn("bad", F.lit(True))
    single = f.groupBy("cluster").agg(F.max("person").alias("owner"))
    j = f.join(broken, "cluster", "left").join(broken_owner, "person", "left").join(single, "cluster", "left")
    key = (
        F.when(F.col("person").isNotNull(), F.when(F.col("bad_owner"), F.concat(F.lit("f"), "face")).otherwise(F.concat(F.lit("p"), "person")))
        .when(F.col("bad"), F.concat(F.lit("f"), "face")).when(F.col("owner").isNotNull(), F.concat(F.lit("p"), "owner")).otherwise(F.concat(F.lit("c"), "cluster"))
    )
    named = j.select("face", key.alias("key"))
    return named.join(named.groupBy("key").agg(F.min("face").alias("part")), "key").select("face", "part")


def _one_to_one(pairs: DataFrame) -> DataFrame:
    """(cluster, id) of pairs (id, cluster, k) taken one to one, greatest k first: rounds in which a pair is the best of both its sides."""
    open_, out = staged(pairs), None
    while True:
        best = [open_.groupBy(c).agg(F.max("k").alias("k")) for c in ("id", "cluster")]
        won = staged(open_.join(best[0], ["id", "k"]).join(best[1], ["cluster", "k"]).select("cluster", "id"))
        out = won if out is None else out.union(won)
        open_ = staged(open_.join(won.select("id"), "id", "left_anti").join(won.select("cluster"), "cluster", "left_anti"))
        if open_.isEmpty():
            return out


def identity_anchors(faces: DataFrame) -> DataFrame:
    """(cluster, centroid, radius) of clusters of faces (id, v, cluster): the tenth part of their least cosines to the centre, from 0.45 to 0.85; 0.5 for one face."""
    centers = centroids(faces, "cluster")
    scored = faces.join(centers, "cluster").select("cluster", "n", "id", dot(unit(F.col("v")), F.col("centroid")).alias("s"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("s", "id")) - 1)
    tenth = ranked.where(F.col("r") == F.floor(F.col("n") * 0.1)).select("cluster", F.when(F.col("n") < 2, 0.5).otherwise(F.least(F.greatest("s", F.lit(0.45)), F.lit(0.85))).alias("radius"))
    return centers.join(tenth, "cluster").select("cluster", "centroid", "radius")


def inherited_ids(priors: DataFrame, clusters: DataFrame, fixed: DataFrame, preserved: DataFrame, anchors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(cluster, id): clusters keep the identity of the prior they overlap by half of its faces or more.

    anchors: (id, centroid, radius) of priors and (cluster, centroid) of clusters: those still free then match by their
    centres, the most alike first, where the cosine reaches the prior's radius.

    priors: (id, face); clusters: (cluster, face, representative); fixed: (cluster, id) confirmed by hand;
    preserved: (id) that stay out of reach. Pairs are matched one to one, larger overlap first, then the prior
    that holds the representative, then the lower id: rounds in which a pair is the best of both its sides,
    which is what a greedy pass in that order gives. Raises ValueError for input that contradicts itself.
    """
    each = clusters.groupBy("face").agg(F.count(F.lit(1)).alias("n"))
    problems = {
        "a face in two clusters": each.where("n > 1"),
        "a representative outside its cluster": clusters.groupBy("cluster").agg(F.max(F.col("face") == F.col("representative")).alias("ok")).where("NOT ok"),
        "one id fixed to two clusters": fixed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "a fixed id that is not known": fixed.join(priors.select("id").distinct(), "id", "left_anti"),
        "a preserved face in a cluster": clusters.join(priors.join(preserved, "id", "left_semi"), "face", "left_semi"),
    }
    for what, rows in problems.items():
        if not rows.isEmpty():
            raise ValueError(what)
    sizes = priors.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    both = priors.join(clusters, "face").groupBy("id", "cluster").agg(F.count(F.lit(1)).alias("overlap"), F.max((F.col("face") == F.col("representative")).cast("int")).alias("anchor"))
    free = both.join(sizes, "id").where(2 * F.col("overlap") >= F.col("size")).join(fixed.select("cluster"), "cluster", "left_anti").join(fixed.select("id").union(preserved.select("id")), "id", "left_anti")
    key = F.struct("overlap", "anchor", (-F.col("id")).alias("i"), (-F.col("cluster")).alias("c"))
    out = fixed.select("cluster", "id").union(_one_to_one(free.select("id", "cluster", key.alias("k"))))
    if anchors is not None:
        out = staged(out)
        taken = lambda df, c: df.join(out.select(c), c, "left_anti")
        radius = F.when(~F.isnan("radius") & F.col("radius").between(0.0, 1.0), F.col("radius"))
        old = taken(anchors[0].join(preserved.select("id"), "id", "left_anti"), "id").select("id", F.col("centroid").alias("v"), radius.alias("radius")).where("v IS NOT NULL AND radius IS NOT NULL")
        new = taken(anchors[1], "cluster").select(F.col("cluster").alias("id"), F.col("centroid").alias("v"))
        least = old.agg(F.min("radius")).first()[0]
        if least is not None:
            near = cosine_links(old.select("id", "v"), new, least - 1e-9, apart=False).join(old.select("id", "radius"), "id")
            near = near.withColumn("cosine", F.round("cosine", 9)).where(F.col("cosine") >= F.col("radius"))
            key = F.struct("cosine", (-F.col("id")).alias("i"), (-F.col("other")).alias("c"))
            out = out.union(_one_to_one(near.select("id", F.col("other").alias("cluster"), key.alias("k"))))
    return clusters.select("cluster").distinct().join(out, "cluster", "left").select("cluster", "id")


def split_suggestions(faces: DataFrame, least: int = 3, share: float = 0.1, apart: float = 0.45, cohesive: float = 0.5) -> DataFrame:
    """(person_id, size_a, size_b, cosine) where a person's faces are two cohesive groups far apart; all faces are judged."""
    sided, centers = halves(faces.where("person_id IS NOT NULL").select("person_id", "id", "v"), "person_id")
    f = half_facts(sided, centers, "person_id")
    enough = F.least("size_a", "size_b") >= F.greatest(F.lit(float(least)), (F.col("size_a") + F.col("size_b")) * share)
    ok = enough & (F.col("cosine") <= apart) & (F.col("mean_a") >= cohesive) & (F.col("mean_b") >= cohesive)
    return f.where(ok).select("person_id", "size_a", "size_b", "cosine")


def consolidated(faces: DataFrame, exclusive: DataFrame, least: float = 0.75, owners: DataFrame | None = None) -> DataFrame:
    """(cluster, into): clusters (id, v, cluster) whose centres are near enough merge, nearest first, into the largest of them.

    exclusive: (node, key), clusters with a key in common never merge, over others neither; owners: (node, owner), nor
    do clusters of two owners. Of equally large clusters the least survives; clusters near none are left out.
    """
    centers = staged(centroids(faces, "cluster"))
    pairs = cosine_pairs(centers.select(F.col("cluster").alias("id"), F.col("centroid").alias("v")), least)
    found = constrained_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("cosine", 9).alias("weight")), exclusive, owners)
    sized = staged(found.join(centers.select(F.col("cluster").alias("node"), "n"), "node"))
    into = sized.groupBy("component").agg(F.max(F.struct("n", (-F.col("node")).alias("back"))).alias("x")).select("component", (-F.col("x.back")).alias("into"))
    return sized.join(into, "component").select(F.col("node").alias("cluster"), "into")
