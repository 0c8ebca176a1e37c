"""Groups of similar nodes that may not hold certain nodes together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.graph import components
from cairnlake.session import drop_staged, staged

#: Edges and keys of a connected part that one task merges in order; larger parts are merged by jobs.
MOST_IN_TASK = 200_000
#: Edges of a larger part that are merged at a time, in order.
BAND = 100_000
#: A file's faces meet each other in so many parts.
PARTS = 8


def exclusive_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, key) rows that keep the two nodes of each pair apart."""
    key = F.concat_ws("|", F.lit("pair"), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    return pairs.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.col(a), F.col(b))).alias("node"), key.alias("key")).distinct()


def cannot_links(faces: DataFrame) -> DataFrame:
    """All pairs (a, b) of the faces (id, file_id) of a file. A face has one file, so rows are made distinct before
    they meet and not after; the first faces of a file are dealt by id, so one that holds many is many tasks' work."""
    f = faces.select("file_id", "id").where("file_id IS NOT NULL AND id IS NOT NULL").distinct()
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    x = f.select("file_id", F.col("id").alias("a"), part.alias("part"))
    y = f.select("file_id", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return x.join(y.hint("shuffle_hash"), ["file_id", "part"]).where("a < b").select("a", "b")


def exclusive_files(faces: DataFrame) -> DataFrame:
    """(node, key, apart) for the faces (id, file_id) of files with several: one key for a file, and how many others it keeps a face from."""
    several = faces.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return faces.join(several, "file_id").select(F.col("id").alias("node"), F.concat(F.lit("file|"), F.col("file_id").cast("string")).alias("key"), (F.col("n") - 1).alias("apart"))


def constrained_components(edges: DataFrame, exclusive: DataFrame, owners: DataFrame | None = None, most: int = MOST_IN_TASK) -> DataFrame:
    """(node, component) for every node of edges (src, dst, weight), its group's least node.

    The groups are those of a pass over all edges in the order (weight falling, least node, greatest node), where an
    edge merges the groups of its ends unless these may not meet: a node with a key of exclusive (node, key) may not
    join another with that key, nor a node of one owner of owners (node, owner) a node of another. So a cannot-link is
    one key of two nodes, and all faces of a file one key, without their pairs.

    Connected parts in which nothing is kept apart are groups as they are. Of the others, a part of `most` edges and
    keys at most is merged in order by one task. Edges of larger ones are taken in bands of BAND by the same order, each
    between the groups that the bands before it left: the pass stands there too, and the connected parts of a band do not
    touch each other, so each is merged by a task. Where a band's part has more than `most` edges and keys it is merged
    in rounds: a group that may meet every other takes its first edge, and two others merge where it is the first edge
    of both. No later edge of the pass can change such a merge, and none before it touches it, so rounds give the groups
    of the pass; edges between groups that may not meet are dropped as soon as they are, and are never wanted again.

    Null ends, loops and edges without weight are left out; of repeated edges the heaviest counts; no edges give no rows.
    """
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("weight").cast("double").alias("w"))
    e = e.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND NOT isnan(w) AND w IS NOT NULL")
    e = staged(e.groupBy("u", "v").agg(F.max("w").alias("w")))
    parts = staged(components(e, "u", "v"))
    keys = exclusive.select("node", F.col("key").cast("string").alias("key")).where("node IS NOT NULL AND key IS NOT NULL").distinct().join(parts, "node")
    several = keys.groupBy("component", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "key")
    keys = staged(keys.join(several, ["component", "key"], "left_semi").select("component", "node", "key"))
    none = parts.select("component", "node", F.lit(None).cast("string").alias("owner")).limit(0)
    own = none if owners is None else owners.select("node", F.col("owner").cast("string").alias("owner")).where("owner IS NOT NULL").distinct().join(parts, "node").select("component", "node", "owner")
    rivals = own.groupBy("component").agg(F.min("owner").alias("x"), F.max("owner").alias("y")).where("x <> y").select("component")
    own = staged(own.join(rivals, "component", "left_semi"))
    contested = staged(keys.select("component").union(own.select("component")).distinct())
    if contested.isEmpty():
        return parts.select("node", "component")

    of = lambda kind, u, v, w, key: [F.lit(kind).cast("int").alias("kind"), u.alias("u"), v.alias("v"), w.alias("w"), key.alias("key")]
    no = lambda t: F.lit(None).cast(t)
    by_part = parts.join(contested, "component").withColumnRenamed("node", "u")
    node = dict(parts.dtypes)["node"]
    rows = by_part.join(e, "u").select("component", *of(0, F.col("u"), F.col("v"), F.col("w"), no("string")))
    rows = rows.union(keys.select("component", *of(1, F.col("node"), no(node), no("double"), F.col("key"))))
    rows = staged(rows.union(own.select("component", *of(2, F.col("node"), no(node), no("double"), F.col("owner")))))
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = staged(sizes.where(F.col("n") > most).select("component"))
    out = parts.join(contested, "component", "left_anti").select("node", "component")
    out = out.union(rows.join(large, "component", "left_anti").groupBy("component").applyInPandas(_in_order, f"node {node}, component {node}"))
    if not large.isEmpty():
        out = out.union(_in_bands(parts.join(large, "component", "left_semi").select("node"), rows.join(large, "component", "left_semi"), most))
    return out


def _in_bands(nodes: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(node, component): parts merged band by band of their edges in order; a band is a few written tables, of the groups that it touches."""
    groups = staged(nodes.select("node", F.col("node").alias("g")))
    keys, own = (staged(rows.where(f"kind = {k}").select(F.col("u").alias("node"), "key")) for k in (1, 2))
    edges = rows.where("kind = 0").select("u", "v", "w")
    # bounds of bands from the counts of weights; equal weights are parted by their nodes
    ordered = staged(edges.repartitionByRange(F.col("w").desc(), "u", "v").sortWithinPartitions(F.col("w").desc(), "u", "v").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((x.p, x.n) for x in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    spark = nodes.sparkSession
    starts = spark.createDataFrame(before or [(0, 0)], "p bigint, start bigint")
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    banded = staged(ordered.withColumn("p", part).join(F.broadcast(starts), "p").select("u", "v", "w", place.alias("k"), F.floor(place / BAND).alias("band")))
    for band in range(-(-total // BAND)):
        of = lambda c, x: groups.select(F.col("node").alias(c), F.col("g").alias(x))  # noqa: E731, B023
        live = banded.where(F.col("band") == band).join(of("u", "x"), "u").join(of("v", "y"), "v").where("x <> y")
        # the first of several edges of two groups decides; its place in the pass stands for its weight
        live = staged(live.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg((-F.min("k")).cast("double").alias("w")))
        linked = staged(components(live, "u", "v"))
        held = lambda t: t.join(of("node", "u"), "node").select("u", "key").distinct().join(linked.withColumnRenamed("node", "u"), "u")  # noqa: E731, B023
        null = lambda t: F.lit(None).cast(t)
        node = dict(linked.dtypes)["node"]
        all_ = live.join(linked.withColumnRenamed("node", "u"), "u").select("component", F.lit(0).alias("kind"), "u", "v", "w", null("string").alias("key"))
        for kind, t in ((1, keys), (2, own)):
            all_ = all_.union(held(t).select("component", F.lit(kind).alias("kind"), "u", null(node).alias("v"), null("double").alias("w"), "key"))
        all_ = staged(all_)
        large = staged(all_.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component"))
        merged = all_.join(large, "component", "left_anti").groupBy("component").applyInPandas(_in_order, f"node {node}, component {node}")
        if not large.isEmpty():
            merged = merged.union(_in_rounds(linked.join(large, "component", "left_semi").select("node"), all_.join(large, "component", "left_semi")))
        merged = merged.select(F.col("node").alias("g"), F.col("component").alias("h"))
        after = staged(groups.join(merged, "g", "left").select("node", F.coalesce("h", "g").alias("g")))
        for t in (groups, live, linked, all_, large):
            drop_staged(t)
        groups = after
    for t in (keys, own, ordered, banded):
        drop_staged(t)
    return groups.select("node", F.col("g").alias("component"))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """One part merged by a pass over its edges in order."""
    edges = rows[rows.kind == 0].sort_values(["w", "u", "v"], ascending=[False, True, True])
    parent = {x: x for x in pd.concat([edges.u, edges.v]).unique().tolist()}
    keys: dict = {x: set() for x in parent}
    for u, key in zip(*(rows.loc[rows.kind == 1, c].tolist() for c in ("u", "key")), strict=True):
        keys[u].add(key)
    owner = dict(zip(*(rows.loc[rows.kind == 2, c].tolist() for c in ("u", "key")), strict=True))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(edges.u.tolist(), edges.v.tolist(), strict=True):
        a, b = root(u), root(v)
        if a == b or not keys[a].isdisjoint(keys[b]) or (a in owner and b in owner and owner[a] != owner[b]):
            continue
        if len(keys[a]) < len(keys[b]):
            a, b = b, a
        parent[b] = a
        keys[a] |= keys.pop(b)
        if b in owner:
            owner[a] = owner.pop(b)
    found = pd.DataFrame({"node": list(parent), "root": [root(x) for x in parent]})
    return pd.DataFrame({"node": found.node, "component": found.groupby("root").node.transform("min")})


def _in_rounds(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component): parts merged by rounds of merges that no other edge can change; a round is a few written tables."""
    groups = staged(nodes.select("node", F.col("node").alias("g")))
    live = rows.where("kind = 0").select(F.col("u").alias("x"), F.col("v").alias("y"), F.struct((-F.col("w")).alias("w"), "u", "v").alias("first"))
    keys, own = (rows.where(f"kind = {k}").select(F.col("u").alias("g"), "key") for k in (1, 2))
    keys, own = staged(keys), staged(own)
    pair = [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]
    while True:
        live = live.where("x <> y").select(*pair, "first").groupBy("x", "y").agg(F.min("first").alias("first"))
        apart = live.join(keys.withColumnRenamed("g", "x"), "x").join(keys.withColumnRenamed("g", "y"), ["y", "key"]).select("x", "y")
        apart = apart.union(live.join(own.withColumnsRenamed({"g": "x", "key": "o"}), "x").join(own.withColumnsRenamed({"g": "y", "key": "p"}), "y").where("o <> p").select("x", "y"))
        live = staged(live.join(apart.distinct(), ["x", "y"], "left_anti"))
        if live.isEmpty():
            break
        ends = live.union(live.select(F.col("y").alias("x"), F.col("x").alias("y"), "first"))
        best = ends.groupBy("x").agg(F.min(F.struct("first", "y")).alias("b")).select("x", F.col("b.y").alias("y"), F.col("b.first").alias("first"))
        held = keys.select(F.col("g").alias("x")).union(own.select(F.col("g").alias("x"))).distinct()
        free = best.join(held, "x", "left_anti").select("x", "y")
        mutual = best.join(best.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("first").alias("f")), ["x", "y"]).where("first = f AND x < y").select("x", "y")
        merged = staged(components(free.union(mutual), "x", "y"))
        moved = lambda df, c: df.join(merged.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")  # noqa: E731, B023
        after = staged(moved(groups, "g")), staged(moved(moved(live, "x"), "y").select("x", "y", "first")), staged(moved(keys, "g").select("g", "key").distinct()), staged(moved(own, "g").select("g", "key").distinct())
        for t in (groups, live, keys, own, merged):
            drop_staged(t)
        groups, live, keys, own = after
    return groups.select("node", F.col("g").alias("component"))
