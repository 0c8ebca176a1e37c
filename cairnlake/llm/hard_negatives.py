"""Hard negatives by a dual-tree search over integer vectors: exact results for all anchors and all candidates.

Two trees of balls, one over the anchors and one over all rows, have cells about pivots (fitted on SAMPLE rows at most,
256 pivots at most) and leaves, made by parting a cell's rows again and again; a cell of many rows, a third of all say,
is dealt to chunks first. For balls (c, r) and (d, s) every inner product of their rows lies within
|c|s + |d|r + rs of <c, d>. A search carries needs: of an anchor, the scores that may still enter its list. It first
scores each anchor leaf against the leaves of a beam down the other tree, which raises the needs to the last place of
the lists found so far; then pairs of cells, and of those that remain pairs of leaves, whose interval misses all needs
of their anchors fall with all anchors below them. Leaf pairs that remain are scored exactly, all their rows by all,
in integers.

Positives are the best rows of an anchor's label; each gives a band of scores, which is a need for rows of other labels.

Defined results: rows with a null key, label or vector, or with a null component, take no part; a vector with fewer
components counts as followed by zeros; equal scores go to the smaller key, then to either row; repeated keys are
separate rows, a row is never its own positive; an empty table, or no anchors, gives no rows; scores must fit a long;
other columns are ignored.

A task holds a chunk of CHUNK rows or two leaves. Where balls overlap fully, as for random directions,
nothing falls and the work is anchors x rows, a leaf of anchors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.llm.common import bounded_batches
from cairnlake.session import drop_staged, staged, table

SAMPLE, CHUNK = 16_384, 8_192
#: Rows of a leaf at most: of anchors, whose balls decide what falls, and of all rows.
LEAF_OF_ANCHORS, LEAF = 64, 256
#: Rows for each pivot, pivots at most, and nodes of the other tree that the first pass opens for each node.
CELL, MOST_CELLS, BEAM = 2_048, 256, 4
FAR = 1 << 62
LEAVES_SQL = (
    "cell bigint, chunk bigint, leaf bigint, mask bigint, only bigint, center binary, radius double, cell_radius double,"
    " rows binary, keys binary, labels binary, vectors binary, wide boolean"
)


def _matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones followed by zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres of a bounded sample, by some rounds of k-means from spread rows."""
    x = sample.astype(np.float64)
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(6):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1) - 2 * x @ centers.T, axis=1)


def _cells(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _nearest(_matrix(batch.column("vector"), centers.shape[1]).astype(np.float64), centers) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=[*batch.schema.names, "cell"])

    return run


def _halved(x: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The rows in leaves of `most`, parted by the nearer of two far rows, or in halves along that line where one part is small."""
    todo = [rows]
    while todo:
        some = todo.pop()
        if len(some) <= most:
            yield some
            continue
        own = x[some]
        far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
        along = (own - (far + other) / 2) @ (far - other)
        order = np.argsort(along, kind="stable")
        cut = int((along < 0).sum())
        cut = cut if len(some) // 8 <= cut <= len(some) - len(some) // 8 and cut else len(some) // 2
        todo += [some[order[:cut]], some[order[cut:]]]


def _leaves(centers: np.ndarray, by_label: bool, most: int):
    """A chunk's leaves of `most` rows. by_label: a label's rows share leaves with others only where they are few."""

    def run(chunk: pa.Table) -> pa.Table:
        x = _matrix(chunk.column("vector"), centers.shape[1])
        real = x.astype(np.float64)
        cell, number = chunk.column("cell")[0].as_py(), chunk.column("chunk")[0].as_py()
        rows, keys, labels = (chunk.column(c).to_numpy() for c in ("row", "key", "label"))
        groups = [np.arange(len(rows))]
        if by_label:
            distinct, of, n = np.unique(labels, return_inverse=True, return_counts=True)
            groups = [np.flatnonzero(of == i) for i in np.flatnonzero(n > most // 4)] + [np.flatnonzero(n[of] <= most // 4)]
        out = {c: [] for c in (s.split()[0] for s in LEAVES_SQL.split(", "))}
        for g in groups:
            for some in _halved(real, g, most):
                if not len(some):
                    continue
                some = some[np.argsort(keys[some], kind="stable")]
                own, mean = np.unique(labels[some]), real[some].mean(axis=0)
                wide = bool(np.abs(x[some]).max(initial=0) >= 1 << 31)
                mask = int(np.bitwise_or.reduce(np.uint64(1) << (own % 64).astype(np.uint64)).view(np.int64))
                far = lambda c: float(np.sqrt(((real[some] - c) ** 2).sum(axis=1)).max())  # noqa: E731, B023
                values = (
                    cell, number, (number << 16) + len(out["leaf"]), mask, int(own[0]) if len(own) == 1 else None, mean.tobytes(), far(mean), far(centers[cell]),
                    rows[some].tobytes(), keys[some].tobytes(), labels[some].tobytes(), x[some].astype(np.int64 if wide else np.int32).tobytes(), wide,
                )
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
        kinds = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.table({c: pa.array(out[c], kinds[k]) for c, k in (s.split() for s in LEAVES_SQL.split(", "))})

    return run


class Balls:
    """Nodes of a level as arrays: centers, radii, labels as bits, and the label of nodes that have one alone."""

    def __init__(self, centers: np.ndarray, radius: np.ndarray, mask: np.ndarray, only: np.ndarray) -> None:
        self.centers, self.radius, self.mask, self.only = centers, radius, mask, only

    @staticmethod
    def of(nodes: list[dict]) -> Balls:
        only = np.array([np.nan if n["only"] is None else n["only"] for n in nodes], float)
        return Balls(np.stack([np.frombuffer(n["center"], np.float64) for n in nodes]), np.array([n["radius"] for n in nodes]), np.array([n["mask"] for n in nodes], np.int64), only)

    def against(self, other: Balls, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(possible, mid, reach) of all pairs of nodes: whether they have rows to compare, and the interval of their inner products."""
        possible = (self.mask[:, None] & other.mask) != 0 if same else ~(self.only[:, None] == other.only)
        mid, long, wide = self.centers @ other.centers.T, np.linalg.norm(self.centers, axis=1)[:, None], np.linalg.norm(other.centers, axis=1)
        reach = long * other.radius + wide * self.radius[:, None] + self.radius[:, None] * other.radius
        return possible, mid, reach * (1 + 1e-9) + 1e-9 * long * wide + 1e-3  # and what rounding may take


class Tree:
    """Cells, chunks and leaves over rows (row, key, label, vector), written."""

    def __init__(self, rows: DataFrame, n: int, dims: int, by_label: bool, most: int) -> None:
        k = max(1, min(MOST_CELLS, n // CELL))
        sample = rows.select("vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
        centers = _pivots(_matrix(sample.column("vector"), dims), k)
        placed = staged(rows.select("row", "key", "label", "vector").mapInArrow(_cells(centers), "row bigint, key bigint, label bigint, vector array<bigint>, cell bigint"))
        parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("parts"))  # a row for each pivot
        chunk = F.shiftleft("cell", 32) + F.pmod(F.xxhash64("row"), F.col("parts"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("chunk", chunk)
        self.leaves = staged(dealt.groupBy("chunk").applyInArrow(_leaves(centers, by_label, most), LEAVES_SQL))
        drop_staged(placed)
        node = F.struct("leaf", "center", "radius", "mask", "only")
        #: The leaves of each chunk, CHUNK rows and so some dozens of leaves at most.
        self.chunks = staged(self.leaves.groupBy("cell", "chunk").agg(F.collect_list(node).alias("nodes")))
        one = F.when(F.count("only") == F.count(F.lit(1)), F.when(F.min("only") == F.max("only"), F.min("only")))
        # a row for each pivot
        found = self.leaves.groupBy("cell").agg(F.bit_or("mask").alias("mask"), one.alias("only"), F.max("cell_radius").alias("radius")).orderBy("cell").collect()
        self.cells = [r.cell for r in found]
        self.balls = Balls.of([r.asDict() | {"center": centers[r.cell].tobytes()} for r in found])


def _opened(same: bool, beam: int | None):
    """Pairs of chunks to pairs of their leaves (a, c, mid): those whose interval meets the needs of the anchor leaf, or its `beam` nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, bounds in zip(batch.column("a_nodes"), batch.column("c_nodes"), batch.column("bounds"), strict=True):
                left, right = left.as_py(), right.as_py()
                possible, mid, reach = Balls.of(left).against(Balls.of(right), same)
                if beam is None:
                    needs = {b["leaf"]: (b["least"], b["most"]) for b in bounds.as_py()}
                    least, most = (np.array([needs.get(n["leaf"], (FAR, -FAR))[i] for n in left], float)[:, None] for i in (0, 1))
                    possible &= (mid + reach >= least) & (mid - reach <= most)
                else:
                    order = np.argsort(-np.where(possible, mid, -np.inf), axis=1, kind="stable")[:, :beam]
                    near = np.zeros_like(possible)
                    np.put_along_axis(near, order, True, axis=1)
                    possible &= near
                i, j = np.nonzero(possible)
                a, c = (np.array([n["leaf"] for n in nodes], np.int64) for nodes in (left, right))
                yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(c[j]), pa.array(mid[i, j])], names=["a", "c", "mid"])

    return run


def leaf_pairs(anchors: Tree, others: Tree, same: bool, bounds: DataFrame | None = None) -> DataFrame:
    """(a, c, mid): pairs of leaves that may hold what is needed, by bounds (leaf, chunk, cell, least, most) of the anchors' leaves; without bounds those of a beam."""
    spark = anchors.leaves.sparkSession
    possible, mid, reach = anchors.balls.against(others.balls, same)  # 256 by 256 at most
    if bounds is None:
        order = np.argsort(-np.where(possible, mid, -np.inf), axis=1, kind="stable")[:, :BEAM]
        near = np.zeros_like(possible)
        np.put_along_axis(near, order, True, axis=1)
        possible &= near
    else:
        needs = {r.cell: (r.least, r.most) for r in bounds.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()}
        least, most = (np.array([needs.get(c, (FAR, -FAR))[i] for c in anchors.cells], float)[:, None] for i in (0, 1))
        possible &= (mid + reach >= least) & (mid - reach <= most)
    i, j = np.nonzero(possible)
    cells = spark.createDataFrame(pa.table({"a_cell": pa.array(np.array(anchors.cells, np.int64)[i]), "c_cell": pa.array(np.array(others.cells, np.int64)[j])}))
    of_chunk = F.collect_list(F.struct("leaf", "least", "most")).alias("bounds")
    left = anchors.chunks.select(F.col("cell").alias("a_cell"), "chunk", F.col("nodes").alias("a_nodes"))
    left = left.withColumn("bounds", F.lit(None).cast("array<struct<leaf:bigint,least:bigint,most:bigint>>")) if bounds is None else left.join(bounds.groupBy("chunk").agg(of_chunk), "chunk")
    right = others.chunks.select(F.col("cell").alias("c_cell"), F.col("nodes").alias("c_nodes"))
    met = cells.join(left, "a_cell").join(right, "c_cell").select("a_nodes", "c_nodes", "bounds")
    found = met.mapInArrow(_opened(same, BEAM if bounds is None else None), "a bigint, c bigint, mid double")
    if bounds is not None:
        return found
    place = Window.partitionBy("a").orderBy(F.col("mid").desc(), "c")
    return found.withColumn("at", F.row_number().over(place)).where(F.col("at") <= BEAM).drop("at")


def _scored(dims: int, same: bool, take: int):
    """Leaf pairs to the best rows of each need, every row of one by every row of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in (dict(zip(batch.schema.names, v, strict=True)) for v in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)):
                (ra, la, xa), (rc, lc, xc) = ((*(np.frombuffer(pair[f"{t}_{n}"], np.int64) for n in ("rows", "labels")), np.frombuffer(pair[f"{t}_vectors"], np.int64 if pair[f"{t}_wide"] else np.int32).reshape(-1, dims)) for t in "ac")
                needs = pair["needs"]
                of = {r: i for i, r in enumerate(ra.tolist())}
                at = np.array([of[x["row"]] for x in needs])
                slot, least, most = (np.array([x[n] for x in needs], np.int64) for n in ("slot", "least", "most"))
                exact = int(np.abs(xa).max(initial=0)) * int(np.abs(xc).max(initial=0)) * max(1, dims) < 1 << 53
                scores = (xa.astype(np.float64) @ xc.T.astype(np.float64)).astype(np.int64) if exact else xa.astype(np.int64) @ xc.T.astype(np.int64)
                scores = scores[at]
                fits = (la[at][:, None] == lc) == same
                fits &= (ra[at][:, None] != rc) & (scores >= least[:, None]) & (scores <= most[:, None])
                found: list[tuple[int, np.ndarray]] = []
                for i in np.flatnonzero(fits.any(axis=1)).tolist():
                    some = np.flatnonzero(fits[i])  # in the order of keys
                    found.append((i, some[np.argsort(-scores[i, some], kind="stable")[:take]]))
                if found:
                    i, j = np.repeat([i for i, _ in found], [len(s) for _, s in found]), np.concatenate([s for _, s in found])
                    keys = np.frombuffer(pair["c_keys"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ra[at[i]], slot[i], scores[i, j], rc[j], keys[j])], names=["row", "slot", "score", "other", "other_key"])

    return run


def best(rows: DataFrame, take: int) -> DataFrame:
    """The first `take` rows of each need with their rank, by score, then key."""
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "other_key", "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def scored(pairs: DataFrame, anchors: Tree, others: Tree, needs: DataFrame, dims: int, same: bool, take: int) -> DataFrame:
    """(row, slot, score, other, other_key, rank): exact results of leaf pairs (a, c) for needs (leaf, row, slot, least, most)."""
    data = lambda t, x: x.leaves.select(F.col("leaf").alias(t), *(F.col(n).alias(f"{t}_{n}") for n in ("rows", "keys", "labels", "vectors", "wide")))
    # a leaf has LEAF_OF_ANCHORS rows at most
    of_leaf = needs.groupBy(F.col("leaf").alias("a")).agg(F.collect_list(F.struct("row", "slot", "least", "most")).alias("needs"))
    joined = pairs.select("a", "c").join(of_leaf, "a").join(data("a", anchors).drop("a_keys"), "a").join(data("c", others), "c").drop("a", "c")
    return best(joined.mapInArrow(_scored(dims, same, take), "row bigint, slot bigint, score bigint, other bigint, other_key bigint"), take)


def search(anchors: Tree, others: Tree, needs: DataFrame, dims: int, same: bool, take: int, counts: dict | None = None) -> DataFrame:
    """The first `take` rows of each need (leaf, row, slot, least, most) among rows of the same label, or of others.

    counts: gets the leaf pairs there are and those scored, for reports.
    """
    needs = staged(needs)
    first = staged(scored(staged(leaf_pairs(anchors, others, same)), anchors, others, needs, dims, same, take))
    full = first.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") == take).drop("n")
    needs = staged(needs.join(full, ["row", "slot"], "left").select("leaf", "row", "slot", F.greatest("least", F.coalesce("last", "least")).alias("least"), "most"))
    bounds = needs.groupBy("leaf").agg(F.min("least").alias("least"), F.max("most").alias("most")).join(anchors.leaves.select("leaf", "chunk", "cell"), "leaf")
    pairs = staged(leaf_pairs(anchors, others, same, staged(bounds)))
    if counts is not None:
        counts |= {"pairs": anchors.leaves.count() * others.leaves.count(), "scored": pairs.count()}
    return staged(scored(pairs, anchors, others, needs, dims, same, take))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, counts: dict | None = None) -> DataFrame:
    """Hard negatives of the rows (key, label, vector of integers) for which `anchor` holds.

    (anchor_key, positive_key, rank, negative_key, positive_score, negative_score): of each anchor the first rows of its
    label, and of each of them the first rows of other labels with low * positive <= 100 * negative <= high * positive.
    """
    real = "key IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"
    rows = staged(vectors.select(F.col("key").cast("bigint"), F.col("label").cast("bigint"), F.col("vector").cast("array<bigint>"), anchor.alias("anchor")).where(real).withColumn("row", F.monotonically_increasing_id()))
    n, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector"))).first()
    dims = max(1, dims or 0)
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], "anchor_key bigint, positive_key bigint, rank int, negative_key bigint, positive_score bigint, negative_score bigint")
    a, c = Tree(rows.where("anchor"), n_anchors, dims, False, LEAF_OF_ANCHORS), Tree(rows, n, dims, True, LEAF)
    of_row = _rows_of(a.leaves)
    far = lambda x: F.lit(x).cast("bigint")
    needs = of_row.select("leaf", "row", far(0).alias("slot"), far(-FAR).alias("least"), far(FAR).alias("most"))
    near = search(a, c, needs, dims, True, positives, counts.setdefault("positives", {}) if counts is not None else None)
    band = (F.ceil(F.lit(low) * F.col("score").cast("decimal(20,0)") / 100), F.floor(F.lit(high) * F.col("score").cast("decimal(20,0)") / 100))
    needs = near.join(of_row, "row").select("leaf", "row", F.col("rank").cast("bigint").alias("slot"), band[0].cast("bigint").alias("least"), band[1].cast("bigint").alias("most")).where("least <= most")
    hard = search(a, c, needs, dims, False, negatives, counts.setdefault("negatives", {}) if counts is not None else None)
    of_positive = near.select("row", F.col("rank").cast("bigint").alias("slot"), F.col("other_key").alias("positive_key"), F.col("score").alias("positive_score"))
    return (
        hard.join(of_positive, ["row", "slot"]).join(of_row.select("row", F.col("key").alias("anchor_key")), "row")
        .select("anchor_key", "positive_key", "rank", F.col("other_key").alias("negative_key"), "positive_score", F.col("score").alias("negative_score"))
    )


def _rows_of(leaves: DataFrame) -> DataFrame:
    """(leaf, row, key) of all rows in leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, rows, keys in zip(*(batch.column(c).to_pylist() for c in ("leaf", "rows", "keys")), strict=True):
                r, k = np.frombuffer(rows, np.int64), np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), leaf)), pa.array(r), pa.array(k)], names=["leaf", "row", "key"])

    return leaves.select("leaf", "rows", "keys").mapInArrow(run, "leaf bigint, row bigint, key bigint")


def scaled(vectors: DataFrame, key: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """(key, label, vector) with each component x as floor(scale * x); rows with a component that is not finite have a null vector."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = ~F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    # a null component makes the test null, and so the vector
    return vectors.select(F.col(f"`{key}`").alias("key"), label.alias("label"), F.when(finite, F.transform(x, lambda v: F.floor(v * scale))).alias("vector"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor of `embeddings` and each of its positives, the hardest rows of other labels."""
    bounded_batches(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label), F.coalesce(F.col("key") % 100 == 0, F.lit(False)))
    return found.select(F.col("anchor_key").alias("anchor_id"), F.col("positive_key").alias("positive_id"), "rank", F.col("negative_key").alias("negative_id"), "positive_score", "negative_score")


OP11_SQL = """
WITH real AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score
  FROM real a JOIN real o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
