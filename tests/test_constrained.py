"""Constrained components against a pass over the edges, and what is built on them."""

import random

import numpy as np
import pytest

from cairnlake.operators import identity
from cairnlake.operators.constrained import MOST_IN_TASK, constrained_components, exclusive_pairs

EDGES, KEYS, OWNERS = "src long, dst long, weight double", "node long, key string", "node long, owner long"


def plain(edges, keys, owners=()):
    """{node: group} by a pass over all edges; groups are plain sets."""
    weight = {}
    for u, v, w in edges:
        if u is not None and v is not None and u != v and w is not None and w == w:
            p = (min(u, v), max(u, v))
            weight[p] = max(w, weight.get(p, w))
    group = {x: {x} for p in weight for x in p}
    key, owner = {}, dict(owners)
    for n, k in keys:
        key.setdefault(n, set()).add(k)
    for (u, v), _ in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        a, b = group[u], group[v]
        if a is b or any(key.get(x, set()) & key.get(y, set()) for x in a for y in b) or len({owner[x] for x in a | b if x in owner}) > 1:
            continue
        a |= b
        for x in b:
            group[x] = a
    return {x: min(g) for x, g in group.items()}


def run(spark, edges, keys, owners=None, most=MOST_IN_TASK):
    own = None if owners is None else spark.createDataFrame(owners, OWNERS)
    return {r.node: r.component for r in constrained_components(spark.createDataFrame(edges, EDGES), spark.createDataFrame(keys, KEYS), own, most).collect()}


@pytest.mark.parametrize("most", [0, 150, MOST_IN_TASK])
def test_groups_are_those_of_the_ordered_pass(spark, most):
    edges, keys, owners = [], [], []
    for seed, m in enumerate((0, 12, 30, 60)):  # apart from one another, with more and more keys
        r, n, o = random.Random(seed), 60, 1000 * seed
        edges += [(o + r.randrange(n), o + r.randrange(n), r.choice([0.5, 0.6, r.random()])) for _ in range(110)]
        keys += [(o + r.randrange(n), f"k{r.randrange(25)}") for _ in range(m)]
        owners += [(o + x, r.randrange(3)) for x in r.sample(range(n), 8 * (seed % 2))]
    assert run(spark, edges, keys, owners, most) == plain(edges, keys, owners)


def test_a_pair_stays_apart_over_a_third_node(spark):
    # 0 and 1 may not meet: 2 goes to the nearer, 3 follows; the tie goes to the lesser node
    edges = [(0, 2, 0.9), (1, 2, 0.95), (2, 3, 0.8), (5, 4, 0.7), (5, 6, 0.7)]
    pairs = spark.createDataFrame([(0, 1), (6, 4), (3, 3)], "a long, b long")
    got = {r.node: r.component for r in constrained_components(spark.createDataFrame(edges, EDGES), exclusive_pairs(pairs)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_odd_edges(spark):
    nan = float("nan")
    edges = [(1, 1, 0.5), (None, 2, 0.5), (2, None, 0.5), (3, 4, None), (3, 4, nan), (5, 6, 0.1), (6, 5, 0.4), (6, 7, 0.2)]
    keys = [(5, "a"), (7, "a"), (None, "a"), (99, "a"), (5, None)]
    assert run(spark, edges, keys) == plain(edges, [k for k in keys if None not in k]) == {5: 5, 6: 5, 7: 7}
    assert run(spark, [], keys) == {}


def test_clusters_hold_no_two_faces_of_a_file(spark):
    rng = np.random.default_rng(1)
    people = rng.normal(size=(6, 16))
    faces = [(i, (people[i % 6] + 0.35 * rng.normal(size=16)).tolist()) for i in range(150)]
    files = [(i, f"f{i // 2 % 60}") for i, _ in faces]  # two people in a file, and some files twice over
    df = spark.createDataFrame(faces, "id long, v array<double>")
    got = {r.id: r.cluster for r in identity.cluster(df, core=0.6, assign=0.4, margin=0.0, k=20, exclusive=spark.createDataFrame(files, KEYS)).collect()}
    assert len(got) == 150 and len({(got[i], f) for i, f in files}) == 150
    none = {r.id: r.cluster for r in identity.cluster(df, core=0.6, assign=0.4, margin=0.0, k=20).collect()}
    free = {r.id: r.cluster for r in identity.cluster(df, core=0.6, assign=0.4, margin=0.0, k=20, exclusive=spark.createDataFrame([], KEYS)).collect()}
    assert none == free


def test_consolidation_keeps_blocked_clusters_apart_and_the_largest_name(spark):
    c = np.eye(4)[0]
    near = lambda x, y: (c + [0, x, y, 0]).tolist()
    faces = [(i, v, k) for i, (v, k) in enumerate([(near(0, 0), 0)] * 2 + [(near(0.1, 0), 1)] * 3 + [(near(0.06, 0), 2)] * 5 + [(near(0.0, 3), 3)])]
    df = spark.createDataFrame(faces, "id long, v array<double>, cluster long")
    pairs = exclusive_pairs(spark.createDataFrame([(0, 1)], "a long, b long"))
    assert {r.cluster: r["into"] for r in identity.consolidated(df, pairs).collect()} == {0: 0, 1: 2, 2: 2}
    owners = spark.createDataFrame([(1, 7), (2, 8)], OWNERS)
    assert {r.cluster: r["into"] for r in identity.consolidated(df, pairs, owners=owners).collect()} == {0: 2, 1: 1, 2: 2}


def test_free_clusters_inherit_by_their_centres(spark):
    e = np.eye(5)
    priors = [(10, f) for f in (1, 2, 3)] + [(20, f) for f in (4, 5, 6, 7, 8)] + [(30, 9), (40, 10), (50, 11)]
    clusters = [(1, 1, 1), (1, 2, 1), (2, 4, 4), (3, 21, 21), (4, 22, 22), (5, 23, 23)]
    of_priors = [(10, e[0], 0.5), (20, e[1], 0.7), (30, e[2], 0.6), (40, e[2] * 0.9 + e[3] * 0.436, 0.6), (50, e[4], float("nan"))]
    of_clusters = [(1, e[1]), (2, e[4]), (3, e[1] * 0.8 + e[2] * 0.6), (4, e[2]), (5, e[3])]
    frame = lambda rows, names: spark.createDataFrame([tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in r) for r in rows], names)
    none = spark.createDataFrame([], "cluster long, id long")
    anchors = frame(of_priors, "id long, centroid array<double>, radius double"), frame(of_clusters, "cluster long, centroid array<double>")
    got = identity.inherited_ids(frame(priors, "id long, face long"), frame(clusters, "cluster long, face long, representative long"), none, none.select("id"), anchors)
    # 10 by overlap; 30 and 4 are one vector; then 20 and 3 with 0.8; 40 lies within 0.436 of 5 alone, below its radius
    assert {r.cluster: r.id for r in got.collect()} == {1: 10, 2: None, 3: 20, 4: 30, 5: None}


def test_anchors_of_clusters(spark):
    rows = [(i, [1.0, 0.1 * i], 1) for i in range(10)] + [(20, [0.0, 2.0], 2), (30, [1.0, 0.0], 3), (31, [0.0, 1.0], 3)]
    got = {r.cluster: (r.centroid, r.radius) for r in identity.identity_anchors(spark.createDataFrame(rows, "id long, v array<double>, cluster long")).collect()}
    x = np.array([v for _, v, c in rows if c == 1])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))
    assert np.allclose(got[1][0], m) and abs(got[1][1] - min(0.85, sorted(x @ m)[1])) < 1e-9 and got[2][1] == 0.5 and abs(got[3][1] - 0.5**0.5) < 1e-9
