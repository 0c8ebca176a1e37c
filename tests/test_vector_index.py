"""The written vector index: changes, rebuilds, recall and lost writers."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from cairnlake.operators import vector_index as V


def exact(live, queries, k):
    """{query: ids} by comparing with all."""
    ids = np.array(sorted(live))
    x = np.array([live[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in queries.items():
        s = x @ (np.array(v) / np.linalg.norm(v))
        s[ids == q] = -2
        out[q] = set(ids[np.argsort(-s, kind="stable")[:k]].tolist())
    return out


def recall(index, live, queries, spark, k=10):
    rows = index.search(spark.createDataFrame([(q, v) for q, v in queries.items()], "id long, v array<double>"), k).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query"], set()).add(r.id)
    assert all(len(g) == k and g <= set(live) and q not in g for q, g in got.items()) and set(got) == set(queries)
    want = exact(live, queries, k)
    return np.mean([len(got[q] & want[q]) / k for q in queries])


def test_changes_and_rebuilds_keep_the_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(25, 12))
    make = lambda n, at: {at + i: (centers[i % 25] + 0.6 * rng.normal(size=12)).tolist() for i in range(n)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    live = make(3000, 0)
    index = V.VectorIndex(spark, str(tmp_path / "i"), exact=0)
    assert index.manifest() is None and index.search(frame(make(1, 9))).collect() == []
    first = index.build(frame(live))
    queries = {i: live[i] for i in range(0, 3000, 60)} | make(5, 90_000)
    assert first.n == 3000 and 0 < first.probes < 54 and recall(index, live, queries, spark) >= 0.9
    added, changed, gone = make(120, 10_000), {i: (-np.array(live[i])).tolist() for i in range(1, 200, 4)}, list(range(0, 240, 3))
    m = index.update(frame(added | changed | {i: None for i in gone}))
    live = {i: v for i, v in (live | added | changed).items() if i not in gone}
    assert m.lists == first.lists and len(m.changes) == 1
    assert index.pending() == len(added) + 2 * len(set(changed) - set(gone)) + len(gone) and recall(index, live, queries, spark) >= 0.9
    # what was removed comes back, what was added goes
    back = {0: added[10_000], 10_001: None}
    index.update(frame(back))
    live = {i: v for i, v in (live | back).items() if v is not None}
    assert {r.id for r in index.vectors().collect()} == set(live) and recall(index, live, queries, spark) >= 0.9
    # more than a tenth is pending: built anew
    more = make(90, 20_000)
    m = index.update(frame(more))
    live |= more
    assert m.lists != first.lists and m.changes == () and m.n == len(live) and index.pending() == 0 and recall(index, live, queries, spark) >= 0.9


def test_writers_and_odd_rows(spark, tmp_path):
    index = V.VectorIndex(spark, str(tmp_path / "j"))
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (None, [1.0, 1.0]), (5, [0.0, 0.0])]
    m = index.update(spark.createDataFrame(rows, "id long, v array<double>"))
    assert m.n == 3 and {r.id for r in index.vectors().collect()} == {1, 2, 5}
    # a writer that is lost leaves nothing valid
    (tmp_path / "j" / "manifests" / "m-000000007").mkdir()
    assert index.manifest() == m
    with pytest.raises(AnalysisException):
        index._commit(m)
    empty = V.VectorIndex(spark, str(tmp_path / "k"))
    assert empty.build(spark.createDataFrame([], "id long, v array<double>")).n == 0
    assert empty.search(spark.createDataFrame([(1, [1.0])], "id long, v array<double>")).collect() == [] and empty.vectors().count() == 0


def test_lists_and_changes_keep_doubles(spark, tmp_path):
    rows = [(i, [1.0, 1e-9 * i]) for i in range(1, 5)]
    index = V.VectorIndex(spark, str(tmp_path / "d"), exact=2**62)
    index.build(spark.createDataFrame(rows[:2], "id long, v array<double>"))
    index.update(spark.createDataFrame(rows[2:], "id long, v array<double>"))
    assert {r.id: r.v[1] for r in index.vectors().collect()} == pytest.approx({i: v[1] for i, v in rows}, rel=1e-12)
