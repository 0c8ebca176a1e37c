"""Hard negatives against all pairs."""

import duckdb
import numpy as np
import pyspark.sql.functions as F
import pytest

from cairnlake.llm import hard_negatives as hn

ROWS = "key long, label int, vector array<bigint>"


def plain(rows, is_anchor, low=80):
    """rows: (key, label, vector); the rows of mine() by comparing each anchor with every row."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    dims = max([len(r[2]) for r in rows], default=0)
    x = [list(r[2]) + [0] * (dims - len(r[2])) for r in rows]
    out = []
    for i, (key, label, _) in enumerate(rows):
        if not is_anchor(key):
            continue
        score = [sum(p * q for p, q in zip(x[i], y, strict=True)) for y in x]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][1] == label][:5]:
            hard = [j for j in order if rows[j][1] != label and low * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(key, rows[p][0], k + 1, rows[j][0], score[p], score[j]) for k, j in enumerate(hard)]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_and_sql_are_the_plain_computation(spark, sf):
    got = hn.op11_hard_negatives(spark, sf)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    rows = sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert rows == sorted(con.execute(hn.OP11_SQL).fetchall()) and rows
    real = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows == sorted(plain(real, lambda k: k % 100 == 0))


def clustered(n, seed, labels=4, groups=30, dims=8):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-400, 400, (groups, dims))
    of = rng.integers(0, groups, n)
    x = centers[of] + rng.integers(-6, 7, (n, dims))
    return [(i, int(g % labels) if rng.random() < 0.7 else int(rng.integers(labels)), v.tolist()) for i, (g, v) in enumerate(zip(of.tolist(), x, strict=True))]


def test_clusters_are_pruned_and_results_stay_exact(spark, monkeypatch):
    rows = clustered(6000, 3)
    monkeypatch.setattr(hn, "CELL", 200)
    monkeypatch.setattr(hn, "LEAF", 64)
    monkeypatch.setattr(hn, "LEAF_OF_ANCHORS", 16)
    counts = {}
    got = hn.mine(spark.createDataFrame(rows, ROWS), F.col("key") % 20 == 0, counts=counts)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, lambda k: k % 20 == 0))
    assert counts["positives"]["scored"] < 0.5 * counts["positives"]["pairs"] and counts["negatives"]["scored"] < 0.2 * counts["negatives"]["pairs"], counts


def test_ties_copies_many_labels_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    copies = [(i, 1, [7, -3, 2]) for i in range(900)] + [(i, i % 150, rng.integers(-9, 9, 3).tolist()) for i in range(900, 1500)]
    monkeypatch.setattr(hn, "CHUNK", 300)
    got = hn.mine(spark.createDataFrame(copies, ROWS).repartition(5), F.col("key") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain(copies, lambda k: k % 50 == 0))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (100, [0.9, 0.1, 0.3], 1), (200, [], 1), (7, [1.0, 0.4], 0), (1, [0.9, 0.5], 2), (2, None, 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [1.0, 1.0], None),
        (None, [1.0, 1.0], 1), (8, [-1.0, -1.0], 1), (9, [0.0, 0.0], 2), (300, [1e5, 3e6], 2), (301, [1e5, 3e6], 3), (302, [1e5, 2.9e6], 2), (400, [0.5, 0.5], 77),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("clash")).withColumn("key", F.lit(1))
    got = hn.mine(hn.scaled(df, "vec_id", "embedding", F.col("label")), F.coalesce(F.col("key") % 100 == 0, F.lit(False))).collect()
    real = [(k, label, [int(np.floor(256 * x)) for x in v]) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, got)) == sorted(plain(real, lambda k: k % 100 == 0)) and got


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert hn.mine(none, F.lit(True)).collect() == []
    assert hn.mine(spark.createDataFrame([(1, 1, [1, 2])], ROWS), F.lit(False)).collect() == []
    assert hn.mine(spark.createDataFrame([(1, 1, [1, 2])], ROWS), F.lit(True)).collect() == []
    assert hn.mine(spark.createDataFrame([(1, 1, []), (2, 1, []), (3, 2, [])], ROWS), F.lit(True)).count() == 2
