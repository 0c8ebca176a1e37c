"""Shares, permutations and the mix against their definitions."""

import numpy as np
import pyspark.sql.functions as F

from cairnlake.llm import mixing
from cairnlake.llm.common import words_of


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left, free = left - sum(out[s] for s in over), free - over
    return out


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_query_keeps_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = mixing.op7_mixing(spark, sf).collect()
    again = mixing.op7_mixing(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(docs)
    size = {d.doc_id: len(words_of(d.text)) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    sizes, taken = {}, {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + size[d.doc_id]
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    want = brute_targets(sizes)
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2 * mixing.BLOCK, 0.02 * t)


def test_nulls_repeats_ties_and_clashing_columns(spark):
    rows = [(1, None, "b", 1), (1, "x y z", None, 1), (2, "x y z", None, 1), (2, "x y z", None, 1), (None, "q " * 500, "b", 2), (3, "", "a", 3), (4, "one two", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    placed, targets, pieces = mixing.mix(docs)
    assert placed.count() == len(rows)
    want = brute_targets({"a": 2, "b": 500, None: 9})
    assert {r.source: r.target for r in targets.collect()} == want
    most = placed.join(pieces.groupBy("__row").agg(F.sum("n").alias("t")), "__row", "left").collect()
    assert all((r.t or 0) <= 2 * r["__size"] for r in most)
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns and {r.text for r in out.where("source = 'a'").collect()} == {"one two"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_texts(docs).collect() == []
