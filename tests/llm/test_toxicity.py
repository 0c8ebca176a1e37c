"""The index against brute force, and held-out accuracy."""

import numpy as np

from cairnlake.llm import toxicity as T


def random_index(seed, examples=300, terms=60):
    rng = np.random.default_rng(seed)
    counts = []
    for _ in range(examples):
        ids = np.sort(rng.choice(terms, rng.integers(1, 8), replace=False))
        counts.append(np.stack([ids, rng.integers(1, 4, len(ids))], axis=1).astype("<i4").tobytes())
    labels = rng.integers(0, 2, examples).tolist()
    return T.Index(1 + rng.random(terms), counts, labels, list(range(examples)), 0.1), counts


def test_neighbours_are_exact():
    index, counts = random_index(1)
    dense = np.zeros((len(counts), len(index.idf)))
    for row, i in enumerate(index.keys):
        t, w = index.vector(counts[i])
        dense[row, t] = w
    for c in counts[:80]:
        t, w = index.vector(c)
        q = np.zeros(len(index.idf))
        q[t] = w
        cosines = dense @ q
        rows, got = index.nearest(t, w)
        assert np.allclose(np.sort(got)[::-1], np.sort(cosines)[::-1][: len(got)]) and np.allclose(cosines[rows], got)
        assert len(rows) == min(T.NEIGHBOURS, (cosines > 0).sum())


def test_calibration_is_monotone_and_within_bounds():
    index, counts = random_index(2)
    index.calibrate(counts, [0, 1] * 150)
    assert (np.diff(index.map[0]) >= 0).all() and (np.diff(index.map[1]) >= 0).all()
    assert all(0 <= index.score(c)[0] <= 1 for c in counts)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = T.op10_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted == 1 and truth[r.doc_id] == 1 for r in held)
    assert hits >= 0.75 * sum(truth[r.doc_id] for r in held) and hits >= 0.85 * sum(r.predicted for r in held)


def test_odd_rows(spark):
    docs = [(i, ("awful slur here " if i % 2 else "kind word there ") + f"w{i}", "x") for i in range(1, 80)] + [(None, "awful", "x"), (200, None, "x"), (201, "", "x"), (202, "slur " * 50_000, "x"), (3, "awful slur", "x")]
    labels = [(i, i % 2) for i in range(1, 80)] + [(None, 1), (5, None), (5, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, label string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.score_toxicity(d, known).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.key: r for r in got}
    assert by[202].score > 0.5 > by[2].score and not by[None].held_out and by[200].score == by[201].score
    assert {r.score for r in T.score_toxicity(d, known.where("false")).collect()} == {0.0}
    assert T.score_toxicity(d.where("false"), known).collect() == []
