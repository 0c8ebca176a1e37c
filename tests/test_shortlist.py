"""Search over one-byte codes against the exact search, and words that chunks share."""

import numpy as np

from cairnlake.operators.sessions import owned_words, passages
from cairnlake.operators.shortlist import best_above, codes

VECTORS = "id long, v array<float>"
WORDS = "f long, chunk long, id long, timestamp double, duration double, text string, confidence double"


def exact(rows, q, floor, most):
    q = np.array(q) / np.linalg.norm(q)
    scored = []
    for i, v in rows:
        if v and len(v) == len(q):
            x = np.array(v, np.float32).astype(float)
            s = round(float(x @ q / (np.linalg.norm(x) or 1.0)), 9)
            if s >= floor:
                scored.append((-s, i))
    return [i for _, i in sorted(scored)[:most]]


def test_codes_lose_no_row_and_most_are_never_read(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 48))
    rows = [(i, (centers[i % 40] + 0.5 * rng.normal(size=48)).tolist()) for i in range(4000)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + [(6000, None), (6001, []), (6002, [0.0] * 48), (6003, [1.0] * 7), (6004, [1e-30] * 48), (6005, (1e6 * centers[3]).tolist())]
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    coded = codes(df)
    for q, floor, most in ((rows[7][1], 0.6, 20), (rows[7][1], 0.6, 100), (centers[3].tolist(), 0.99, 20), (rng.normal(size=48).tolist(), 0.95, 20), (rows[9][1], -1.0, 500)):
        counts = {}
        got = [r.id for r in best_above(coded, df, q, floor, most, counts).collect()]
        assert got == exact(rows, q, floor, most)
        assert most > 100 or counts["full"] <= 6 * most


def test_every_word_is_owned_once(spark):
    # one file of 100 seconds, three chunks that hear 0-46.5, 43.5-91.5 and 88.5-100
    said = [(k, 0.5 * k, 0.4, f"w{k}") for k in range(200)]
    rows = []
    for k, start, d, text in said:
        for chunk, (a, b) in enumerate(((0.0, 46.5), (43.5, 91.5), (88.5, 100.0))):
            if a <= start < b:
                rows.append((1, chunk, k, start - a, d, f" {text} ", 1.5))
    rows += [(1, 0, 900, float("nan"), 0.1, "x", 0.5), (1, 0, 901, 1.0, 0.1, "  ", 0.5), (1, 2, 902, 30.0, 1.0, "late", 0.5), (2, 0, 903, 1.0, 0.1, "no length", 0.5)]
    df, lengths = spark.createDataFrame(rows, WORDS), spark.createDataFrame([(1, 100.0), (2, 0.0)], "f long, length double")
    own = owned_words(df, lengths, ["f"]).collect()
    assert sorted(r.text for r in own) == sorted(t for *_, t in said)
    assert {r.chunk for r in own if r.start + 0.2 < 45} == {0} and all(r.confidence == 1.0 for r in own)
    assert sum(len(r.text.split()) for r in passages(df, lengths, ["f"]).collect()) == len(said)


def test_pauses_count_from_ends_and_marks_join(spark):
    rows = [(1, 0, 1, 0.0, 2.0, "Well", 0.5), (1, 0, 2, 3.0, 0.1, ",", 0.7), (1, 0, 3, 3.2, 0.1, "so", 0.9), (1, 0, 4, 4.6, 0.1, "next", 0.9), (1, 0, 5, 4.7, 0.0, "。", 0.9)]
    got = passages(spark.createDataFrame(rows, WORDS), spark.createDataFrame([(1, 50.0)], "f long, length double"), ["f"]).orderBy("start").collect()
    assert [(r.text, round(r.confidence, 6)) for r in got] == [("Well, so", 0.7), ("next。", 0.9)]
