"""Removed words against brute force."""

import random

import numpy as np
import pytest

from cairnlake.llm import recompression as R
from cairnlake.llm.common import words_of


def brute(rows, window=R.WINDOW):
    """[(key, n_words, n_removed, kept)] by looking at every window."""
    places = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for p in places:
        w = words_of(rows[p][1])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (p, i))
    out = []
    for p, (key, text) in enumerate(rows):
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (p, i):
                gone |= set(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, parts=3, **bounds):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, doc string").repartition(parts)
    return sorted((tuple(r) for r in R.dedup_windows(df, **bounds).collect()), key=str)


@pytest.mark.parametrize("letters", [2, 30])
def test_random_texts(spark, letters):
    rng = random.Random(letters)
    pool = [" ".join(f"w{rng.randrange(letters)}" for _ in range(rng.randrange(15, 70))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice([rng.choice(pool), " ".join(f"u{i}x{rng.randrange(99)}" for _ in range(rng.randrange(8)))]) for _ in range(rng.randrange(6)))) for i in range(60)]
    assert run(spark, rows) == run(spark, rows, batch_bytes=700) == brute(rows)


def test_runs_nulls_and_long_texts(spark):
    rows = [(1, "a " * 100), (2, "a " * 25 + "b " * 60 + "c"), (3, None), (4, ""), (5, "ab " * 30_000), (6, "x y " * 40), (7, "y x " * 40), (8, "one two"), (None, "a " * 30), (9, "é\tü\x0bß " * 20)]
    assert run(spark, rows) == brute(rows)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_are_one_place(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = run(spark, [(1, text), (1, text), (1, "other " * 30), (2, text)])
    assert [r[:3] for r in got] == [(1, 30, 29), (1, 40, 0), (1, 40, 0), (2, 40, 40)]


def test_unequal_words_are_never_taken_for_equal(spark):
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    complement = thue.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, "some other words"), (2, f"{thue} {tail} end"), (3, f"{complement} {tail} stop")]
    assert run(spark, rows) == brute(rows) and run(spark, rows)[2][2] == 0


def test_pieces_of_long_documents_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    names = R.mix(rng.integers(0, 6, 9000).astype(np.uint64))
    first = np.array([0, 10, 4000, 4000, 4030, 9000])
    each = lambda p: sorted((int(d), w, int(n)) for d, a, b, n in zip(*p, strict=True) for w in range(a, b + 1))
    whole = R.patches(names, first)
    monkeypatch.setattr(R, "PIECE", 300)
    assert each(R.patches(names, first)) == each(whole)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    core = rng.integers(0, 5, 60)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(0, 30)), rng.integers(0, 5, rng.integers(0, 30))
        x, y = (np.concatenate(p).astype(np.uint64) for p in ((a, core, b), (b, a, core)))
        found = []
        for seq, at in ((x, len(a)), (y, len(a) + len(b))):
            d, i0, i1, name = R.patches(R.mix(seq + np.uint64(7)), np.array([0, len(seq)]))
            per = {i: n for s, e, n in zip(i0, i1, name, strict=True) for i in range(s, e + 1)}
            found.append([per[at + i] for i in range(len(core) - R.WINDOW + 1)])
        assert found[0] == found[1]
