"""The suffix array and the bytes removed against brute force."""

import random

import numpy as np
import pytest

from cairnlake.llm import suffix_array as S


def brute(rows, window=S.WINDOW):
    least = {}
    for key, text in rows:
        t = (text or "").encode()
        k = key if key is not None else 2**63 - 1
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            least[w] = min(least.get(w, k), k)
    out = []
    for key, text in rows:
        t = (text or "").encode()
        k = key if key is not None else 2**63 - 1
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - window + 1):
            if least[t[i : i + window]] < k:
                gone[i : i + window] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((key, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)))
    return sorted(out, key=str)


def run(spark, rows, parts=3, **bounds):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, blob string").repartition(parts)
    return sorted(((r.key, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup_substrings(df, **bounds).collect()), key=str)


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 30, 31, 32, 500):
        s = rng.integers(1, letters + 1, n)
        assert S.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def texts(seed, letters, n=60):
    rng = random.Random(seed)
    alphabet = "aé bcdefghijklmnopqrstuvwxyz"[:letters]
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [word(rng.randrange(30, 160)) for _ in range(10)]
    return [(i, "".join(rng.choice([rng.choice(pool), word(rng.randrange(60))]) for _ in range(rng.randrange(6)))) for i in range(n)]


@pytest.mark.parametrize("letters", [2, 25])
def test_random_texts(spark, letters):
    rows = texts(letters, letters)
    assert run(spark, rows) == brute(rows)


def test_hot_names_and_small_sorts(spark):
    rows = texts(9, 25, 80)
    assert run(spark, rows, batch_bytes=1500, hot=5, most_sorted=2000) == brute(rows)


def test_nulls_ties_and_long_texts(spark):
    rows = [(1, "a" * 120), (2, "b" + "a" * 60 + "c"), (3, None), (4, ""), (5, "ab" * 20_000), (6, "a" * 49), (None, "a" * 80), (7, "é" * 80), (8, "x" + "é" * 30), (9, "q" * 50 + "r" * 50), (9, "q" * 50 + "s" * 50), (10, "q" * 50)]
    assert run(spark, rows) == brute(rows)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, docs) == brute(docs)


def test_a_gram_in_110_000_surroundings(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = ["".join(rng.choices(letters, k=70)) + "SIXTEEN BYTES OK" for _ in range(110_000)]
    long = "".join(parts)
    second = "".join("".join(parts[i : i + 2]) + f" own text {i} of the second document, which nothing else has " for i in rng.sample(range(100_000), 300))
    of_first = set()
    wanted = {second[i : i + S.WINDOW] for i in range(len(second) - S.WINDOW + 1)}
    for i in range(len(long) - S.WINDOW + 1):
        if long[i : i + S.WINDOW] in wanted:
            of_first.add(long[i : i + S.WINDOW])
    gone = np.zeros(len(second), dtype=bool)
    for i in range(len(second) - S.WINDOW + 1):
        if second[i : i + S.WINDOW] in of_first:
            gone[i : i + S.WINDOW] = True
    got = run(spark, [(1, long), (2, second)])
    assert [r[:3] for r in got] == [(1, len(long), 0), (2, len(second), int(gone.sum()))] and gone.sum() > 50_000
    assert got[1][4] == bytes(b for b, g in zip(second.encode(), gone, strict=True) if not g)


def test_pieces_of_long_documents_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 60_000).astype(np.uint8)
    bounds = np.array([0, 100, 20_000, 20_050, 50_000, 50_010, 60_000])
    each = lambda p: sorted((int(d), w, int(n), int(x)) for d, a, b, n, x, _ in zip(*p, strict=True) for w in range(a, b - S.WINDOW + 1))
    whole = S.patches(data, bounds)
    monkeypatch.setattr(S, "PIECE", 3_000)
    assert each(S.patches(data, bounds)) == each(whole)


def test_split_patches_are_the_same_in_any_surroundings():
    rng = np.random.default_rng(6)
    core = rng.integers(97, 99, 300).astype(np.uint8)
    found = []
    for before in (0, 7, 61):
        data = np.concatenate([rng.integers(97, 99, before).astype(np.uint8), core, rng.integers(97, 99, 80).astype(np.uint8)])
        _, a, b, name, anchor, _ = S.patches(data, np.array([0, len(data) + 1]))
        of, s, e, title, _ = S.split_patches(data, a, b, name, anchor)
        assert all(a[o] <= x and y <= b[o] for o, x, y in zip(of, s, e, strict=True))
        per = {w: t for x, y, t in zip(s, e, title, strict=True) for w in range(x, y - S.WINDOW + 1)}
        assert sorted(per) == list(range(len(data) - S.WINDOW + 1))
        found.append([per[before + i] for i in range(len(core) - S.WINDOW + 1)])
    assert found[0] == found[1] == found[2]


def test_more_symbols_than_ranks_hold_are_refused():
    with pytest.raises(ValueError):
        S.suffix_array(np.ones((1 << 21) - 3, np.int64))


def test_empty_table(spark):
    assert run(spark, []) == []
