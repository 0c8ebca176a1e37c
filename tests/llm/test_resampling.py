"""Importance resampling against a plain computation."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from cairnlake.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    w = WORDS.findall((text or "").translate(UPPER))
    return len(w), Counter(crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, benchmark):
    """{row: (doc_id, n_features, weight, score)} and the rows drawn, in order."""
    found = [plain_features(t) for _, t in docs]
    s, t = sum((f for _, f in found), Counter()), sum((plain_features(x)[1] for x in benchmark), Counter())
    all_s, all_t = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for (doc_id, _), (n, f) in zip(docs, found, strict=True):
        weight = sum(gain[b] * k for b, k in f.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((i for i, r in enumerate(out) if r[4] >= 20), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0]))
    rank = {i: k + 1 for k, i in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_is_the_plain_computation(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = resampling.op13_importance_resampling(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    want = plain(docs, benchmark)
    assert ordered(got.collect()) == ordered(want) and any(r[4] for r in want)


ODD = [
    (1, None), (2, ""), (3, " ,.!"), (4, "one"), (5, "One two"), (6, "one\x00two_three[four{five"), (7, "É é ß 日本 語 " * 9), (8, "a" * 70_000), (None, "x y z " * 30), (None, "x y z " * 30),
    (9, "Same words here " * 12), (9, "Same words here " * 12), (10, "0a1B2c " * 40), (11, "\u00a0nbsp\u00a0 stays\u2028in words " * 10),
]


@pytest.mark.parametrize("piece", [None, 7])
def test_odd_rows_and_cut_texts(spark, monkeypatch, piece):
    docs = [(i, t) for i, t in ODD for _ in range(4)]
    df = spark.createDataFrame([(i, t, 1.5, "w") for i, t in docs], "doc_id long, text string, score double, __x string")
    benchmark = ["one two three", None, "x y z"]
    target = spark.createDataFrame([(t,) for t in benchmark], "text string")
    if piece:  # the function that workers run is pickled with the module's name, so a piece is set where they read it
        texts = [(t or "").encode() for _, t in docs]
        whole = _keys(texts)
        monkeypatch.setattr(resampling, "PIECE", piece)
        assert _keys(texts) == whole
        return
    got = resampling.draws(resampling.scored(df, target))
    assert got.columns == ["doc_id", "text", "__x", "n_words", "n_features", "weight", "score", "rank"]
    assert ordered(got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == ordered(plain(docs, benchmark))


def _keys(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], names=["__text"])
    out = list(resampling._featured("__text", 3, 10000)(iter([batch])))
    return [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def test_resample_draws_towards_the_target(spark):
    near = [(i, f"alpha beta gamma delta {i} " * 8) for i in range(0, 200, 4)]
    far = [(i, f"mud sand clay rock {i} " * 8) for i in range(200) if i % 4]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    target = spark.createDataFrame([("alpha beta gamma delta",)] * 20, "text string")
    rows = resampling.resample(docs, target, percent=10).collect()
    assert sorted(r.rank for r in rows) == list(range(1, 21)) and all(r.text.startswith("alpha") for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.draws(resampling.scored(none, none)).collect() == []
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert ordered(resampling.draws(resampling.scored(docs, none)).select("doc_id", "n_features", "weight", "score", "rank").collect()) == ordered(plain(ODD, []))
