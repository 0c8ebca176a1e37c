"""The pipeline's near-dedup stage against all pairs."""

import random

import corpus_pipeline as P
import numpy as np

from cairnlake.llm.common import words_of
from cairnlake.llm.shingles import may_be_similar, parities, sketch_size
from cairnlake.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    h = shingle_hashes(text)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_kept(rows):
    """doc_ids that stay: the least of each group linked by three bits or by five-word shingles of similarity 0.8."""
    sets, fps = {}, {i: fingerprint(t) for i, t in rows}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    ids = sorted(sets)
    links = [(i, j) for x, i in enumerate(ids) for j in ids[:x] if (fps[i] ^ fps[j]).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in ids:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return {i for i in ids if least[i] == i}


def stage(spark, docs):
    return dict(P.STAGES)["SimHash near-dedup"](spark, docs, SF)


def test_copies_with_edited_words(spark):
    random.seed(7)
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if 40 < len(words_of(d.text)) < 900]
    for i, (_, t) in enumerate(docs[:60]):
        w = t.split(" ")
        for k in random.sample(range(len(w)), max(1, len(w) * (i % 6) // 100)):
            w[k] = f"edit{k}"
        docs.append((10_000 + i, " ".join(w)))
    base = docs[0][1].split(" ")  # a large group of near copies, all pairs alike
    for i in range(80):
        docs.append((20_000 + i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])))
    got = [r.doc_id for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    want = brute_kept(docs)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(docs) - 100


def test_the_pairs_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = P.line_dedup(spark, P.quality_rules(spark, docs, SF), SF)
    left = {r.doc_id for r in stage(spark, rows).collect()}
    assert {1, 6} <= left and not {145, 177} & left
    assert left == brute_kept([(r.doc_id, r.text) for r in rows.collect()])


def test_rows_that_repeat_or_lack_a_doc_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, b), (None, "c d e"), (None, "c d e")]
    got = [(r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, "c d e")], key=str)


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for n in (1, 5, 511, 512, 513, 1024, 1100, 3000):
        for kept in (0.0, 0.5, 0.85, 0.89, 0.95, 1.0):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(kept * n)], rng.integers(0, 2**64, n - int(kept * n), dtype=np.uint64)]))
            for x, y in ((a, b), (a, a[: max(1, int(kept * n))])):
                both = len(np.intersect1d(x, y))
                may = may_be_similar(*(z for s in (x, y) for z in (len(s), parities(s, sketch_size(len(s))).tobytes())))
                assert may or 5 * both < 4 * (len(x) + len(y) - both)
                ruled_out += not may
    assert ruled_out > 20


def test_frequent_shingles_are_dealt_to_parts(spark, monkeypatch):
    from cairnlake.llm import shingles

    monkeypatch.setattr(shingles, "HOT", 4)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[: 20 + i % 30], *(f"own{i}x{k}" for k in range(i % 7 * 6))])) for i in range(70)]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_kept(docs) and 3 < len(got) < 68
