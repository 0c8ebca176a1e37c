"""The packed text index against postings made plainly."""

import random

import numpy as np
from pyspark.sql import functions as F

from cairnlake.operators import retrieval as R

WORDS = ["the", "Licensed", "under", "thé", "x1", "straße", "日本", "a" * 300]


def plain(rows):
    out = []
    for i, text in rows:
        words = [w.lower().replace("é", "e") for w in (text or "").split()]
        for w in sorted(set(words)):
            at = [k for k, x in enumerate(words) if x == w]
            out.append((w, i, len(words), len(at), at))
    return sorted(out, key=repr)


def test_numbers_are_those_packed():
    some = np.array([0, 1, 127, 128, 16383, 16384, 2**32, 2**63, 2**64 - 1], np.uint64)
    data, at = R.varints(some)
    assert R.numbers(data).tolist() == some.tolist() and at.tolist()[:4] == [0, 1, 2, 3] and len(data) == at[-1]
    assert R.numbers(R.varints(some[:0])[0]).tolist() == []


def test_postings_are_whole_and_a_row_holds_many(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i * 37 % 5000, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(1000)]
    rows += [(None, "the under"), (None, "the"), (-(2**63), "the the"), (2**63 - 1, "the"), (7, None), (8, ""), (9, " - ")]
    source = str(tmp_path / "docs")
    spark.createDataFrame(rows, "id long, text string").repartition(3).write.parquet(source)
    index = R.text_index(spark, source, spark.read.parquet(source), F.col("text"))
    want = plain([(i, None if t == " - " else t) for i, t in rows])
    terms = sorted({w[0] for w in want})
    got = [(r.term, r.id, r.length, r.tf, r.at) for r in index.of(terms).collect()]
    assert sorted(got, key=repr) == want
    assert sorted(((r.term, r.id, r.length, r.tf) for r in index.of(terms, positions=False).collect()), key=repr) == sorted((w[:4] for w in want), key=repr)
    facts = index.facts.first()
    assert facts.n == len(rows) and facts.total == sum(w[3] for w in want)
    # a term is a row for each task's text, and not for each document
    assert index.postings.count() <= len(terms) * 3 * 2
    assert index.of([]).collect() == [] and R.phrase_hits(index, "!").collect() == []
    hits = {r.id for r in R.phrase_hits(index, "Licensed-under thé").collect()}
    bare = lambda t: (t or "").lower().replace("é", "e").split()
    assert hits == {i for i, t in rows if "the" in bare(t) and "licensed under" in " ".join(bare(t))}


def test_terms_are_what_spark_makes_of_texts_and_rows_hold_many_terms(spark, tmp_path):
    rng = random.Random(7)
    odd = [0x130, 0x131, 0x3A3, 0x3C3, 0x3C2, 0x301, 0x308, 0x345, 0x1E9E, 0xDF, 0x1D400, 0x10400, 0x660, 0xB2, 0xAD, 0x200D, 0x902, 0xC9, 0x1C5, 0x212B, 0xFFFD, 0x20, 0x9, 0x2D, 0x41, 0x7A, 0x35]
    rows = [(i, "".join(chr(rng.choice(odd) if rng.random() < 0.8 else rng.choice([*range(1, 0xD800), *range(0xE000, 0x30000)])) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(400 + i, f"w{i} ΟΔΟΣ Straße{i} été") for i in range(600)]
    source = str(tmp_path / "docs")
    spark.createDataFrame(rows, "id long, text string").repartition(2).write.parquet(source)
    docs = spark.read.parquet(source)
    index = R.text_index(spark, source, docs, F.col("text"))
    words = {r.id: [w for w in r.t.split(" ") if w] for r in docs.select("id", R.spaced_tokens(R.folded(F.col("text"))).alias("t")).collect()}
    want = sorted((w, i, len(t), t.count(w), [k for k, x in enumerate(t) if x == w]) for i, t in words.items() for w in set(t))
    got = index.of(sorted({w[0] for w in want})).collect()
    assert sorted((r.term, r.id, r.length, r.tf, r.at) for r in got) == want
    assert {w[0] for w in want} >= {"οδος", "ete", "straße7"}
    # rows do not grow with the distinct terms, of which a row holds many
    assert len({w[0] for w in want}) > 1500 and index.postings.count() <= 2 * R.PARTS
    assert [r.id for r in index.of(["w7"], positions=False).collect()] == [407] and index.of(["w"]).collect() == []
