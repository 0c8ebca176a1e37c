"""Fingerprints and components against brute force."""

import random

import xxhash

from cairnlake.llm import simhash
from cairnlake.operators.graph import components


def brute_fp(text):
    words = simhash.WORD_BYTES.findall((text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            m = min(least[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 3)
            if m < least[i]:
                least[i], changed = m, True
    return least


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.key: (r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [d.text for d in docs]
    random.seed(3)
    for t in texts[:40]:  # near copies
        w = t.split(" ")
        w[random.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    check(spark, [*texts, None, "", "  \n", "One", "one", "one Two", "É a", "é a", texts[0], "w " * 100_000])


def test_links_join_what_brute_force_joins(spark):
    random.seed(5)
    fps = {random.getrandbits(64)}
    for _ in range(60):
        x = random.choice(sorted(fps))
        for _ in range(random.randrange(1, 6)):
            x ^= 1 << random.randrange(64)
        fps.add(x)
    center = random.getrandbits(64)  # a ball of near fingerprints
    fps |= {center ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(80)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = [(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in got)
    found = {r.node: r.component for r in components(spark.createDataFrame(got, "src long, dst long")).collect()}
    assert {f: found.get(f, f) for f in signed} == {f: signed[i] for f, i in ((signed[k], v) for k, v in brute_components({k: f & (2**64 - 1) for k, f in enumerate(signed)}).items())}


def test_rows_without_key_link_and_bridge(spark, monkeypatch):
    fp = {"A": 0b1, "near A": 0b11, "B": 0b11100000, "bridge": 0b00100000 | 0b1, "far": 0b1111 << 59}
    fp["C"] = fp["bridge"] ^ (0b111 << 20)
    fp["D"] = fp["bridge"] ^ (0b111 << 30)
    rows = [(None, "far"), (7, "far"), (None, "bridge"), (9, "C"), (3, "D"), (None, "B" * 3)]
    fp["BBB"] = 2**50 + 2**51 + 2**52 + 2**53
    table = spark.createDataFrame([(k, fp[t]) for k, t in rows], "key long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text, key: docs)
    got = sorted((str(r.key), r.fp, r.component) for r in simhash.near_duplicates(table).collect())
    want = [("None", fp["far"], 7), ("7", fp["far"], 7), ("None", fp["bridge"], 3), ("9", fp["C"], 3), ("3", fp["D"], 3), ("None", fp["BBB"], None)]
    assert got == sorted(want, key=lambda x: x[:2])


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (5, None)], "doc_id long, text string")
    got = sorted((str(r.key), r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == [("3", 3), ("3", 3), ("5", 5), ("None", 3)]
    assert simhash.near_duplicates(docs.where("false")).collect() == []
