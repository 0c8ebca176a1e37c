"""Fingerprints, edits and likeness against a plain computation that shares no code with the module."""

import functools
import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

from cairnlake.llm import imatch


M = (1 << 64) - 1
#: One subset with every term, then six for each of the probabilities 1/16 to 1/4096.
PARTS = [0, *(n for n in range(4, 13) for _ in range(6))]


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def seed(k):
    return xxhash.xxh64_intdigest(b"subset", k)


def plain_terms(text):
    return set(re.findall("[^ \t\n\x0b\x0c\r]+", text.lower()))


@functools.cache
def places(word):
    """The subsets that hold a word, with what it adds to their sums."""
    h = xxhash.xxh64_intdigest(word)
    found = [(k, mix(h + seed(k) & M)) for k in range(len(PARTS))]
    return [(k, mix(m + seed(0) & M)) for k, m in found if m <= (1 << 64 - PARTS[k]) - 1]


def plain_components(words):
    """Of each subset the hash of the words in it, as a sum of their hashes; 0 where there is none."""
    sums = {}
    for w in words:
        for k, x in places(w):
            sums[k] = sums.get(k, 0) + x & M
    return [max(mix(sums[k]) >> 32, 1) if k in sums else 0 for k in range(len(PARTS))]


def plain_likeness(a, b):
    """Equal components among those that either has; of probabilities where either has all six, only if there are no others."""
    either = [k for k in range(len(PARTS)) if a[k] or b[k]]
    full = {n for n in range(4, 13) if sum(PARTS[k] == n for k in either) == 6}
    sparse = [k for k in either if k > 0 and PARTS[k] not in full]
    counted = sparse or either
    return sum(a[k] == b[k] for k in counted) / len(counted) if counted else 1.0


def brute(rows):
    """Expected rows, from texts in falling order of doc_id."""
    texts = [t or "" for _, t in rows]
    df = Counter(w for t in texts for w in plain_terms(t))
    n = len(texts)
    band = {w for w, c in df.items() if 0.001 * n <= c <= max(0.05 * n, 1)}

    def fp(text):
        words = plain_terms(text)
        return plain_components(words & band or words)

    order = sorted(range(n), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0), reverse=True)
    out = []
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, nxt = texts[a], texts[b]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        f, e, x = fp(t), fp(edited), fp(nxt)
        hexed = lambda y: "".join(f"{c:08x}" for c in y)
        out.append((rows[a][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(f), hexed(e), plain_likeness(f, e), plain_likeness(f, x)))
    return sorted(out, key=str)


def test_against_plain_computation(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (902, "ÉÉ é"), (None, "null key"), (903, "long text " * 30_000), (904, docs[5][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fingerprint string").repartition(3)
    got = sorted((tuple(r) for r in imatch.fingerprint_chain(df).collect()), key=str)
    assert got == brute(docs)
    by = {r[0]: r[3] for r in got}
    assert by[904] == by[docs[5][0]]
    halves = [r for r in got if r[1] > 400]
    assert np.mean([r[5] for r in halves]) > 0.15 > 0.08 > np.mean([r[6] for r in halves])


def test_single_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    (row,) = imatch.fingerprint_chain(df).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert len(imatch.fingerprint_chain(df.union(df).union(df)).collect()) == 3
    assert imatch.fingerprint_chain(df.where("false")).collect() == []
