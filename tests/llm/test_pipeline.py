"""The pipeline's stages against brute force on a small scale."""

import hashlib

import corpus_pipeline as P
import public_tokenizers
import tiktoken

from cairnlake.llm import byte_bpe, simhash
from cairnlake.llm.common import words_of
from cairnlake.llm.quality_rules import count_rules

SF = "/root/testdata/sf0.001"


def brute_lines(docs, run=4):
    """{doc_id: text} without runs of lines that came before."""
    seen, out = set(), {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        lines = d.text.split("\n")
        at = [i for i, x in enumerate(lines) if words_of(x)]
        gone = set()
        for j in range(len(at) - run + 1):
            key = tuple(lines[i] for i in at[j : j + run])
            if key in seen:
                gone |= set(range(at[j], at[j + run - 1] + 1))
            seen.add(key)
        out[d.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = P.quality_rules(spark, docs, SF)
    assert one.columns == docs.columns
    kept = one.collect()
    for d in docs.collect():
        n, _, _, _, repeats, _ = count_rules(d.text)
        if d.doc_id in {k.doc_id for k in kept}:
            assert n >= 10 and 100 * repeats <= 20 * n
    two = P.line_dedup(spark, one, SF)
    assert two.columns == docs.columns
    rows = two.collect()
    assert {r.doc_id: r.text for r in rows} == brute_lines(kept)
    assert all(r.n_chars == len(r.text) for r in rows)
    three = P.simhash_dedup(spark, two, SF)
    fps = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(two).withColumnRenamed("key", "doc_id").collect()}
    left = {r.doc_id for r in three.collect()}
    for i, f in fps.items():  # whoever went is linked to a smaller one, and no two that stay are linked
        near = [j for j, g in fps.items() if j != i and (f ^ g).bit_count() <= 3]
        assert (i in left and not any(j in left for j in near)) or (i not in left and min(near) < max(i, *near))
    four = P.mixing(spark, three, SF)
    assert four.columns == docs.columns
    by = {r.doc_id: r.text for r in three.collect()}
    mixed = four.collect()
    words = {i: words_of(t) for i, t in by.items()}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words_of(r.text))
        assert r.text == by[r.doc_id] or set(words_of(r.text)) <= set(words[r.doc_id])
    assert all(n <= 2 * len(words[i]) for i, n in taken.items())
    total = sum(map(len, words.values()))
    assert abs(sum(taken.values()) - 1.5 * total) < 0.05 * total
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    five = P.byte_bpe(spark, four, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in five) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in mixed)
    assert sorted(r.decoded_sha256 for r in five) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed)


def test_run_is_the_stages_in_order(spark):
    assert P.run(spark, SF).count() > 0
    assert [n.split()[0] for n, _ in P.STAGES] == ["quality", "line", "SimHash", "mixing", "byte-level"]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
