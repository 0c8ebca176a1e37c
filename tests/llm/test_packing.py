"""Packed sequences: ids as the tokenizers library gives them, every id once, full windows, balanced steps."""

from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces, ids, key="doc_id"):
    """Sequences are gapless and at powers of two, and each document's ids lie in exactly one piece each."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p[key]].append(p)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert set(documents) == set(ids)
    for k, parts in documents.items():
        whole, at = np.array(ids[k], "<u4"), 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) and p.ids_crc32 == crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
    return sequences


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_packs_every_id_once_without_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = packing.op12_packing(spark, sf)
    assert dict(got.dtypes) == {c: "bigint" for c in got.columns}
    rows = got.collect()
    sequences = check(rows, dict(zip([d.doc_id for d in docs], ids_of([d.text for d in docs]), strict=True)))
    whole = {k: sum(n for _, n in v) for k, v in sequences.items()}
    assert len(rows) < len(docs) + 2 * len(sequences)
    # steps of a tier hold as many sequences, give or take one, and their costs are alike
    steps = defaultdict(lambda: defaultdict(set))
    for r in rows:
        assert r.tier == whole[r.sequence_id]
        steps[r.tier][r.step].add(r.sequence_id)
    cost = {k: sum(n * n for _, n in v) for k, v in sequences.items()}
    for tier, by_step in steps.items():
        sizes = [len(v) for v in by_step.values()]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= packing.STEP_IDS
        costs = [sum(cost[k] for k in v) for v in by_step.values() if len(v) == max(sizes)]
        assert max(costs) - min(costs) <= tier * tier


ODD = [
    None, "", " \t\n\x0b\x0c\r ", "a", "A-b c'S it'S I'LL '' 's 'sa \x1cb\x1d", "İstanbul ıI ŉ ſ Σας ΣΑΣ ǅ", "e\u0301 \u0301x a\u0301\u0327 가각 \u1100\u1161", "x<|endoftext|>y <|startoftext|> z<|endoftext|", "\u00a0n\u2003b\u3000c\u0085d",
    "naïve façade 12³ ½ ٣ 日本語 emoji 😀😀 #!?..., under_score </w> w</w>", "word " * 9000, "ab" * 40_000, "z" * 4097, "Ǆ" * 50, "\x00\x01 \ufeff\u200d",
]


def test_ids_of_odd_texts_are_the_librarys():
    encoder = packing.Encoder(PATH)
    for _ in range(2):  # the second time from what is kept
        got = encoder.texts([(t or "").encode() for t in ODD], 2)
        assert [x.tolist() for x in got] == ids_of(ODD)


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aA's\u0301 İé1,<|>\n"))), max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_ids_of_any_text_are_the_librarys(texts):
    assert [x.tolist() for x in _encoder().texts([t.encode() for t in texts], 2)] == ids_of(texts)


def _encoder(kept=[]):  # noqa: B006
    if not kept:
        kept.append(packing.Encoder(PATH))
    return kept[0]


@given(st.lists(st.one_of(st.integers(1, 5000), st.integers(1, 20), st.sampled_from([512, 1024, 2048, 4096, 8192, 3000])), max_size=60))
@settings(max_examples=200, deadline=None)
def test_windows_hold_each_id_once_and_are_full(lengths):
    got = list(packing.windows(lengths))
    seen = sorted(p for w in got for p in w)
    at = defaultdict(int)
    for i, a, n in seen:
        assert a == at[i] and n > 0
        at[i] += n
    assert [at[i] for i in range(len(lengths))] == lengths
    sizes = [sum(n for _, _, n in w) for w in got]
    assert all(s <= 4096 and s & (s - 1) == 0 for s in sizes)
    assert sum(s not in packing.TIERS for s in sizes) <= 9 and sum(s < 4096 for s in sizes if s not in packing.TIERS) <= 9
    assert sum(map(len, got)) <= len(lengths) + sum(sizes) // 512 + 12 + len(got)


def test_odd_rows_repeats_and_clashing_columns(spark):
    rows = [(i % 7 if i % 5 else None, t, i, "tier") for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, tier string")
    pieces = packing.pack_documents(docs, PATH, ids=True)
    assert pieces.columns == ["doc_id", "row", *packing._COLUMNS, "ids"]
    ids = dict(enumerate(ids_of(ODD * 2)))
    out = packing.balanced(pieces)
    check(out.collect(), ids, "row")
    assert all(r.ids == ids[r.row][r.start : r.start + r.length] for r in out.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.balanced(packing.pack_documents(docs, PATH)).collect() == []


def test_small_groups_still_need_no_padding(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum dolor " * (i % 400)) for i in range(300)], "doc_id long, text string").repartition(3)
    check(packing.pack_documents(docs, PATH, group=5000).collect(), dict(enumerate(ids_of(["lorem ipsum dolor " * (i % 400) for i in range(300)]))))
