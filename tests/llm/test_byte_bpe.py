"""Encoding against the tiktoken library, and an exact round trip."""

import hashlib

import public_tokenizers
import pyspark.sql.functions as F
import pytest
import tiktoken

from cairnlake.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, lang string"


def rows(spark, texts, native=False, **bounds):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)
    out = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, native=native, **bounds)
    return out.withColumn("bytes", byte_bpe.decode(F.col("ids"), PATH)).orderBy("doc_id").collect()


@pytest.mark.parametrize("native", [False, True])
def test_matches_the_library_and_round_trips(spark, native):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    texts = [
        None, "", " ", "a", "Hello, world's best <|endoftext|> tokens!!", "tab\t\tand\n\n  lines  ", "naïve façade – ünïcode 漢字 😀😀",
        "x" * 3000, "ab" * 1000 + " end", "1234567890" * 50, "same same same same", "same same same same", " nbsp　wide", "é" * 300,
        " ".join(f"word{i} antidisestablishmentarianism{i}" for i in range(500)),
    ]
    got = rows(spark, texts, native)
    assert [r.text for r in got] == texts
    for text, row in zip(texts, got, strict=True):
        assert row.ids == library.encode_ordinary(text or "")
        assert bytes(row.bytes) == (text or "").encode()
        assert bytes(row.ids_le) == b"".join(i.to_bytes(4, "little") for i in row.ids)


@pytest.mark.parametrize("native", [False, True])
def test_forgetting_pieces_changes_nothing(spark, native):
    texts = [f"alpha beta gamma number{i % 7} delta{i}" for i in range(50)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    assert [r.ids for r in rows(spark, texts, native, most_pieces=3)] == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_match_the_fold():
    ranks = byte_bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for piece in ("aaaaaaa", "abababab" * 9, "thequickbrownfox", "éééé", "zzzzzzzzzy"):
        assert byte_bpe.merge_short(piece.encode(), ranks) == byte_bpe.merge_long(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_query_on_a_small_scale(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in byte_bpe.op3_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
