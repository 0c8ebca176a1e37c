"""A training-corpus pipeline over `documents`: STAGES in order, each over all rows the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.byte_bpe import decode, encode
from cairnlake.llm.common import bounded_batches
from cairnlake.llm.line_dedup import PASSAGE, dedup_lines
from cairnlake.llm.mixing import mixed_texts
from cairnlake.llm.quality_rules import apply_rules
from cairnlake.llm.shingles import shingle_components
from cairnlake.llm.simhash import near_duplicates
from cairnlake.session import drop_staged, kept_tables, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their host's verdict."""
    bounded_batches(spark)
    return apply_rules(docs).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rule of op1_line_dedup alone: documents without runs of lines that came before; a document may be left empty, and stays."""
    bounded_batches(spark)
    return dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_and_passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of four lines, shorter passages of 50 words, and short whole texts that came before."""
    bounded_batches(spark)
    return dedup_lines(docs, words=PASSAGE).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rule of op2_simhash alone: of each of its components the document with the least doc_id; rows without doc_id stay."""
    bounded_batches(spark)
    gone = near_duplicates(docs).where("key <> component").select(F.col("key").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash or five-word shingles of similarity 0.8 link: that with the least doc_id."""
    bounded_batches(spark)
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = staged(shingle_components(rows, near_duplicates(rows, key="__row")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row")
    kept = rows.select("__row", "doc_id").join(found, "__row").groupBy("component").agg(first)
    return rows.join(kept.select("__row"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each turn in which words of a document are taken."""
    bounded_batches(spark)
    return mixed_texts(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with digests of the ids and of the bytes they decode to."""
    bounded_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return out.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_and_passage_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]
#: SimHash components and seeded permutations have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        # what a stage wrote for itself goes when its result stands, and the result when the next one does
        with kept_tables(spark) as keep:
            result = keep(stage(spark, docs, sf_dir))
        if i:
            drop_staged(docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
