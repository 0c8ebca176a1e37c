"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, exact Hamming check.

Fingerprints of 64 bits are cut into six blocks. Two that differ in at most three bits agree on three blocks
or more, so they meet under one of the 20 choices of three blocks (keys of about 32 bits: chance partners stay
few at any corpus size), where the distance is verified. Equal fingerprints are one node, and near ones are
first linked to the least of their block, so neither copies nor near copies are expanded into pairs.

Defined results: a null or empty text, or one without words, has the fingerprint zero and is linked like any
other; texts of one or two words are one shingle; rows with the same doc_id are one node; rows with a null
doc_id get the least doc_id they reach, null if there is none; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, small_batches
from cairnlake.operators.graph import FEW_EDGES, components
from cairnlake.session import staged, table

SHINGLE = 3
SEED = 42
RADIUS = 3
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bits of the blocks; RADIUS differing bits spoil RADIUS of them at most.
BLOCKS = (11, 11, 11, 11, 10, 10)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a text, repeats included."""
    words = WORD_BYTES.findall((text or "").encode().lower())  # lower() of bytes changes A-Z alone
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - np.array([len(w) for w in words])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1 << 20):
        each = [shingle_hashes(x.as_py()) for x in batch.column("__text")]
        n = np.array([len(x) for x in each], dtype=np.int64)
        out = np.zeros(len(each), dtype=np.uint64)
        flat = np.array([h for x in each for h in x], dtype="<u8")
        if len(flat):
            has = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[has]
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            over = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > n[has, None]
            out[has] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
        names = [x for x in batch.schema.names if x != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(out.view(np.int64))], names=[*names, "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit integer."""
    wide = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("__text"))
    return wide.mapInArrow(_fingerprints, f"key {wide.schema['key'].dataType.simpleString()}, fp bigint")


def block_masks() -> list[int]:
    """Masks of every choice of len(BLOCKS) - RADIUS blocks, as signed 64-bit integers."""
    masks, at = [], 0
    for bits in BLOCKS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    chosen = [sum(x) for x in combinations(masks, len(BLOCKS) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) over distinct fingerprints (fp) whose components are those of all pairs within RADIUS bits.

    Two steps, so that a ball of near fingerprints is not expanded into its pairs: each block links its members
    to its least one where the distance allows, and then only pairs of a block that this left apart are compared.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in block_masks()])
    keyed = fps.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.expr("fp & mask").alias("block"))
    shared = keyed.groupBy("k", "block").agg(F.min("fp").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = staged(keyed.join(shared, ["k", "block"]))
    within = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= RADIUS
    starred = near.where((F.col("fp") != F.col("one")) & within("fp", "one"))
    # of its stars a fingerprint keeps the least: those that keep the same one are linked by it
    labels = starred.groupBy("fp").agg(F.min("one").alias("c"))
    joined = staged(near.join(labels, "fp", "left").select("k", "block", "fp", F.coalesce("c", "fp").alias("c")))
    apart = joined.groupBy("k", "block").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("k", "block")
    left = joined.join(apart, ["k", "block"])
    a, b = left.select("k", "block", F.col("fp").alias("src"), F.col("c").alias("c")), left.select("k", "block", F.col("fp").alias("dst"), F.col("c").alias("d"))
    pairs = a.join(b, ["k", "block"]).where((F.col("c") < F.col("d")) & within("src", "dst")).select("src", "dst").distinct()
    return starred.select(F.col("fp").alias("src"), F.col("one").alias("dst")).distinct().union(pairs)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component): the least key that a row reaches over links, itself included."""
    rows = staged(fingerprints(docs, text, key))
    nodes = staged(rows.groupBy("fp").agg(F.min("key").alias("least")))
    # the graph is over fingerprints, so rows without a key link like any other
    found = components(links(nodes.select("fp")), in_task=FEW_EDGES).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(named, "fp").select("key", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its fingerprint and the component it belongs to."""
    bounded_batches(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"),
    )
