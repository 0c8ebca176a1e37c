"""Mixing sources to target weights over fixed-length blocks of words.

Each source's documents, in order, are one run of words cut into blocks of `block` words. A source's target
becomes a number of slots; a multinomial draw deals them to output shards; slot j of a source takes block
permutation(j) of the source (a Feistel permutation per source and pass, so a block is taken again only when
all were taken); slots and blocks are joined by index. Draws are seeded, so reruns agree.

Defined results: a null or empty text has size 0 and nothing is taken of it; null is a source of its own,
last; ties in doc_id are ordered by size; repeated rows are separate documents; an empty table gives no
rows; names that begin with two underscores are reserved, other columns are passed through by mixed_texts.

Running sums are made inside range partitions of (source, doc_id) and shifted by the sums of the partitions
before, so a source with a third of all rows is spread like any other. The driver holds one number per step
of the shares; sources, slots and blocks stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.llm.common import WORD, WORD_SQL, bounded_batches, small_batches
from cairnlake.session import staged, table

BLOCK = 64
SLOTS_PER_SHARD = 4096
#: Ranges of shards among which a source's slots are drawn first, so that no task draws for all shards.
RANGES = 4096
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST_TIMES = 2
SEED = 7


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, a row number in it and the words before each row in its source, within the partition."""
    part, i, source, before = TaskContext.get().partitionId(), 0, object(), 0
    for batch in batches:
        starts = []
        for s, n in zip(batch.column("__source").to_pylist(), batch.column("__size").to_pylist(), strict=True):
            if s != source:
                source, before = s, 0
            starts.append(before)
            before += n
        rows = len(starts)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(i, i + rows) + (part << 33)), pa.array(starts, pa.int64())],
            names=[*batch.schema.names, "__part", "__row", "__within"],
        )
        i += rows


def laid_out(docs: DataFrame, source: str, text: str, key: str, keep: list[str]) -> DataFrame:
    """A written table: `keep` with __source, __size, __row (unique), __part and __within, the words before it there."""
    spark = docs.sparkSession
    sized = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source"), F.col(f"`{key}`").alias("__key"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_SQL)), F.lit(0)).cast("bigint").alias("__size"),
    )
    order = [F.col("__source").asc_nulls_last(), F.col("__key").asc_nulls_last(), F.col("__size")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields] + ["__part int", "__row bigint", "__within bigint"])
    return staged(ranged.mapInArrow(_running, schema))


def starts(rows: DataFrame) -> DataFrame:
    """(__row, __source, __size, __start): the words before each row in its source, from laid_out rows."""
    rows = rows.select("__row", "__source", "__size", "__part", "__within")
    # one row for each source in each partition
    sums = rows.groupBy("__source", "__part").agg(F.sum("__size").alias("__sum"))
    shift = sums.select(
        F.col("__source").alias("__s"), F.col("__part").alias("__p"),
        F.coalesce(F.sum("__sum").over(Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"),
    )
    joined = rows.join(shift, rows["__source"].eqNullSafe(shift["__s"]) & (rows["__part"] == shift["__p"]))
    return joined.select("__row", "__source", "__size", (F.col("__within") + F.col("__shift")).alias("__start"))


def shares(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, source_size).

    Sources in order of code points, null last, take `weights` in turn and share total * all sizes; a target
    stops at most * its source's size, and the rest is shared again by weight until none is above. Each round
    is one sum over sources.
    """
    # ranks by range partitions and the numbers of rows before them, not by one task
    order = F.col("source").asc_nulls_last()
    ranged = staged(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sums = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    ranked = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    ranked = ranked.select(*sizes.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    ranked = staged(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))))
    cap = most * F.col("source_size")
    all_words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # those whose share at this level is above their cap stay at the cap
        at_cap = F.col("weight") * level > cap
        held, free = ranked.agg(F.sum(F.when(at_cap, cap).otherwise(0.0)), F.sum(F.when(~at_cap, F.col("weight")).otherwise(0.0))).first()
        if not free:
            break
        new = (total * all_words - held) / free
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("weight") * level, cap))


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at positions j: a Feistel network on the next even number of bits, walked until inside."""
    if n <= 1:
        return np.zeros(len(j), np.int64)
    half = max(1, ((int(n - 1).bit_length()) + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), np.array(j, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (2**64 - 1))) * np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _ranges(seed: int):
    """Of each source the slots of each range of shards: a seeded multinomial draw by the ranges' sizes, RANGES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, blocks, slots, shards in zip(*(batch.column(c).to_pylist() for c in ("rank", "blocks", "slots", "shards")), strict=True):
                wide = -(-shards // RANGES)
                lo = np.arange(0, shards, wide)
                sizes = np.minimum(lo + wide, shards) - lo
                counts = np.random.default_rng([seed, rank]).multinomial(slots, sizes / shards)
                full = lambda x: pa.array(np.full(len(lo), x, np.int64))
                yield pa.RecordBatch.from_arrays([full(rank), full(blocks), pa.array(lo), pa.array(sizes), pa.array(np.cumsum(counts) - counts), pa.array(counts)], names=["rank", "blocks", "lo", "size", "first", "count"])

    return run


def _dealt(seed: int):
    """Of each source and range the slots of each shard: a seeded multinomial draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, blocks, lo, size, begin, slots in zip(*(batch.column(c).to_pylist() for c in ("rank", "blocks", "lo", "size", "first", "count")), strict=True):
                counts = np.random.default_rng([seed, rank, lo]).multinomial(slots, np.full(size, 1 / size))
                first = begin + np.cumsum(counts) - counts
                some = np.flatnonzero(counts)
                for a in range(0, len(some), 10_000):
                    at = some[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), rank, np.int64)), pa.array(np.full(len(at), blocks, np.int64)), pa.array(lo + at), pa.array(first[at]), pa.array(counts[at])],
                        names=["rank", "blocks", "shard", "first", "count"],
                    )

    return run


def _slots(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, blocks, shard, first, count in zip(*(batch.column(c).to_pylist() for c in ("rank", "blocks", "shard", "first", "count")), strict=True):
                j = np.arange(first, first + count)
                turn = j // blocks
                block = np.empty(count, np.int64)
                for t in np.unique(turn).tolist():
                    block[turn == t] = permuted(j[turn == t] % blocks, blocks, (seed << 40) + (rank << 8) + t)
                full = lambda x: pa.array(np.full(count, x, np.int64))
                yield pa.RecordBatch.from_arrays([full(rank), full(shard), pa.array(j), pa.array(turn), pa.array(block)], names=["rank", "shard", "slot", "turn", "block"])

    return run


def slots(targets: DataFrame, block: int = BLOCK, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(rank, shard, slot, turn, block): every slot of the mix and the block it takes."""
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block)
    plan = targets.where("source_size > 0").select(F.col("rank").cast("bigint").alias("rank"), blocks.alias("blocks"), F.round(F.col("target") * blocks / F.col("source_size")).cast("bigint").alias("slots"))
    shards = max(1, -(-(plan.agg(F.sum("slots")).first()[0] or 0) // per_shard))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = plan.withColumn("shards", F.lit(shards).cast("bigint")).mapInArrow(_ranges(seed), "rank bigint, blocks bigint, lo bigint, size bigint, first bigint, count bigint")
    dealt = ranges.repartition(parts, "lo", "rank").mapInArrow(_dealt(seed), "rank bigint, blocks bigint, shard bigint, first bigint, count bigint")
    spread = dealt.repartition(parts, "shard", "rank")
    return spread.mapInArrow(_slots(seed), "rank bigint, shard bigint, slot bigint, turn bigint, block bigint")


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", keep: list[str] | None = None, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix: (rows, targets, pieces).

    rows: `keep` with __source, __size, __row; targets: as shares() gives; pieces: (__row, shard, slot,
    turn, first, n) - which words of a row each slot takes. The order of words in a shard is that of its slots.
    """
    rows = laid_out(docs, source, text, key, docs.columns if keep is None else keep)
    targets = shares(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")))
    ranked = targets.select(F.col("source").alias("__s"), F.col("rank").cast("bigint").alias("rank"))
    # sources beside rows: a source may hold a third of them, and the join can split it
    held = (
        starts(rows.where("__size > 0")).join(ranked, F.col("__source").eqNullSafe(F.col("__s")))
        .select("__row", "rank", "__start", "__size", F.explode(F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("__size") - 1) / block))).alias("block"))
    )
    first = F.greatest(F.col("block") * block - F.col("__start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("__start"), F.col("__size"))
    held = held.select("__row", "rank", "block", first.alias("first"), (last - first).alias("n"))
    # slots grow with the corpus, which their plan's size estimate does not show: never broadcast them
    pieces = held.join(slots(targets, block, seed=seed).hint("merge"), ["rank", "block"]).select("__row", "shard", "slot", "turn", "first", "n")
    return rows, targets, pieces


def _cut(text: str):
    """Puts the taken words in place of a text; a text taken whole stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for x, size, taken, spans in zip(batch.column(text), batch.column("__size").to_pylist(), batch.column("__taken").to_pylist(), batch.column("__spans"), strict=True):
                if taken == size:
                    out.append(x.as_py())
                    continue
                words = WORD.findall(x.as_py())
                out.append(" ".join(w for a, n in sorted((s["first"], s["n"]) for s in spans.as_py()) for w in words[a : a + n]))
            names = [x for x in batch.schema.names if x not in ("__size", "__taken", "__spans")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if x == text else batch.column(x) for x in names], names=names)

    return run


def mixed_texts(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """The mix as documents with docs' columns: a row for each turn in which something of a document is taken.

    A document taken whole keeps its text as it is; of others the taken words remain, joined by one space.
    """
    rows, _, pieces = mix(docs, source, text, key)
    taken = pieces.groupBy("__row", "turn").agg(F.sum("n").alias("__taken"), F.collect_list(F.struct("first", "n")).alias("__spans"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = rows.select("__row", *names, "__size").join(taken, "__row").select(*names, "__size", "__taken", "__spans")
    out = found.mapInArrow(_cut(text), docs.schema)
    return out.select(*[F.length(F.col(f"`{text}`")).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its size, its source's size and target, and the words that the mix takes."""
    bounded_batches(spark)
    rows, targets, pieces = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    taken = pieces.groupBy("__row").agg(F.sum("n").alias("taken"))
    t = targets.select(F.col("source").alias("__s"), "source_size", "target")
    return (
        rows.join(taken, "__row", "left").join(t, F.col("__source").eqNullSafe(F.col("__s")))
        .select("doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
