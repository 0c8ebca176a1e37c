"""Links of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: prefix filtering, exact check.

Shingles have one order: those that a sample of texts holds often come last, others by hash. Two sets of
similarity 0.8 meet in the first fifth of each, whatever the order is, so the sample decides only how many chance
partners are met. Texts are first linked to one text of each shared shingle, which settles large groups of near
copies without their pairs; then the pairs of different components that share a shingle of their prefixes are
taken, those whose counts or bits rule out the similarity are left out in the join, then those that sketches of as
many bits as a text has shingles rule out, and the rest are compared on all their shingles.

Defined results: words and letter case are those of SimHash; a text of fewer than five words is one shingle;
texts without words have none and are not linked here; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.batches import CODES_SQL, SENT_SQL, answered, answers_by_batch, bucket_bits, cells, distinct, each_bucket, pack, read_codes, readers, sent_names, unpack
from cairnlake.llm.common import small_batches
from cairnlake.llm.simhash import shingle_hashes
from cairnlake.operators.graph import FEW_EDGES, components
from cairnlake.session import drop_staged, released, staged

SHINGLE = 5
#: Texts whose shingles are counted for the order, and frequent shingles that are remembered; neither changes a result.
SAMPLE, MOST_FREQUENT = 4_000, 200_000
#: Nodes in pairs up to which they are broadcast, so that texts are not shuffled.
MOST_ENDS = 200_000
#: Pairs of one text that a task compares, about.
HUB = 500
#: Rows of prefixes that a task joins, about, and rows of one shingle that meet in a task.
ROWS, HOT = 20_000, 2_000
#: Bits of a text: bit i tells whether an odd number of its shingles are i modulo BITS. Two texts differ in as many shingles as bits, at least.
BITS = 512


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        seen: Counter = Counter()
        for text in batch.column("text"):
            seen.update(shingle_set(text.as_py()).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that several texts of the sample hold."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text")
    found = sample.mapInArrow(_counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    rows = found.orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """Bytes whose bit i tells whether an odd number of the shingles s are i modulo bits, a power of two."""
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def sketch_size(n: int) -> int:
    """Bits of the sketch of n shingles: the power of two from n on, BITS at least."""
    return max(BITS, 1 << (n - 1).bit_length())


def may_be_similar(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether the sketches of n and m shingles allow similarity 0.8: they differ in no more bits than the sets in shingles.

    A sketch of twice the bits is folded: residues i and i + size are one residue modulo size.
    """
    size = 8 * min(len(x), len(y))
    folded = []
    for z in (x, y):
        bits, z = 8 * len(z), int.from_bytes(z, "little")
        while bits > size:
            bits //= 2
            z = (z >> bits) ^ (z & ((1 << bits) - 1))
        folded.append(z)
    return 9 * (folded[0] ^ folded[1]).bit_count() <= n + m


PREFIX_SQL = "batch bigint, nodes binary, ns binary, sizes binary, first binary, bits binary, sketches binary"


def _prefixes(frequent: tuple[np.ndarray, np.ndarray]):
    """Batches of texts: their nodes, numbers of shingles, the first of these, of which similar texts share one, and their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = frequent
        part, number = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, 1 << 20):
            ns, first, bits, sketches = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                bits.append(parities(s, BITS).view(np.int64))
                sketches.append(parities(s, sketch_size(len(s))))
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.argsort(np.where(names[at] == s, counts[at], 0), kind="stable")]
                ns.append(len(s))
                first.append(s[: len(s) - (4 * len(s) + 4) // 5 + 1])
            if not ns:
                continue
            nodes = np.array(batch.column("node").to_pylist(), np.int64)
            columns = [nodes, np.array(ns, np.int32), np.array([len(x) for x in first], np.int32), np.concatenate(first), np.concatenate(bits), np.concatenate(sketches)]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), *(pa.array([pack(c)], pa.binary()) for c in columns)], names=["batch", "nodes", "ns", "sizes", "first", "bits", "sketches"])
            number += 1

    return run


def _names_sent(bits: int):
    """Each batch's distinct shingles of prefixes to the buckets of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, first in cells(rows, "batch", "first"):
                yield sent_names(batch, unpack(first, np.uint64), bits)

    return run


def _placed(bits: int):
    """(node, n, h, i, p): the shingles of prefixes that other places have too, each with its place and the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for codes, nodes, ns, sizes, first in cells(rows, "codes", "nodes", "ns", "sizes", "first"):
                h, sizes = unpack(first, np.uint64), unpack(sizes, np.int32)
                kinds, inverse = distinct(h, bits, inverse=True)
                at = np.flatnonzero(read_codes(codes, len(kinds))[inverse])
                owner = np.repeat(np.arange(len(sizes)), sizes)[at]
                i = at - (np.cumsum(sizes) - sizes)[owner]
                h = h.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpack(nodes, np.int64)[owner]), pa.array(unpack(ns, np.int32)[owner]), pa.array(h[at]), pa.array(i.astype(np.int32)), pa.array(h[np.maximum(at - 1, 0)], mask=i == 0)],
                    names=["node", "n", "h", "i", "p"],
                )

    return run


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for nodes, bits in cells(rows, "nodes", "bits"):
            nodes, flat = unpack(nodes, np.int64), unpack(bits, np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, BITS // 64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "bits"])


def _sketches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for nodes, ns, flat in cells(rows, "nodes", "ns", "sketches"):
            nodes, ns, flat = unpack(nodes, np.int64), unpack(ns, np.int32), unpack(flat, np.uint8).tobytes()
            ends = np.cumsum([sketch_size(int(n)) // 8 for n in ns])
            each = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ns), pa.array(each, pa.binary())], names=["node", "n", "s"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = zip(*(batch.column(c) for c in ("nx", "x", "ny", "y")), strict=True)
        yes = [may_be_similar(*(v.as_py() for v in row)) for row in ends]
        yield batch.select(["u", "v", "src", "dst"]).filter(pa.array(yes, pa.bool_()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column("text")], pa.binary())], names=["node", "s"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            yes.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield batch.select(["src", "dst"]).filter(pa.array(yes, pa.bool_()))


def both_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) with (n, s) of the values of u as nx, x and those of v as ny, y.

    A value goes to the task of v once for each pair; a v of more than HUB pairs is dealt to several tasks.
    """
    few = F.broadcast if pairs.count() <= MOST_ENDS else lambda df: df
    hubs = pairs.groupBy("v").agg((1 + F.floor(F.count(F.lit(1)) / HUB)).cast("int").alias("parts"))
    dealt = pairs.join(hubs, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).drop("parts")
    x = values.select(F.col("node").alias("u"), F.col("n").alias("nx"), F.col("s").alias("x")).join(few(dealt), "u")
    y = values.select(F.col("node").alias("v"), F.col("n").alias("ny"), F.col("s").alias("y")).join(few(hubs), "v")
    y = y.select("v", "ny", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return x.join(y.hint("merge"), ["v", "part"])


def verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v, cu, cv) of nodes that are similar, as links (src, dst) of their components."""
    pairs = staged(pairs.select("u", "v", F.col("cu").alias("src"), F.col("cv").alias("dst")))
    possible = staged(both_ends(pairs, sketches).select("u", "v", "src", "dst", "nx", "x", "ny", "y").mapInArrow(_possible, "u bigint, v bigint, src bigint, dst bigint"))
    ends = possible.select(F.col("u").alias("node")).union(possible.select(F.col("v").alias("node")))
    ends = staged(ends.distinct())
    few = F.broadcast(ends) if ends.count() <= MOST_ENDS else ends
    sets = staged(texts.select("node", "text").join(few, "node", "left_semi").mapInArrow(_packed, "node bigint, s binary"))
    met = both_ends(possible, sets.withColumn("n", F.lit(None).cast("int")))
    out = staged(met.select("src", "dst", "x", "y").mapInArrow(_similar, "src bigint, dst bigint"))
    for done in (pairs, possible, ends, sets):
        drop_staged(done)
    released(texts.sparkSession)
    return out


def _sizes_allow(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def shingle_components(rows: DataFrame, linked: DataFrame, text: str = "text", row: str = "__row") -> DataFrame:
    """(row, component): the components `linked` (key, component) of rows, joined where texts of theirs are similar."""
    t = F.col(f"`{text}`")
    base = staged(linked.select(F.col("key").alias(row), F.col("component").alias("c")))
    # equal texts are one node
    nodes = rows.groupBy(F.xxhash64(t), F.xxhash64(F.lit(1), t)).agg(F.min(row).alias("node"))
    named = nodes.select("node").join(base.withColumnRenamed(row, "node"), "node")
    texts = rows.select(F.col(row).alias("node"), t.alias("text"))
    # an exchange of packed names leaves the shingles that several places hold
    packed = staged(texts.mapInArrow(_prefixes(frequent_shingles(texts)), PREFIX_SQL))
    sketches = staged(packed.select("nodes", "ns", "sketches").mapInArrow(_sketches_of, "node bigint, n int, s binary"))
    batches = packed.count()
    name_bits, tasks = bucket_bits(batches, 1 << 20), readers(batches, 1 << 20)
    sent = packed.select("batch", "first").mapInArrow(_names_sent(name_bits), SENT_SQL)
    codes = answers_by_batch(each_bucket(sent, 1 << name_bits, answered(2**31), CODES_SQL), "codes", tasks)
    coded = packed.drop("bits", "sketches").repartition(tasks, "batch").join(codes.hint("merge"), "batch", "left")
    placed = coded.mapInArrow(_placed(name_bits), "node bigint, n int, h bigint, i int, p bigint")
    met = staged(placed.join(named, "node"))
    shared = met.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("h")
    near = staged(met.join(shared, "h"))
    drop_staged(met)
    released(rows.sparkSession)
    # one text of each shingle stands for all that hold it
    where = F.struct(F.xxhash64("node"), "node", "c", "n")
    star = near.join(near.groupBy("h").agg(F.min(where).alias("one")), "h")
    star = star.where((F.col("c") != F.col("one.c")) & _sizes_allow(F.col("n"), F.col("one.n")))
    star = star.groupBy(F.col("node").alias("u"), F.col("one.node").alias("v")).agg(F.first("c").alias("cu"), F.first("one.c").alias("cv"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    # a pair that is left out here is met again below, unless it has become one component
    first = verified(star.where("20 * m >= n"), texts, sketches)
    joined = staged(components(first, in_task=FEW_EDGES).select(F.col("node").alias("c"), F.col("component").alias("c1")))
    left = near.join(joined, "c", "left").withColumn("c1", F.coalesce("c1", "c"))
    apart = left.groupBy("h").agg(F.min("c1").alias("least"), F.max("c1").alias("most")).where("least < most").select("h")
    # A similar pair is met at the first shingle that its prefixes share: there the shingles before differ, and enough can
    # follow. The bits of both bound what they differ in from below. What remains is little, and compared exactly.
    left = staged(left.join(apart, "h").join(packed.mapInArrow(_bits_of, "node bigint, bits array<bigint>"), "node"))
    for done in (near, packed):
        drop_staged(done)
    # the rows of a frequent shingle are dealt to parts by component, and every part meets every part in a cell of its own
    often = left.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT)).cast("int").alias("parts")).where("parts > 1")
    parted = left.join(often, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tasks = max(1, left.count() // ROWS)
    a = parted.withColumn("other", others).repartition(tasks, "h", "part", "other").alias("a")
    b = parted.withColumn("other", F.col("part")).withColumn("part", others).repartition(tasks, "h", "part", "other").alias("b")
    both = F.col("a.n") + F.col("b.n")
    can_follow = 9 * F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= 4 * both
    new = F.col("a.p").isNull() | F.col("b.p").isNull() | (F.col("a.p") != F.col("b.p"))
    differ = sum((F.bit_count(F.get("a.bits", F.lit(k)).bitwiseXOR(F.get("b.bits", F.lit(k)))) for k in range(1, BITS // 64)), F.bit_count(F.get("a.bits", F.lit(0)).bitwiseXOR(F.get("b.bits", F.lit(0)))))
    cell = (F.col("a.h") == F.col("b.h")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.other") == F.col("b.other"))
    on = cell & (F.col("a.c1") < F.col("b.c1")) & _sizes_allow(F.col("a.n"), F.col("b.n")) & can_follow & new & (9 * differ <= both)
    pairs = a.join(b, on).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.c").alias("cu"), F.col("b.c").alias("cv")).distinct()
    second = verified(pairs, texts, sketches)
    final = components(first.union(second), in_task=FEW_EDGES).select(F.col("node").alias("c"), "component")
    return base.join(final, "c", "left").select(row, F.coalesce("component", "c").alias("component"))
