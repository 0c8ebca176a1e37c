"""Documents in packed batches, and a packed exchange that tells each batch which of its names others have too.

A batch is about four megabytes of whole documents, compressed, in one row, so that numpy works on arrays
instead of rows and a shuffle moves compressed bytes. Inside a batch work goes by pieces of a megabyte, and a
longer document is cut in overlapping pieces, so memory does not grow with its length. Names are 64-bit hashes;
a name meets itself in the bucket of its first bits. Each batch sends its distinct names of a bucket once,
sorted, as 32-bit differences, with their counts, so the most frequent name weighs no more than any other; the
bucket answers with one code per name. A bucket holds the names of a fixed volume of text, and is a partition of
its own: what a task reads does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.hashing import joined
from cairnlake.session import staged

BATCH = 4 << 20
#: Bytes of text of which a bucket of names, and a task that reads batches, holds its share.
BUCKET, READ = 32 << 20, 8 << 20
NO_KEY = 2**63 - 1
PACKED_SQL = "batch bigint, docs binary, hashes binary, sizes binary, blob binary"
CODES_SQL = "batch bigint, bucket bigint, codes binary"


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


def cells(batch: pa.RecordBatch | pa.Table, *names: str):
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batched(most: int):
    """Documents to packed batches; one ends when it holds `most` bytes or 50,000 documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, held = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[int, int, bytes]] = []

        def out() -> pa.RecordBatch:
            docs, hashes, texts = zip(*rows, strict=True)
            columns = [np.array(docs, np.int64).tobytes(), np.array(hashes, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + i], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["batch", "docs", "hashes", "sizes", "blob"])

        for batch in batches:
            for doc, h, text in zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), strict=True):
                rows.append((doc, h, text.as_py() or b""))
                held += len(rows[-1][2])
                if held >= most or len(rows) >= 50_000:
                    yield out()
                    rows, held, i = [], 0, i + 1
        if rows:
            yield out()

    return run


def packed_batches(docs: DataFrame, key: str, text: str, most: int = BATCH) -> DataFrame:
    """A written table of batches. docs: keys (null: NO_KEY); hashes: of the texts where keys repeat, else 0."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("text"))
    unique = d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR key IS NULL").isEmpty()
    h = F.lit(0).cast("bigint") if unique else F.xxhash64("text")
    placed = d.select(F.coalesce(F.col("key").cast("bigint"), F.lit(NO_KEY)).alias("doc"), h.alias("h"), "text")
    return staged(placed.mapInArrow(_batched(most), PACKED_SQL))


def texts_of(docs: bytes, hashes: bytes, sizes: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, hashes, and the joined bytes of a batch with their bounds."""
    raw = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    data, bounds = joined([raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
    return np.frombuffer(docs, np.int64), np.frombuffer(hashes, np.int64), data, bounds


def bucket_bits(n_batches: int, batch_bytes: int = BATCH) -> int:
    """First bits of a name that choose its bucket; with 32 more they are the name. Both grow with the input."""
    return min(24, max(4, (n_batches * batch_bytes // BUCKET).bit_length()))


def readers(n_batches: int, batch_bytes: int = BATCH) -> int:
    """Tasks that read batches: one for each READ bytes of text, 16 at least."""
    return max(16, n_batches * batch_bytes // READ)


def pieces(starts: np.ndarray, ends: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, starts, ends) of neighbouring documents in pieces of about `most`; longer ones are cut alone, with an overlap."""
    sizes = ends - starts
    alone = sizes > most
    number = np.cumsum(np.where(alone, 0, sizes)) // most
    cut = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | alone[1:] | alone[:-1]])) if len(sizes) else np.empty(0, np.int64)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(sizes)], strict=False):
        if not alone[i]:
            yield i, starts[i:j], ends[i:j]
            continue
        for at in range(int(starts[i]), int(ends[i]) - overlap, most - overlap):
            yield i, np.array([at]), np.array([min(at + most, int(ends[i]))])


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """Buckets of sorted 64-bit keys, and the slice of each."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.empty(0, np.int64)
    return bucket[cut], [slice(a, b) for a, b in zip(cut, [*cut[1:], len(keys)], strict=False)]


SENT_SQL = "bucket bigint, batch bigint, names binary, counts binary"


def sent_names(batch: int, names: np.ndarray, bits: int) -> pa.RecordBatch:
    """A batch's distinct names with their counts, a row for each bucket."""
    names, n = distinct(names, bits)
    buckets, parts = by_bucket(names, bits)
    low = ((names << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets), pa.array(np.full(len(buckets), batch)), pa.array([pack(np.diff(low[p], prepend=np.uint32(0))) for p in parts], pa.binary()),
            pa.array([pack(n[p].astype(np.uint32)) for p in parts], pa.binary()),
        ],
        names=["bucket", "batch", "names", "counts"],
    )


def _sent(names_of: Callable, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, *packed in cells(rows, "batch", "docs", "hashes", "sizes", "blob"):
                _, _, data, bounds = texts_of(*packed)
                yield sent_names(batch, names_of(data, bounds), bits)

    return run


def distinct(names: np.ndarray, bits: int, inverse: bool = False):
    """Distinct names cut to the bits that are sent, with their counts (or the index of each name)."""
    cut = (names >> np.uint64(32 - bits)) << np.uint64(32 - bits)
    return np.unique(cut, return_inverse=True) if inverse else np.unique(cut, return_counts=True)


def answered(hot: int):
    def run(rows: pa.Table) -> pa.Table:
        steps = [unpack(x, np.uint32) for x in rows.column("names").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in rows.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate([np.cumsum(s, dtype=np.uint32) for s in steps]), return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        codes = (total > 1).astype(np.uint8) + (total > hot).astype(np.uint8)
        ends = np.cumsum([len(s) for s in steps]).tolist()
        return pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "codes": pa.array([pack(codes[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    return run


def answers_by_batch(answers: DataFrame, name: str, tasks: int) -> DataFrame:
    """(batch, name): a batch's answers from all buckets."""
    return answers.repartition(tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("bucket", "codes")).alias(name))


def each_bucket(rows: DataFrame, buckets: int, of_bucket: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """of_bucket over all rows of each bucket 0..buckets - 1; every bucket is a partition of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from of_bucket(pa.Table.from_batches(held)).to_batches()

    return rows.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, schema)


def name_codes(packed: DataFrame, names_of: Callable, bits: int, hot: int, tasks: int) -> DataFrame:
    """(batch, codes): of each batch's distinct names whether one is met once (0), more often (1), or above hot times (2)."""
    sent = packed.mapInArrow(_sent(names_of, bits), SENT_SQL)
    return answers_by_batch(each_bucket(sent, 1 << bits, answered(hot), CODES_SQL), "codes", tasks)


def read_codes(codes: list | None, n: int) -> np.ndarray:
    """Answers in the order of sorted keys."""
    parts = [unpack(c["codes"], np.uint8) for c in sorted(codes or (), key=lambda c: c["bucket"])]
    out = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} keys")
    return out
