"""I-Match document fingerprints: terms within a band of document frequencies, hashed over random lexicon subsets.

Document frequencies are counted over all documents; the lexicon holds the terms whose share of documents
lies in [LEAST_SHARE, MOST_SHARE], the chosen band of inverse document frequency. Besides the whole lexicon,
random subsets keep a term with probabilities from 1/16 down, so texts of any length have subsets that hold
a few of their terms. A component hashes the sorted distinct terms that a text has in a subset; the
fingerprint is its components, and likeness is the share of equal ones among those that either text has.

The lexicon is broadcast: it has at most (mean distinct terms of a document) / LEAST_SHARE terms, however
many documents there are, at 8 bytes each.

Defined results: a null text counts as empty; a text without band terms is fingerprinted by all its terms,
an empty one by none (all components 0, likeness 1 to another such); equal texts have equal fingerprints;
null doc_ids are ordered below all others and ties by a hash of the text; the next document of a single row
is itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import WORD, bounded_batches, small_batches
from cairnlake.session import table

LEAST_SHARE, MOST_SHARE = 0.001, 0.05
#: The whole lexicon once, then EACH subsets at every probability 2^-n for n in SCALES.
SCALES, EACH = range(4, 13), 6
SUBSETS = 1 + len(SCALES) * EACH
MOST_CACHED = 300_000
_SEEDS = np.array([xxhash.xxh64_intdigest(b"subset", k) for k in range(SUBSETS)], dtype=np.uint64)
_LIMITS = np.array([(1 << (64 - n)) - 1 for n in (0, *(n for n in SCALES for _ in range(EACH)))], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def terms_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def components(terms: list[np.ndarray]) -> np.ndarray:
    """The components (uint32, 0: none) of texts given as sorted distinct term hashes."""
    out = np.zeros((len(terms), SUBSETS), dtype=np.uint32)
    sizes = np.array([len(t) for t in terms])
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    flat = np.concatenate([terms[i] for i in has])
    starts = (np.cumsum(sizes) - sizes)[has]
    for k in range(SUBSETS):
        mixed = _mixed(flat + _SEEDS[k])
        chosen = mixed <= _LIMITS[k]
        # a sum over the distinct terms hashes their sorted list
        sums = np.add.reduceat(np.where(chosen, _mixed(mixed + _SEEDS[0]), np.uint64(0)), starts)
        some = np.add.reduceat(chosen, starts, dtype=np.int64) > 0
        out[has, k] = np.where(some, np.maximum(_mixed(sums) >> np.uint64(32), np.uint64(1)), np.uint64(0))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of equal components among those that either has; 1 where neither has any.

    Scales where every subset holds terms of the texts are left out if sparser ones hold some: a subset with
    many terms of a text changes with any edit, one with a single term changes as seldom as the term does.
    """
    either = (a != 0) | (b != 0)
    sparse = np.repeat(either[:, 1:].reshape(len(a), len(SCALES), EACH).sum(axis=2) < EACH, EACH, axis=1)
    sparse = np.concatenate([np.zeros((len(a), 1), dtype=bool), sparse], axis=1) & either
    either = np.where(sparse.any(axis=1)[:, None], sparse, either)
    n = either.sum(axis=1)
    return np.where(n > 0, ((a == b) & either).sum(axis=1) / np.maximum(n, 1), 1.0)


class _Hasher:
    """Texts to sorted term hashes within the lexicon; words seen before are looked up."""

    def __init__(self, lexicon: np.ndarray) -> None:
        self.lexicon = lexicon
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = terms_of(text)
        cache = self.cache
        if len(cache) > MOST_CACHED:
            cache.clear()
        if new := [w for w in words if w not in cache]:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in new], dtype=np.uint64)
            at = np.searchsorted(self.lexicon, hashes)
            known = np.zeros(len(new), dtype=bool)
            inside = at < len(self.lexicon)
            known[inside] = self.lexicon[at[inside]] == hashes[inside]
            cache.update(zip(new, np.where(known, hashes, np.uint64(0)).tolist(), strict=True))
        found = {h for w in words if (h := cache[w])}
        if not found:
            found = {xxhash.xxh64_intdigest(w) for w in words}
        return np.array(sorted(found), dtype=np.uint64)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 16 << 20):
        seen: Counter = Counter()
        for x in batch.column("text"):
            seen.update(terms_of(x.as_py() or ""))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in seen], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])


def lexicon(docs: DataFrame, n_docs: int, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band, from docs (text)."""
    counts = docs.select("text").mapInArrow(_term_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= least * n_docs) & (F.col("n") <= max(most * n_docs, 1))).select("term").toPandas()
    return np.sort(band["term"].to_numpy(np.int64).view(np.uint64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in small_batches(batches):
        texts = [pack((x or "").encode()) for x in batch.column("text").to_pylist()]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(texts, pa.binary())], names=[*names, "packed"])


def _chained(lexicon: np.ndarray):
    """Rows by bucket and rising key, a guest first in each bucket: every row and the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, unpack = _Hasher(lexicon), zstandard.ZstdDecompressor().decompress
        before, fp_before = "", np.zeros(SUBSETS, dtype=np.uint32)
        for batch in small_batches(batches, 1 << 18):
            texts = [unpack(x).decode() for x in batch.column("packed").to_pylist()]
            guests = np.array(batch.column("guest").to_pylist(), dtype=bool)
            own = components([hasher(t) for t in texts])
            edited = []
            for t, b in zip(texts, [before, *texts[:-1]], strict=True):
                half = len(t) // 2
                edited.append(t[: len(t) - half] + b[:half])
            changed = components([hasher(t) for t in edited])
            previous = np.concatenate([fp_before[None], own[:-1]])
            before, fp_before = texts[-1], own[-1]
            at = np.flatnonzero(~guests)
            hexes = lambda fp: pa.array([fp[i].astype(">u4").tobytes().hex() for i in at], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(at)), pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in at], pa.string()), hexes(own), hexes(changed),
                    pa.array(likeness(own, changed)[at]), pa.array(likeness(own, previous)[at]),
                ],
                names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def fingerprint_chain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs its fingerprint, that of its edited text, and its likeness to that and to the next row.

    Rows are dealt to ranges of keys by boundaries found beforehand from the keys alone, and the last row of a
    range visits the next one as a guest, so whole texts are shuffled once, compressed, and no task sees more than its range.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(d.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    d = d.withColumn("bucket", F.when(F.col("key").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("key")))))
    order = F.struct(F.col("key").isNotNull().alias("some"), "key", F.xxhash64("text").alias("hash"))
    # one row for each range
    ends = sorted((r.bucket, r.n, tuple(r.last)) for r in d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last")).collect())
    n_docs = sum(n for _, n, _ in ends)
    words = lexicon(d, n_docs)
    hosts = [(last[1], last[2], to) for (_, _, last), (to, _, _) in zip([*ends[-1:], *ends[:-1]], ends, strict=True)]
    known = spark.createDataFrame(hosts, "k bigint, h bigint, visit int")  # a row for each range
    on = F.col("key").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("h"))
    guests = d.join(F.broadcast(known), on).select("key", "text", F.col("visit").alias("bucket"))
    both = d.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).withColumn("hash", F.xxhash64("text"))
    packed = both.select("key", "bucket", "guest", "hash", "text").mapInArrow(_packed, "key bigint, bucket int, guest boolean, hash bigint, packed binary")
    dealt = packed.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", F.col("guest").desc(), F.col("key").asc_nulls_first(), "hash")
    schema = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("key", "packed", "guest").mapInArrow(_chained(words), schema)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its I-Match fingerprint beside those of its edited text and the next document."""
    bounded_batches(spark)
    return fingerprint_chain(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
