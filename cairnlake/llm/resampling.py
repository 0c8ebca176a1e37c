"""Importance resampling towards a target: hashed n-gram features, gains by bucket, Gumbel draws without replacement.

Words of a chunk of text are mapped to the integer ids of its dictionary, n-grams are tuples of ids packed in one
integer, and each distinct tuple's bytes are hashed once a chunk; the ids of distinct tuples join the hashes back to
occurrences. A document is written once as its sorted buckets; bucket totals (a number for each of `buckets`
buckets, whatever the input) give the gains, and a second pass over the written buckets sums them.

Defined results: a null or empty text has no features and weight 0; ties in score go to the smaller key, a null key
last; repeated rows are separate documents; an empty table gives no rows, and an empty target gains as if its counts
were zero; a null key draws by the text `<seed>:`. Columns named n_words, n_features, weight, score or rank are
replaced; names that begin with two underscores are reserved; other columns are passed through.

A chunk holds about four megabytes of text, and of a longer document PIECE words at a time, so memory stays bounded
by the longest single text. The order of the draw is made by range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.batches import pack, unpack
from cairnlake.llm.common import bounded_batches, coded_words, numbered, small_batches
from cairnlake.session import staged, table

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Words whose tuples are told apart at a time; an id takes 20 bits, and so does a tuple's.
PIECE = (1 << 20) - 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, lower-case letters and every byte of a character beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def _hashed(ids: np.ndarray, words: list[bytes], doc: np.ndarray, own: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of 1 to `longest` words that begins in the first `own` of these words."""
    # a run of one word: its id; of n words: the id of its first n - 1 words, which is kept dense, and of its last
    run, seen = ids.astype(np.int64), np.array([crc32(w) for w in words], np.uint32)
    docs, found = [doc[:own]], [(seen % buckets).astype(np.uint16)[run[:own]]]
    for n in range(2, longest + 1):
        m = len(ids) - n + 1
        if m <= 0:
            break
        at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
        if not len(at):
            break
        tuples = pa.array((run[at] << 20) | ids[at + n - 1]).dictionary_encode()
        distinct, of = tuples.dictionary.to_numpy(), tuples.indices.to_numpy()
        # the bytes of the run before, a space and the last word, each distinct tuple once
        spaced = [crc32(b" ", c) for c in seen.tolist()]
        last = map(words.__getitem__, (distinct & 0xFFFFF).tolist())
        seen = np.fromiter(map(crc32, last, map(spaced.__getitem__, (distinct >> 20).tolist())), np.uint32, len(distinct))
        run = np.zeros(len(ids), np.int64)
        run[at] = of
        mine = at < own
        docs.append(doc[at[mine]])
        found.append((seen % buckets).astype(np.uint16)[of[mine]])
    return np.concatenate(docs), np.concatenate(found)


def _featured(text: str, longest: int, buckets: int):
    """Replaces the texts by __words, __features and __buckets, the packed differences of the sorted buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            ids, words, bounds = coded_words(texts, _INSIDE, _LOWER)
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            keys = []
            for a in range(0, len(ids), PIECE):
                part = slice(a, a + PIECE + longest - 1)
                own, local = np.unique(ids[part], return_inverse=True) if len(words) > PIECE else (None, ids[part])
                docs, found = _hashed(local, words.take(pa.array(own)).to_pylist() if own is not None else words.to_pylist(), doc[part], min(PIECE, len(ids) - a), longest, buckets)
                keys.append(docs * buckets + found)
            sorted_keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
            cut = np.searchsorted(sorted_keys, np.arange(len(texts) + 1) * buckets)
            each = [np.diff(sorted_keys[a:b], prepend=i * buckets).astype(np.uint16) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))]
            names = [x for x in batch.schema.names if x != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(np.diff(bounds)), pa.array(np.diff(cut)), pa.array([pack(x) for x in each], pa.binary())],
                names=[*names, "__words", "__features", "__buckets"],
            )

    return run


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """A written table: `keep` (all columns: None) with __words, __features and __buckets of every text."""
    keep = docs.columns if keep is None else keep
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered in 16 bits")
    wide = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[:-1]]
    return staged(wide.mapInArrow(_featured("__text", longest, buckets), ", ".join([*schema, "__words bigint, __features bigint, __buckets binary"])))


def _summed(buckets: int):
    """A task's number of features in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("__buckets").to_pylist():
                n += np.bincount(np.cumsum(unpack(x, np.uint16), dtype=np.int64), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return run


def totals(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all documents by bucket."""
    return featured.select("__buckets").mapInArrow(_summed(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): of every bucket floor(1000 ln(share in the target / share in the source)), each count raised by one."""
    s, t = (x.select("bucket", F.col("n").cast("double").alias(n)) for x, n in ((source, "s"), (target, "t")))
    all_s, all_t = (x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for x in (source, target))
    each = source.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0.0, ["s", "t"])
    ratio = (F.col("t") + 1.0) * F.lit(all_s + buckets) / ((F.col("s") + 1.0) * F.lit(all_t + buckets))
    return each.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain"))


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.cumsum(unpack(x, np.uint16), dtype=np.int64)].sum()) for x in batch.column("__buckets").to_pylist()]
            names = [x for x in batch.schema.names if x != "__buckets"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(weights, pa.int64())], names=[*names, "__weight"])

    return run


def scored(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", keep: list[str] | None = None, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """`keep` (all columns: None) with n_words, n_features, weight and score, the weight with its Gumbel noise."""
    replaced = ("n_words", "n_features", "weight", "score", "rank")
    names = [c for c in (docs.columns if keep is None else keep) if c not in replaced]
    own = features(docs.withColumn("__key", F.col(f"`{key}`")), text, [*names, "__key"], longest, buckets)
    wanted = features(target, target_text, [], longest, buckets)
    # a number for each bucket, however large the input
    gain = np.zeros(buckets, np.int64)
    for r in gains(totals(own, buckets), totals(wanted, buckets), buckets).collect():
        gain[r.bucket] = r.gain
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "__buckets"] + ["__weight bigint"])
    weighed = own.mapInArrow(_weighed(gain), schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.select(
        *[F.col(f"`{c}`") for c in names], F.col("__words").alias("n_words"), F.col("__features").alias("n_features"), F.col("__weight").alias("weight"),
        (F.col("__weight") + noise).alias("score"), "__key",
    )


def draws(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored() rows with rank: 1, 2, ... of the `percent` of documents of least_words or more with the highest scores, else null."""
    able = F.col("n_words") >= least_words
    names = [F.col(f"`{c}`") for c in rows.columns if c != "__key"]
    placed = numbered(rows, able.desc(), F.col("score").desc(), F.col("__key").asc_nulls_last())
    n = placed.where(able).count()
    return placed.select(*names, F.when(able & (F.col("__rank") < n * percent // 100), F.col("__rank") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, whole, with n_words, n_features, weight, score and rank; options: of scored() and draws()."""
    of_draws = {k: options.pop(k) for k in ("percent", "least_words") if k in options}
    return draws(scored(docs, target, **options), **of_draws).where("rank IS NOT NULL")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its features, weight and score towards `benchmark`, and its rank in the draw."""
    bounded_batches(spark)
    out = draws(scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
