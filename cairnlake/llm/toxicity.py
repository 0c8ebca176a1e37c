"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are character 5-grams of words that the training labels tell apart (likelihood ratio over
training rows). Every document becomes a TF-IDF vector over them, with document frequencies over all
documents. Training examples are indexed as posting lists cut into blocks of examples; each block keeps the
largest weight of each term. A query visits blocks by falling upper bound and stops when the bound cannot
beat its k-th neighbour, so the neighbours are exact. Votes weighted by cosine become a score through a
monotone map fitted on examples that vote without themselves; the neighbours are the evidence.

Bounds, all documented parameters: features are learned from MOST_TRAINING training rows; MOST_FEATURES features
and MOST_EXAMPLES examples whose vectors hold MOST_BYTES make the index that goes to the tasks, about 80 MB at
most at any corpus size; votes are calibrated on MOST_CALIBRATION of the examples. Beyond the bounds training
rows are sampled by a hash of their key.

Defined results: null and empty texts, and texts without features, get the rate of such training rows;
a label row with null toxic or null doc_id is left out, repeated label rows of a document count as the
greatest; repeated documents are scored once each, equal texts alike; a null doc_id is not held out; without
any labels every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.llm.common import WORD, bounded_batches, small_batches
from cairnlake.session import staged, table

GRAM = 5
MOST_FEATURES = 8192
MOST_EXAMPLES = 20_000
MOST_TRAINING = 100_000
MOST_BYTES = 32 << 20
MOST_CALIBRATION = 4_000
#: Documents that a task scores, about.
SCORED = 4096
#: A feature's likelihood ratio (2 ln) and how many times likelier it is in one class, at least.
LEAST_RATIO, LEAST_LIFT = 20.0, 4.0
NEIGHBOURS = 15
BLOCK = 64
EDGES = re.compile(r"^\W+|\W+$")
MOST_CACHED = 300_000


def features_of(word: str) -> list[str]:
    """The 5-grams of a word in lower case, without what surrounds its letters and with its ends marked; a short word is one."""
    w = EDGES.sub("", word.lower())
    if not w:
        return []
    marked = f"^{w}$"
    return list({marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))})


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature: documents with label 0 and 1 that hold it, summed over a task as far as memory allows."""
    cache: dict[str, list[str]] = {}
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([s[x] for x in names], pa.int64()) for s in seen)]
        for s in seen:
            s.clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "n0", "n1"])

    for batch in small_batches(batches):
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            grams: set[str] = set()
            for word in set(WORD.findall(text.as_py() or "")):
                found = cache.get(word)
                if found is None:
                    if len(cache) > MOST_CACHED // 4:
                        cache.clear()
                    found = cache[word] = features_of(word)
                grams.update(found)
            seen[1 if label else 0].update(grams)
        if len(seen[0]) > MOST_CACHED:
            yield out()
    yield out()


def select_features(training: DataFrame) -> list[str]:
    """The features that tell the labels of training (text, label) apart, strongest first; MOST_FEATURES at most."""
    grams = training.select("text", "label").mapInArrow(_gram_counts, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all0, all1 = training.agg(F.sum(F.lit(1) - F.col("label")), F.sum("label")).first()
    if not all0 or not all1:
        return []
    share = all1 / (all0 + all1)
    n = F.col("n0") + F.col("n1")
    part = lambda seen, p: F.when(seen > 0, seen * F.ln(seen / (n * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("n1"), share) + part(F.col("n0"), 1 - share))
    lift = F.ln(((F.col("n1") + 0.5) / all1) / ((F.col("n0") + 0.5) / all0))
    kept = grams.where((ratio >= LEAST_RATIO) & (F.abs(lift) >= np.log(LEAST_LIFT)))
    return [r.feature for r in kept.orderBy(ratio.desc(), "feature").limit(MOST_FEATURES).select("feature").collect()]


def _vectors(features: list[str]):
    """Texts to counts of features, as pairs of 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {f: i for i, f in enumerate(features)}
        cache: dict[str, list[int]] = {}
        for batch in small_batches(batches):
            out = []
            for text in batch.column("text"):
                counts: Counter = Counter()
                for word in WORD.findall(text.as_py() or ""):
                    found = cache.get(word)
                    if found is None:
                        if len(cache) > MOST_CACHED:
                            cache.clear()
                        found = cache[word] = [ids[f] for f in features_of(word) if f in ids]
                    if found:
                        counts.update(found)
                out.append(np.array(sorted(counts.items()), dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in batch.schema.names if x != "text"), pa.array(out, pa.binary())], names=[*(x for x in batch.schema.names if x != "text"), "counts"])

    return run


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for x in batch.column("counts"):
            seen.update(np.frombuffer(x.as_py(), "<i4")[::2].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["id", "n"])


class Index:
    """Examples as TF-IDF vectors in posting lists by term and block, with the largest weight of each."""

    def __init__(self, idf: np.ndarray, counts: list[bytes], labels: list[int], keys: list, prior: float) -> None:
        self.idf, self.prior = idf, prior
        vectors = [self.vector(c) for c in counts]
        # examples with like vectors share blocks: bounds are tighter
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist(), i))
        self.labels = np.array([labels[i] for i in order], dtype=np.int8)
        self.keys = [keys[i] for i in order]
        terms = np.concatenate([vectors[i][0] for i in order]) if order else np.empty(0, np.int64)
        weights = np.concatenate([vectors[i][1] for i in order]) if order else np.empty(0)
        rows = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]) if order else np.empty(0, np.int64)
        by = np.lexsort((rows, terms))
        self.rows, self.weights, terms = rows[by], weights[by], terms[by]
        self.starts = np.searchsorted(terms, np.arange(len(idf) + 1))
        blocks = self.rows // BLOCK
        cut = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])]) if len(terms) else np.empty(0, np.int64)
        self.most = np.maximum.reduceat(self.weights, cut) if len(cut) else np.empty(0)
        self.most_block, self.cut = blocks[cut], np.r_[cut, len(terms)]
        self.most_starts = np.searchsorted(terms[cut], np.arange(len(idf) + 1))
        self.map: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vector(self, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.frombuffer(counts, "<i4").reshape(-1, 2)
        w = (1 + np.log(pairs[:, 1])) * self.idf[pairs[:, 0]]
        return pairs[:, 0].astype(np.int64), w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with any common term: exact, ties by row."""
        spans = [(self.most_starts[t], self.most_starts[t + 1], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True)]
        if not any(b > a for a, b, _ in spans):
            return np.empty(0, np.int64), np.empty(0)
        at = np.concatenate([np.arange(a, b) for a, b, _ in spans])
        q = np.concatenate([np.full(b - a, w) for a, b, w in spans])
        blocks = self.most_block[at]
        bound = np.bincount(blocks, q * self.most[at])
        order = np.argsort(-bound, kind="stable")
        by = np.argsort(blocks, kind="stable")
        first = np.searchsorted(blocks[by], order)
        last = np.searchsorted(blocks[by], order, side="right")
        rows, cosines = np.empty(0, np.int64), np.empty(0)
        step = 0
        while step < len(order):
            limit = np.partition(cosines, -k)[-k] if len(cosines) >= k else 0.0
            if bound[order[step]] < limit - 1e-12 or bound[order[step]] <= 0:
                break
            some = range(step, min(step + 8, len(order)))  # blocks at a time; more than needed does no harm
            parts = [by[first[i] : last[i]] for i in some]
            lists = np.concatenate(parts)
            sizes = self.cut[at[lists] + 1] - self.cut[at[lists]]
            ends = np.cumsum(sizes)
            post = np.arange(ends[-1]) + np.repeat(self.cut[at[lists]] - (ends - sizes), sizes)
            got, inverse = np.unique(self.rows[post], return_inverse=True)
            dots = np.bincount(inverse, self.weights[post] * np.repeat(q[lists], sizes))
            rows, cosines = np.concatenate([rows, got[got != skip]]), np.concatenate([cosines, dots[got != skip]])
            if len(rows) > k:
                best = np.lexsort((rows, -np.round(cosines, 9)))[:k]
                rows, cosines = rows[best], cosines[best]
            step += 8
        best = np.lexsort((rows, -np.round(cosines, 9)))[:k]
        return rows[best], cosines[best]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Labels weighted by squared cosines, with the prior as one neighbour at cosine 0.3."""
        w = cosines * cosines
        return float(((w * self.labels[rows]).sum() + 0.09 * self.prior) / (w.sum() + 0.09))

    def calibrate(self, counts: list[bytes], labels: list[int], most: int = MOST_CALIBRATION) -> None:
        """Fit the monotone map from votes to rates: pooled neighbours over examples that vote without themselves."""
        vectors = [self.vector(c) for c in counts]
        own = {k: i for i, k in enumerate(self.keys)}
        votes = sorted((self.vote(*self.nearest(*vectors[i], skip=own[i])), labels[i]) for i in range(min(most, len(counts))))
        pools: list[list[float]] = [[0.0, 1.0, 0.0]]  # vote, weight, rate; one pseudo-row at either end
        for v, y in [*votes, (1.0, 1)]:
            pools.append([v, 1.0, float(y)])
            while len(pools) > 1 and pools[-2][2] >= pools[-1][2] and len(pools) > 2:
                b, a = pools.pop(), pools.pop()
                n = a[1] + b[1]
                pools.append([(a[0] * a[1] + b[0] * b[1]) / n, n, (a[2] * a[1] + b[2] * b[1]) / n])
        self.map = (np.array([p[0] for p in pools]), np.array([p[2] for p in pools]))

    def score(self, counts: bytes) -> tuple[float, list]:
        if not counts:
            return self.prior, []
        rows, cosines = self.nearest(*self.vector(counts))
        if not len(rows):
            return self.prior, []
        return float(np.interp(self.vote(rows, cosines), *self.map)), [(self.keys[r], round(float(c), 6)) for r, c in zip(rows[:3].tolist(), cosines, strict=False)]


def _scored(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [index.score(x.as_py()) for x in batch.column("counts")]
            names = [x for x in batch.schema.names if x != "counts"]
            evidence = pa.array([[{"doc_id": k, "cosine": c} for k, c in e] for _, e in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([s for s, _ in got], pa.float64()), evidence], names=[*names, "score", "evidence"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", is_held_out=held_out) -> DataFrame:
    """(key, held_out, score, evidence) for every row of docs; held-out rows' labels are not used."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__k")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("label"))
    known = known.where(~is_held_out(F.col("__k")))
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sample = known.orderBy(F.xxhash64("__k"), "__k").limit(MOST_TRAINING)  # some MB at most
    training = d.join(F.broadcast(sample), F.col("key") == F.col("__k")).select("text", "label")
    features = select_features(training)
    vectors = staged(d.mapInArrow(_vectors(features), "key bigint, counts binary"))
    n, df = vectors.count(), np.zeros(len(features))
    for r in vectors.select("counts").mapInArrow(_document_frequencies, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[r.id] = r.n
    idf = np.log((1 + n) / (1 + df)) + 1
    labelled = vectors.join(known, F.col("key") == F.col("__k"))
    empty = labelled.where(F.length("counts") == 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = empty[1] / empty[0] if empty[0] else 0.0
    order = (F.xxhash64("key"), F.col("key"), F.col("counts"))
    some = labelled.where(F.length("counts") > 0).orderBy(*order).limit(MOST_EXAMPLES).select("key", "counts", "label")
    held = F.sum(F.length("counts")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    examples = some.withColumn("held", held).where(F.col("held") <= MOST_BYTES).orderBy(*order).drop("held").collect()
    counts, marks = [bytes(r.counts) for r in examples], [r.label for r in examples]
    index = Index(idf, counts, marks, list(range(len(examples))), prior)
    index.calibrate(counts, marks)
    index.keys = [examples[i].key for i in index.keys]
    spread = vectors.repartition(max(1, n // SCORED))  # vectors are small, so their files would make few tasks
    return spread.mapInArrow(_scored(index), "key bigint, score double, evidence array<struct<doc_id:bigint,cosine:double>>").select(
        "key", is_held_out(F.col("key")).alias("held_out"), "score", "evidence"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: whether it is held out, its score, the prediction, and the nearest examples."""
    bounded_batches(spark)
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("key").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
