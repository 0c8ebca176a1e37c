"""Byte-level BPE encoding and decoding with a public tokenizer's ranks.

Encoding is one narrow pass. A task splits its documents into pieces by the tokenizer's pattern, numbers the
distinct ones, folds the ranked merges over each distinct piece's bytes once, and puts the pieces' ids in the
documents' order. No row is shuffled or broadcast, a lost task repeats its own split alone, and what a task
holds is bounded by MOST_PIECES and by its largest document. With native=True Spark higher-order functions
fold the merges, the ranks being a literal map in the plan; that gives the same ids at a higher cost (see the
README), so the default folds them in the task. Decoding looks every id up in a literal array and
concatenates the binary pieces, all in Spark expressions.

Defined results: a null or empty text has no ids; special tokens' strings are ordinary text; repeated rows
are encoded once each; an empty table gives no rows; other columns are passed through under their names.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, small_batches
from cairnlake.session import table

#: A task forgets its numbered pieces when it holds so many; they are folded anew if they come again.
MOST_PIECES = 400_000
#: Longer pieces (bytes) are merged with a heap: folding an array costs the square of its length.
LONG_PIECE = 256
BUCKETS = 1 << 16
NO_RANK = 2**31 - 1


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: lines of a base64 piece and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _literals(path: str) -> tuple[str, str]:
    """JSON of the rank map, dealt into buckets so that a lookup reads a few keys, and of the pieces by id."""
    ranks = load_ranks(path)
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = rank
        pieces[rank] = key
    return json.dumps(buckets, separators=(",", ":")), json.dumps(pieces, separators=(",", ":"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(piece_hex: Column, path: str) -> Column:
    """The ids of one piece, given as upper-case hex: merges of lowest rank first, leftmost among equals."""
    rank_map = F.from_json(F.lit(_literals(path)[0]), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        # Spark's xxhash64 is the unsigned XXH64 with seed 42 in 64 bits, so its low bits pick the bucket
        bucket = F.get(rank_map, F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.coalesce(F.element_at(bucket, piece), F.lit(NO_RANK))

    n = (F.length(piece_hex) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(piece_hex, 2 * i + 1, F.lit(2)))
    none = F.array().cast("array<int>")

    def pairs(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))).otherwise(none)

    def merged(parts: Column, ranks: Column, p: Column) -> Column:
        new = F.concat(F.element_at(parts, p), F.element_at(parts, p + 1))
        left = F.when(p > 1, F.array(rank(F.concat(F.element_at(parts, p - 1), new)))).otherwise(none)
        right = F.when(p + 2 <= F.size(parts), F.array(rank(F.concat(new, F.element_at(parts, p + 2))))).otherwise(none)
        return F.struct(
            F.concat(F.slice(parts, F.lit(1), p - 1), F.array(new), F.slice(parts, p + 2, F.size(parts))).alias("parts"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, F.size(parts))).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(state["ranks"])
        return F.when(least < NO_RANK, _let(F.array_position(state["ranks"], least).cast("int"), lambda p: merged(state["parts"], state["ranks"], p))).otherwise(state)

    start = _let(parts, lambda x: F.struct(x.alias("parts"), pairs(x).alias("ranks")))
    folded = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.transform(s["parts"], rank))
    return _let(rank(piece_hex), lambda whole: F.when(whole < NO_RANK, F.array(whole)).otherwise(folded))


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: merges of lowest rank first, leftmost among equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        new = parts[i] + parts[i + 1]
        parts[i : i + 2] = [new]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + new, NO_RANK)
        if i < len(pairs):
            pairs[i] = get(new + parts[i + 1], NO_RANK)
    return [ranks[x] for x in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long piece, in time near its length: a heap of pairs over a linked list."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Numbers(dict):
    """Numbers keys as they come and notes the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        value = self[key] = len(self)
        self.new.append(key)
        return value


def _split(pattern: str, most: int):
    """Documents to rows of their new distinct pieces (kind 0), then of themselves as numbers of pieces (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, numbers = regex.compile(pattern).findall, _Numbers()
        for batch in small_batches(batches):
            kept = [(x, batch.column(x)) for x in batch.schema.names if x != "__text"]
            if len(numbers) > most:
                numbers = _Numbers()
                yield _rows(2, 1, kept, pa.nulls(1, pa.binary()))
            at = numbers.__getitem__
            tokens = [np.fromiter(map(at, find(x.as_py() or "")), np.int32).tobytes() for x in batch.column("__text")]
            for i in range(0, len(numbers.new), 20_000):
                pieces = [x.encode() for x in numbers.new[i : i + 20_000]]
                yield _rows(0, len(pieces), kept, pa.array(pieces, pa.binary()))
            numbers.new.clear()
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(np.ones(len(tokens), np.int8)), pa.array(tokens, pa.binary())], names=[*(x for x, _ in kept), "__kind", "__data"])

    return run


def _encode(pattern: str, ranks: dict[bytes, int], most: int):
    """Documents to their ids, folding each new distinct piece once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, numbers = regex.compile(pattern).findall, _Numbers()
        flat, sizes = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in small_batches(batches):
            if len(numbers) > most:
                numbers, flat, sizes = _Numbers(), flat[:0], sizes[:0]
            at = numbers.__getitem__
            tokens = [np.fromiter(map(at, find(x.as_py() or "")), np.int32).tobytes() for x in batch.column("__text")]
            if numbers.new:
                ids = [(merge_short if len(b) <= LONG_PIECE else merge_long)(b, ranks) for b in map(str.encode, numbers.new)]
                flat = np.concatenate([flat, np.fromiter((i for x in ids for i in x), np.int32)])
                sizes = np.concatenate([sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
                numbers.new.clear()
            kept = [x for x in batch.schema.names if x != "__text"]
            part = pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(tokens, pa.binary())], names=[*kept, "__data"])
            yield from _documents(part, flat, np.cumsum(sizes) - sizes, sizes)

    return run


def _rows(kind: int, n: int, kept: list, data: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.nulls(n, c.type) for _, c in kept), pa.array(np.full(n, kind, np.int8)), data], names=[*(x for x, _ in kept), "__kind", "__data"])


def _assemble(ranks: dict[bytes, int]):
    """Puts pieces' ids in the documents' order; rows come as _split sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        starts = None
        for batch in batches:
            kinds = batch.column("__kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] == 2:
                    flat, sizes, starts = [np.empty(0, np.int32)], [np.empty(0, np.int64)], None
                elif kinds[a] == 0:
                    ids = part.column("__ids")
                    if ids.null_count:
                        whole = [x.as_py() if x.is_valid else merge_long(p.as_py(), ranks) for x, p in zip(ids, part.column("__data"), strict=True)]
                        ids = pa.array(whole, pa.list_(pa.int32()))
                    flat.append(ids.flatten().to_numpy())
                    sizes.append(np.diff(ids.offsets.to_numpy()).astype(np.int64))
                    starts = None
                else:
                    if starts is None:
                        flat, sizes = [np.concatenate(flat)], [np.concatenate(sizes)]
                        starts = np.cumsum(sizes[0]) - sizes[0]
                    yield from _documents(part, flat[0], starts, sizes[0])

    return run


def _documents(batch: pa.RecordBatch, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part in small_batches([batch], 1 << 20):
        data = part.column("__data")
        each = [np.frombuffer(x.as_py(), np.int32) for x in data]
        tokens = np.concatenate(each) if each else np.empty(0, np.int32)
        n = sizes[tokens]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[tokens] - (ends - n), n)].astype(np.int32)
        last = np.concatenate(([0], ends))[np.cumsum([0, *map(len, each)])].astype(np.int32)
        names = [x for x in part.schema.names if not x.startswith("__")]
        little = ids.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [*(part.column(x) for x in names), pa.ListArray.from_arrays(pa.array(last), pa.array(ids)), pa.array([little[4 * a : 4 * b] for a, b in zip(last, last[1:], strict=False)], pa.binary())],
            names=[*names, "ids", "ids_le"],
        )


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, native: bool = False, most_pieces: int = MOST_PIECES) -> DataFrame:
    """docs' columns `keep` (all: None) with ids (array<int>) and ids_le (the ids as little-endian 32 bits).

    Columns of docs named ids or ids_le are replaced; names that begin with two underscores are reserved.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "ids_le")]
    wide = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields if f.name != "__text"]
    ranks = load_ranks(path)
    out = ", ".join([*kept, "ids array<int>", "ids_le binary"])
    if not native:
        return wide.mapInArrow(_encode(pattern, ranks, most_pieces), out)
    pieces = wide.mapInArrow(_split(pattern, most_pieces), ", ".join([*kept, "__kind tinyint", "__data binary"]))
    ids = F.when((F.col("__kind") == 0) & (F.octet_length("__data") <= LONG_PIECE), fold_merges(F.hex("__data"), path))
    return pieces.withColumn("__ids", ids).mapInArrow(_assemble(ranks), out)


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids; null for null. An id outside the vocabulary gives null."""
    pieces = F.from_json(F.lit(_literals(path)[1]), "array<string>")
    found = F.transform(ids, lambda i: F.get(pieces, i))
    return F.when(~F.exists(found, lambda x: x.isNull()), F.unhex(F.array_join(found, "")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its number of ids, and digests of the ids and of the decoded bytes."""
    bounded_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
