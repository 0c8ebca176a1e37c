"""Substring dedup by recompression: repeated windows of words, found over consistent symbols.

Words get global names (hashes of their bytes). A round names runs of equal symbols, later rounds name pairs:
each round halves the alphabet by a hash bit, and a left symbol followed by a right one becomes one symbol. A
symbol depends on few words around it, its context, so equal windows hold equal symbols wherever the context
lies inside. Of the symbols inside a window the one of least rank is its anchor (a window without one is its
own); an anchor's name covers its context, and its patch is all the words its windows cover.

1. Documents are packed in batches; an exchange of packed names tells each batch which of its anchors others
have too. Windows of anchors met once are not repeated. 2. The other windows, each distinct one of a batch once,
go packed to buckets by hashes of all their words; a bucket finds the first place of each and answers with a
bit per window. 3. Each batch deletes the words of its windows that are not the first of their kind.

A name or a window reaches a bucket once a batch at most, so a passage in a third of all documents weighs little
more than any other, and no task gets all rows of a key. Words are named by XXH64; windows are equal if 128 bits
of two hashes over their names are.

Defined results: a null text counts as empty; documents with fewer words than a window keep all; order is by
key, null last, then by a hash of the text; rows equal in key and text are one place, none before the other;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.batches import BATCH, CODES_SQL, NO_KEY, answers_by_batch, bucket_bits, by_bucket, cells, distinct, each_bucket, name_codes, pack, packed_batches, pieces, read_codes, readers, texts_of, unpack
from cairnlake.llm.common import bounded_batches
from cairnlake.llm.hashing import MASK, Spans, mix, words
from cairnlake.session import table

WINDOW = 20
ROUNDS = 4
SEED = 9
#: Words whose windows are looked at at once.
PIECE = 200_000
NONE = 1 << 40  # a context that reaches beyond a document's ends


def symbols(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, from, to) of the symbols after the rounds, over words with names; from:to is the context in words.

    first: indices of the words that begin a document, and the number of words. Contexts that reach beyond
    their document are left out.
    """
    n = len(names)
    if not n:
        return names, np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    begins[n] = True
    # a run round: maximal runs of one word
    cut = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]) | begins[:-1])
    size = np.diff(np.concatenate([cut, [n]]))
    name = np.where(size > 1, mix(names[cut] + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), names[cut])
    lo = np.where(begins[cut], -NONE, cut - 1)
    hi = np.where(begins[cut + size], NONE, cut + size + 1)
    starts = begins[cut]
    for r in range(rounds):
        ends = np.concatenate([starts[1:], [True]])
        right = (mix(name + np.uint64((r + 1) * 0xE7037ED1A0B428DB & MASK)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~ends[:-1]
        second = np.concatenate([[False], pair[:-1]])
        next_hi = np.where(ends, NONE, np.concatenate([hi[1:], [NONE]]))
        last_lo = np.where(starts, -NONE, np.concatenate([[-NONE], lo[:-1]]))
        # what decides about a left symbol is the next one, about a right symbol the one before
        new_hi = np.where(~right, np.maximum(hi, next_hi), hi)
        new_lo = np.where(right & ~second, np.minimum(lo, last_lo), lo)
        after = np.concatenate([name[1:], name[:1]])
        name = np.where(pair, mix(name * np.uint64(0x8EBC6AF09C88C6E3) + mix(after + np.uint64(r + 1))), name)
        stay = ~second
        name, lo, hi = name[stay], new_lo[stay], new_hi[stay]
        starts = starts[stay]
    inside = (lo >= 0) & (hi < NONE)
    return name[inside], lo[inside], hi[inside]


def patches(names: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, i0, i1, name): windows i0..i1 (words from the document's start) share an anchor.

    Every window of every document is in exactly one patch. A symbol inside a window depends on the window's
    words alone, so a long document may be cut in overlapping pieces.
    """
    found = []
    for d, starts, ends in pieces(first[:-1], first[1:], PIECE, window - 1):
        lo = starts[0]
        doc, i0, i1, name = _patches(names[lo : ends[-1]], np.append(starts, ends[-1]) - lo, window)
        back = (starts - first[d : d + len(starts)])[doc]
        found.append((d + doc, i0 + back, i1 + back, name))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)


def _patches(names: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    last = first[1:] - window  # of each document, its last window
    count = np.maximum(last - first[:-1] + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    spans = Spans(names)
    name, lo, hi = symbols(names, first)
    short = hi - lo <= window
    name, lo, hi = name[short], lo[short], hi[short]
    # lo and hi rise from symbol to symbol, so those inside a window are neighbours
    low, high = np.searchsorted(lo, at), np.searchsorted(hi, at + window, side="right")
    rank = mix(name + np.uint64(0x589965CC75374CC3))
    best, chosen = np.full(len(at), np.uint64(2**64 - 1)), np.full(len(at), -1)
    for k in range(int((high - low).max(initial=0))):
        some = np.flatnonzero(low + k < high)
        j = low[some] + k
        better = (rank[j] < best[some]) | (chosen[some] < 0)
        best[some[better]], chosen[some[better]] = rank[j[better]], j[better]
    own = chosen < 0
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]) | own if len(at) else own
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(at)]]) - 1 if len(begin) else begin
    s, e, j = at[begin], at[end] + window, chosen[begin] if len(begin) else chosen
    alone = j < 0
    if len(lo):
        a, b = np.where(alone, s, lo[j]), np.where(alone, e, hi[j])
    else:
        a, b = s, e
    title = mix(spans(a, b) + alone.astype(np.uint64))
    base = first[:-1][doc[begin]]
    return doc[begin], s - base, at[end] - base, title


def _named(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of joined texts, where each text's words begin, and the words' names: their XXH64."""
    starts, ends, first = words(data, bounds)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    names = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    return starts, ends, first, names


def _anchor_names(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    _, _, first, names = _named(data, bounds)
    return patches(names, first)[3]


def _shared_windows(data: np.ndarray, bounds: np.ndarray, codes: list | None, bits: int) -> tuple[np.ndarray, ...]:
    """Of the windows whose anchors others have too: document, first word, two hashes; and the words' starts and ends and where texts begin."""
    starts, ends, first, names = _named(data, bounds)
    doc, i0, i1, name = patches(names, first)
    kinds, inverse = distinct(name, bits, inverse=True)
    some = np.flatnonzero(read_codes(codes, len(kinds))[inverse])
    n = i1[some] - i0[some] + 1
    i = np.arange(n.sum()) + np.repeat(i0[some] - (np.cumsum(n) - n), n)
    d = np.repeat(doc[some], n)
    s = first[:-1][d] + i
    return d, i, Spans(names)(s, s + WINDOW), Spans(mix(names), 0x2545F4914F6CDD1D)(s, s + WINDOW), starts, ends, first


def first_of_kind(keys: tuple, places: tuple) -> np.ndarray:
    """Which rows have the least place among those of equal keys; rows that tie for it all count."""
    order = np.lexsort((*reversed(places), *keys))
    new = np.ones(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    least = order[np.flatnonzero(new)][group]
    same = np.ones(len(order), dtype=bool)
    for p in places:
        same &= p[order] == p[least]
    out = np.empty(len(order), dtype=bool)
    out[order] = same
    return out


def _sent_order(d, i, w1, w2, ids, hashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows a batch sends (the first of each kind), in the order of their buckets, and which are such."""
    first = first_of_kind((w1, w2), (ids[d], hashes[d], i))
    send = np.flatnonzero(first)
    return send[np.lexsort((i[send], d[send], w1[send] >> np.uint64(64 - bits)))], first


def _window_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, codes, *packed in cells(rows, "batch", "codes", "docs", "hashes", "sizes", "blob"):
                ids, hashes, data, bounds = texts_of(*packed)
                d, i, w1, w2, *_ = _shared_windows(data, bounds, codes, bits)
                send, _ = _sent_order(d, i, w1, w2, ids, hashes, bits)
                buckets, parts = by_bucket(w1[send], bits)
                d, i, w1, w2 = d[send], i[send], w1[send], w2[send]
                columns = [[pack(x[p]) for p in parts] for x in (ids[d], hashes[d], i.astype(np.int32), w1, w2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.full(len(buckets), batch)), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "batch", "docs", "hashes", "i", "w1", "w2"]
                )

    return run


def _compared(rows: pa.Table) -> pa.Table:
    """Of one bucket: for each window of each batch whether it starts earlier elsewhere."""
    columns = [[unpack(x, t) for x in rows.column(c).to_pylist()] for c, t in (("docs", np.int64), ("hashes", np.int64), ("i", np.int32), ("w1", np.uint64), ("w2", np.uint64))]
    docs, hashes, i, w1, w2 = (np.concatenate(c) for c in columns)
    late = (~first_of_kind((w1, w2), (docs, hashes, i))).astype(np.uint8)
    ends = np.cumsum([len(x) for x in columns[0]]).tolist()
    return pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "codes": pa.array([pack(late[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})


def _kept(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for codes, late, *packed in cells(rows, "codes", "late", "docs", "hashes", "sizes", "blob"):
                ids, hashes, data, bounds = texts_of(*packed)
                d, i, w1, w2, starts, ends, first = _shared_windows(data, bounds, codes, bits)
                send, first_here = _sent_order(d, i, w1, w2, ids, hashes, bits)
                repeat = ~first_here
                repeat[send] = read_codes(late, len(send)) > 0
                at = first[:-1][d[repeat]] + i[repeat]
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                stay = np.cumsum(change)[:-1] == 0
                raw, s, e = data.tobytes(), starts.tolist(), ends.tolist()
                n = np.diff(first)
                left = np.concatenate([[0], np.cumsum(stay)])
                kept_words = np.flatnonzero(stay).tolist()
                cut = left[first].tolist()
                texts = [b" ".join([raw[s[w] : e[w]] for w in kept_words[a:b]]).decode() for a, b in zip(cut, cut[1:], strict=False)]
                keys = pa.array(ids, mask=ids == NO_KEY)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(n - np.diff(left[first])), pa.array(texts, pa.string())], names=["key", "n_words", "n_removed", "kept"])

    return run


def dedup_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH) -> DataFrame:
    """(key, n_words, n_removed, kept): each document without the words of windows that start earlier elsewhere."""
    packed = packed_batches(docs, key, text, batch_bytes)
    batches = packed.count()
    bits, tasks = bucket_bits(batches, batch_bytes), readers(batches, batch_bytes)
    coded = packed.repartition(tasks, "batch").join(name_codes(packed, _anchor_names, bits, 2**31, tasks).hint("merge"), "batch", "left")
    sent = coded.mapInArrow(_window_rows(bits), "bucket bigint, batch bigint, docs binary, hashes binary, i binary, w1 binary, w2 binary")
    late = answers_by_batch(each_bucket(sent, 1 << bits, _compared, CODES_SQL), "late", tasks)
    out = coded.join(late.hint("merge"), "batch", "left")
    return out.mapInArrow(_kept(bits), "key bigint, n_words bigint, n_removed bigint, kept string")


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its words, those removed, and a digest of the words that stay."""
    bounded_batches(spark)
    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
