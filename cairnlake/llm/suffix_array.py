"""Suffix-array dedup of substrings: difference-cover sorting of the texts' shared parts, in even buckets.

A string of `WINDOW` bytes is a repeat if it also starts in a document with a smaller key. Suffixes are sorted
only where repeats can be:

1. Documents are packed in batches. In every window the k-gram of least rank (the leftmost of equals) is its
   anchor; neighbouring windows with one anchor form a patch, the bytes they cover, 84 at most. Equal windows
   have equal anchors. An exchange of packed names tells each batch which of its anchors are met once in the
   corpus, which are shared, and which are hot; patches of hot ones are split by a second anchor.
2. Shared patches go to the bucket of their name. What is equal inside a batch is settled there, and an equal
   string of one document goes once, so a passage in a third of all documents is a string a batch.
3. A bucket's distinct strings are joined and sorted by the difference cover modulo 3: triples at positions not
   divisible by 3 are sorted and named, names are sorted by recursion, the remaining suffixes by their first
   byte and a sampled rank, and both are merged. Neighbouring suffixes that agree on a window's length form a
   class; its windows in documents beyond its smallest one are repeats. A key with more bytes than are sorted
   at once is sorted in passes over its windows.

Names and hashes only decide what is looked at; all equality is of bytes. Texts travel packed.

Defined results: a null text counts as empty; texts shorter than a window stay whole; null keys come last, and
rows with equal keys are never repeats of each other; bytes are cut regardless of characters, so what is kept
is binary; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.batches import BATCH, NO_KEY, bucket_bits, cells, distinct, each_bucket, name_codes, pack, packed_batches, pieces, read_codes, readers, texts_of, unpack
from cairnlake.llm.common import bounded_batches
from cairnlake.llm.hashing import Spans, byte_values, mix
from cairnlake.session import table

WINDOW = 50
GRAM = 16
#: Patches of a name beyond which they are split by second anchors.
HOT = 4096
#: Bytes of text whose windows are looked at at once; arrays of eight bytes each stay in a core's cache.
PIECE = 1 << 18
#: Bytes that are sorted at once; ranks take 21 bits.
MOST_SORTED = 1 << 18


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers from 1) in order, by the difference cover modulo 3; len(s) < 2^21 - 3."""
    n = len(s)
    if n >= (1 << 21) - 3:
        raise ValueError(f"{n} symbols are sorted at once; ranks take 21 bits")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    # sampled positions; if n is 1 modulo 3 the empty suffix at n separates the two halves
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    wide = int(s.max()) + 1
    # names are of triples, and of longer stretches where more symbols fit in a key: their order is that of the suffixes too
    most = max([3, *(k for k in range(4, 9) if wide**k < 1 << 63)])
    t = np.zeros(n + most + 1, dtype=np.int64)
    t[:n] = s
    if wide <= 1 << 21:
        keys = t[sample]
        for k in range(1, most):
            keys = keys * wide + t[sample + k]
        order = np.argsort(keys)
        new = np.concatenate([[True], np.diff(keys[order]) != 0])
        names = np.empty(len(sample), dtype=np.int64)
        names[order] = np.cumsum(new)
        alike = not new.all()
    else:
        kinds, names = np.unique(np.stack([t[sample], t[sample + 1], t[sample + 2]], axis=1), axis=0, return_inverse=True)
        names = names.ravel() + 1
        order, alike = np.argsort(names, kind="stable"), len(kinds) < len(sample)
    if alike:
        order = suffix_array(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    base = len(order) + 2
    zero = np.arange(0, n, 3)
    key = t[zero] * base + rank[zero + 1]
    by = np.argsort(key)  # no two are equal
    zero, key = zero[by], key[by]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[ones] * base + rank[ones + 1], key)
    before += np.searchsorted((t[twos] * wide + t[twos + 1]) * base + rank[twos + 2], (t[zero] * wide + t[zero + 1]) * base + rank[zero + 2])
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[rest] = sampled
    return out


def repeated_starts(strings: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of the windows of strings, in suffix order; equal windows share a class."""
    sizes = np.array([len(x) + 1 for x in strings], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(x + b"\xff" for x in strings), dtype=np.uint8)  # no UTF-8 text holds this byte
    sa = suffix_array(data.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(strings)), sizes)
    sa = sa[(np.arange(len(data)) < np.repeat(begin + sizes - window, sizes))[sa]]
    # neighbours' windows are compared eight bytes at a time
    eight = np.ndarray(len(data), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    same = np.ones(max(len(sa) - 1, 0), dtype=bool)
    for k in [*range(0, window - 8, 8), window - 8]:
        word = eight[sa + k]
        same &= word[1:] == word[:-1]
    return owner[sa], sa - begin[owner[sa]], np.concatenate([[0], np.cumsum(~same)]) if len(sa) else np.empty(0, np.int64)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every gram of data its hash, and its rank with its position in the low 32 bits: the least of a window is its leftmost least gram."""
    at = np.arange(len(data) - GRAM + 1)
    hashes = Spans(byte_values(data))(at, at + GRAM)
    return hashes, ((mix(hashes) >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)


def _patches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(text, start, end, name, anchor, hash) of the patches of texts starts..ends in data; the hash is of the bytes and the anchor's place, or not made."""
    count = np.maximum(ends - WINDOW - starts + 1, 0)
    if not count.sum():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64))
    hashes, least = _grams(data)
    width, have = WINDOW - GRAM + 1, 1
    while have < width:  # minima over doubling, then overlapping, stretches
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    final = np.concatenate([begin[1:], [len(start)]]) - 1
    text, a, b, anchor = text[begin], start[begin], start[final] + WINDOW, anchor[begin]
    return text, a, b, hashes[anchor], anchor, _whole(data, a, b, anchor - a) if whole else hashes[:0]


def _whole(data: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(Spans(byte_values(data), 0x2545F4914F6CDD1D)(a, b) + place.astype(np.uint64))


def patches(data: np.ndarray, bounds: np.ndarray, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(document, start, end, name, anchor, hash): the patches of joined texts; start, end and anchor are bytes of data. Without whole there are no hashes.

    Windows start at start..end - WINDOW; every window of every text is in exactly one patch.
    """
    found = []
    for doc, starts, ends in pieces(bounds[:-1], bounds[1:] - 1, PIECE, WINDOW - 1):
        lo = starts[0]
        text, a, b, name, anchor, hashed = _patches(data[lo : ends[-1]], starts - lo, ends - lo, whole)
        found.append((doc + text, a + lo, b + lo, name, anchor + lo, hashed))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else _patches(data, bounds[:0], bounds[:0])


def _names(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return patches(data, bounds, whole=False)[3]


def split_patches(data: np.ndarray, a: np.ndarray, b: np.ndarray, name: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(patch, start, end, name, hash): patches a..b cut by the second anchors of their windows.

    A window's second anchor is its least gram but for the anchor itself; the new name covers both and their
    distance, so a frequent gram does not fill a bucket, and what is sent stays a few strings a patch.
    """
    found = []
    for i in range(0, len(a), 2048):
        x, y, first = a[i : i + 2048], b[i : i + 2048], anchor[i : i + 2048]
        wide = int((y - x).max())
        text = data[np.minimum(x[:, None] + np.arange(wide), len(data) - 1)].ravel()
        hashes, rank = _grams(text)
        n = y - x - WINDOW + 1
        p = np.repeat(np.arange(len(x)), n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best = np.full(len(w), np.uint64(2**64 - 1))
        for k in range(WINDOW - GRAM + 1):
            r = rank[p * wide + w + k]
            np.minimum(best, np.where(x[p] + w + k == first[p], np.uint64(2**64 - 1), r), out=best)
        second = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (second[1:] != second[:-1]) | (p[1:] != p[:-1])]))
        last = np.concatenate([begin[1:], [len(w)]]) - 1
        q, second = p[begin], second[begin]
        apart = (second - q * wide + x[q] - first[q] + 64).astype(np.uint64)
        title = mix(name[i + q] + hashes[second] * np.uint64(0x8EBC6AF09C88C6E3) + apart)
        s, e = w[begin], w[last] + WINDOW
        found.append((i + q, x[q] + s, x[q] + e, title, _whole(text, q * wide + s, q * wide + e, first[q] - x[q] - s + 64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2


def _routed(buckets: int, bits: int):
    """Each batch's shared patches to sorting buckets, and those settled inside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, codes, *packed in cells(rows, "batch", "codes", "docs", "hashes", "sizes", "blob"):
                ids, _, data, bounds = texts_of(*packed)
                doc, start, end, name, anchor, whole = patches(data, bounds)
                kinds, inverse = distinct(name, bits, inverse=True)
                name, code = kinds[inverse], read_codes(codes, len(kinds))[inverse]
                warm, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
                of, a, b, title, second = split_patches(data, start[hot], end[hot], name[hot], anchor[hot])
                yield from _parcels(
                    batch, ids, bounds, data, np.concatenate([mix(name[warm]), title]), np.concatenate([whole[warm], second]),
                    np.concatenate([doc[warm], doc[hot][of]]), np.concatenate([start[warm], a]), np.concatenate([end[warm], b]), buckets,
                )

    return run


def _parcels(batch: int, ids, bounds, data, key, whole, d, a, b, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((a, ids[d], whole))
    key, whole, d, a, b = key[order], whole[order], d[order], a[order], b[order]
    new = np.concatenate([[True], whole[1:] != whole[:-1]]) if len(whole) else np.empty(0, bool)
    raw = data.tobytes()
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(whole) else np.empty(0, np.int64)
    same = np.flatnonzero(~new)
    unlike = [i for i, p, q, r, s in zip(same.tolist(), a[same].tolist(), b[same].tolist(), a[head[same]].tolist(), b[head[same]].tolist(), strict=True) if raw[p:q] != raw[r:s]]
    if unlike:  # equal hashes of unequal bytes: their group is left to the bucket, which compares bytes
        apart = np.isin(head, head[unlike])
        head[apart] = np.flatnonzero(apart)
    late = ids[d] > ids[d][head]
    base = bounds[:-1][d]
    yield _parcel(batch % buckets, batch, *_runs(d[late], a[late] - base[late], b[late] - base[late]))
    # a parcel for each bucket, in the order of the text; equal strings of a document are sent once, with all their places
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    stay = np.flatnonzero(~late)
    stay = stay[np.lexsort((a[stay], d[stay], bucket[stay]))]
    bucket = bucket[stay]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(stay) else np.empty(0, np.int64)
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(stay)], strict=False):
        s = stay[x:y]
        _, first, ref = np.unique(head[s], return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        sent = s[np.sort(first)]
        strings = [raw[i:j] for i, j in zip(a[sent].tolist(), b[sent].tolist(), strict=True)]
        yield _parcel(int(bucket[x]), batch, d[s], a[s] - base[s], b[s] - base[s], ids[d[s]], mix(key[sent]) >> np.uint64(48), strings, rank[ref])


def _runs(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching stretches a..b of each row."""
    by = np.lexsort((a, row))
    row, a, b = row[by].astype(np.int64), a[by].astype(np.int64), b[by].astype(np.int64)
    if not len(row):
        return row, a, b
    reach = np.maximum.accumulate((row << 32) + b)
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] << 32) + a[1:] > reach[:-1]]))
    return row[cut], a[cut], np.maximum.reduceat(b, cut)


def _parcel(bucket: int, batch: int, row, a, b, doc=None, kind=None, strings: list[bytes] | None = None, ref=None) -> pa.RecordBatch:
    """Stretches a..b of rows of a batch; those to be sorted also carry their document and which of the strings they are.

    A string comes with 16 bits of its key, its size and its bytes.
    """
    columns = [pack(np.diff(np.asarray(row, np.int32), prepend=np.int32(0))), pack(np.asarray(a, np.int32)), pack(np.asarray(b - a, np.int32))]
    if doc is None:
        columns += [None] * 5
    else:
        columns += [
            pack(np.diff(doc, prepend=np.int64(0))), pack(np.diff(ref.astype(np.int32), prepend=np.int32(0))), pack(kind.astype(np.uint16)),
            pack(np.array([len(x) for x in strings], np.uint16)), zstandard.ZstdCompressor(level=3).compress(b"".join(strings)),
        ]
    names = ["row", "a", "n", "doc", "ref", "kind", "size", "blob"]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([batch], pa.int64()), *(pa.array([x], pa.binary()) for x in columns)], names=["bucket", "batch", *names])


PARCEL_SQL = "bucket int, batch bigint, row binary, a binary, n binary, doc binary, ref binary, kind binary, size binary, blob binary"
SPAN_SQL = "batch bigint, row binary, s binary, e binary"


def _sorted_bucket(most: int):
    """Of one bucket: the runs of repeats, by batch."""

    def run(rows: pa.Table) -> pa.Table:
        batch, row, a, doc, ref, kind = [], [], [], [], [], []
        strings: list[bytes] = []
        found = [(np.empty(0, np.int64),) * 4]
        for number, r, x, y, d, f, k, sizes, blob in cells(rows, "batch", "row", "a", "n", "doc", "ref", "kind", "size", "blob"):
            r, x, y = np.cumsum(unpack(r, np.int32), dtype=np.int64), unpack(x, np.int32).astype(np.int64), unpack(y, np.int32)
            if d is None:
                found.append((np.full(len(r), number), r, x, x + y))
                continue
            for to, value in ((batch, np.full(len(r), number)), (row, r), (a, x), (doc, np.cumsum(unpack(d, np.int64), dtype=np.int64)), (ref, len(strings) + np.cumsum(unpack(f, np.int32), dtype=np.int64)), (kind, unpack(k, np.uint16))):
                to.append(value)
            raw = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
            ends = np.cumsum(unpack(sizes, np.uint16), dtype=np.int64).tolist()
            strings += [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        if batch:
            batch, row, a, doc, ref, kind = (np.concatenate(c) for c in (batch, row, a, doc, ref, kind))
            for place, s, e in _bucket_repeats(strings, kind, doc, ref, most):
                found.append((batch[place], row[place], a[place] + s, a[place] + e))
        batch, row, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((s, row, batch))
        cut = np.flatnonzero(np.concatenate([[True], np.diff(batch[by]) != 0])) if len(by) else np.empty(0, np.int64)
        parts = [by[x:y] for x, y in zip(cut, [*cut[1:], len(by)], strict=False)]
        packed = [pa.array([pack(c[p].astype(np.int32)) for p in parts], pa.binary()) for c in (row, s, e)]
        return pa.table([pa.array(batch[by[cut]], pa.int64()), *packed], names=["batch", "row", "s", "e"])

    return run


def _bucket_repeats(strings: list[bytes], kind: np.ndarray, doc: np.ndarray, ref: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, start, end) of the runs of repeats in a bucket, sorted by about `most` bytes at once.

    kind: of each string; doc and ref: of each place its document and its string.
    """
    ids: dict[bytes, int] = {}  # equal strings have equal keys, and are sorted once
    to = np.array([ids.setdefault(x, len(ids)) for x in strings], dtype=np.int64)
    strings, kinds = list(ids), np.empty(len(ids), np.int64)
    kinds[to] = kind
    ref = to[ref]
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, ref, doc)
    places = np.argsort(ref, kind="stable")
    first = np.searchsorted(ref[places], np.arange(len(strings) + 1))
    by = np.argsort(kinds, kind="stable")
    sizes = np.array([len(x) + 1 for x in strings], dtype=np.int64)[by]
    ends, edges = np.cumsum(sizes), np.flatnonzero(np.concatenate([np.diff(kinds[by]) != 0, [True]])) + 1
    i = 0
    while i < len(by):
        # as many whole keys as are sorted at once, or one that is larger alone
        begun = ends[i] - sizes[i]
        fits = edges[(edges > i) & (ends[edges - 1] - begun <= most)]
        j = int(fits[-1]) if len(fits) else int(edges[np.searchsorted(edges, i, side="right")])
        group = by[i:j]
        i = j
        string, offset, smallest = _windows([strings[x] for x in group.tolist()], least[group], most)
        at = group[string]  # each string's windows at all of its places
        many = first[at + 1] - first[at]
        place = places[np.arange(many.sum()) + np.repeat(first[at] - (np.cumsum(many) - many), many)]
        w, small = np.repeat(offset, many), np.repeat(smallest, many)
        gone = small < doc[place]
        place, w = place[gone], w[gone]
        if not len(place):
            continue
        order = np.lexsort((w, place))
        place, w = place[order], w[order]
        start = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(w) > 1)]))
        last = np.concatenate([start[1:], [len(place)]]) - 1
        yield place[start], w[start], w[last] + WINDOW


def _windows(strings: list[bytes], least: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, smallest document with an equal window) of all windows of strings of documents `least`, by string and offset.

    More bytes than are sorted at once go in passes over the windows, by a hash of their bytes.
    """
    held = sum(map(len, strings)) + len(strings)
    if held <= most:
        return _smallest(*repeated_starts(strings), least)
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum([0, *map(len, strings)])
    n = np.diff(begin) - WINDOW + 1
    owner = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + offset
    hashed = Spans(byte_values(data), 0x2545F4914F6CDD1D)(at, at + WINDOW)
    passes = np.uint64(-(-len(at) * (WINDOW + 1) // (most // 2)))
    raw, out = data.tobytes(), np.empty(len(at), np.int64)
    for p in range(int(passes)):
        some = np.flatnonzero(hashed % passes == np.uint64(p))
        ids: dict[bytes, int] = {}
        of = np.array([ids.setdefault(raw[x : x + WINDOW], len(ids)) for x in at[some].tolist()], dtype=np.int64)
        lowest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(lowest, of, least[owner[some]])
        one, _, smallest = _smallest(*repeated_starts(list(ids)), lowest)
        found = np.empty(len(ids), np.int64)
        found[one] = smallest
        out[some] = found[of]
    return owner, offset, out


def _smallest(string: np.ndarray, offset: np.ndarray, group: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(string):
        return string, offset, string
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    smallest = np.minimum.reduceat(least[string], begin)[group]
    by = np.lexsort((offset, string))
    return string[by], offset[by], smallest[by]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for spans, *packed in cells(rows, "spans", "docs", "hashes", "sizes", "blob"):
            ids, _, data, bounds = texts_of(*packed)
            raw = data.tobytes()
            texts = [raw[a : b - 1] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            row, start, end = (np.concatenate([np.empty(0, np.int32), *(unpack(x[c], np.int32) for x in spans or ())]) for c in ("row", "s", "e"))
            row, start, end = _runs(row, start, end)
            first = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
            start, end = start.tolist(), end.tolist()
            out = []
            for i, text in enumerate(texts):
                x, y = first[i], first[i + 1]
                kept = b"".join([text[p:q] for p, q in zip([0, *end[x:y]], [*start[x:y], len(text)], strict=True)])
                out.append((len(text), len(text) - len(kept), y - x, kept))
            n, removed, runs, kept = zip(*out, strict=True)
            keys = pa.array(ids, mask=ids == NO_KEY)
            for x in range(0, len(out), 500):
                y = x + 500
                yield pa.RecordBatch.from_arrays(
                    [keys[x:y], pa.array(n[x:y], pa.int64()), pa.array(removed[x:y], pa.int64()), pa.array(runs[x:y], pa.int64()), pa.array(kept[x:y], pa.binary())],
                    names=["key", "n_bytes", "n_removed", "n_spans", "kept"],
                )


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH, hot: int = HOT, most_sorted: int = MOST_SORTED) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): each document without the bytes of repeats."""
    packed = packed_batches(docs, key, text, batch_bytes)
    batches = packed.count()
    bits, tasks = bucket_bits(batches, batch_bytes), readers(batches, batch_bytes)
    spread = packed.repartition(tasks, "batch")
    coded = spread.join(name_codes(packed, _names, bits, hot, tasks).hint("merge"), "batch", "left")
    found = each_bucket(coded.mapInArrow(_routed(tasks, bits), PARCEL_SQL), tasks, _sorted_bucket(most_sorted), SPAN_SQL)
    spans = found.repartition(tasks, "batch").groupBy("batch").agg(F.collect_list(F.struct("row", "s", "e")).alias("spans"))
    return spread.join(spans.hint("merge"), "batch", "left").mapInArrow(_kept, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its bytes, those removed, the runs they form, and a digest of the bytes that stay."""
    bounded_batches(spark)
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
