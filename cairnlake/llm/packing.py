"""Hierarchical packing of token ids into windows of several lengths.

Every document is its ids and an end id. What fills whole windows of the longest tier is cut off first; the rest is
routed to the shortest tier (512, 1024, 2048 or 4096 ids) that holds it. A window of the longest rest's tier is opened
and its gap filled by the largest rests that fit, which come from shorter tiers; where none fits, the smallest that
remains is cut to the gap and what is left of it is routed again. So every window is full, at a power of two, and needs
no padding. When a group's rests run out, its last window is cut at powers of two. Groups are the documents that follow
one another in a task up to GROUP ids or GROUP_DOCS documents, so packing moves no text and no ids; it needs ids only where they are made.

Sequences of a tier are then dealt to steps of STEP_IDS ids, to and fro in the order of their attention cost (the sum
of squared piece lengths), so steps of a tier are alike in ids and in cost.

Ids are those of the tokenizers library for the whole text. Text is cut at ASCII white space, across which no piece of
that vocabulary reaches, and each distinct word of a task is encoded once.

Defined results: a null or empty text is the end id alone; repeated rows and repeated or null keys are separate
documents; an empty table gives no rows; names that begin with two underscores are reserved, and other columns are
passed through; columns named as the results are replaced. A task holds GROUP ids or one document's, whichever is more,
and at most MOST_WORDS encoded words.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, coded_words, numbered, small_batches
from cairnlake.session import staged, table

TIERS = (512, 1024, 2048, 4096)
#: Ids and documents of a packing group, ids of a step, and encoded words that a task keeps.
GROUP, GROUP_DOCS, STEP_IDS, MOST_WORDS = 1 << 21, 1 << 14, 1 << 18, 1 << 20
END = 2

#: Anything but ASCII white space.
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
#: Words of ASCII and of Latin letters whose lower case is one letter and which have no other form; the vocabulary's own rule cuts them.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
_CUT = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class _Lists:
    """Lists of ids end to end."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The lists at these places, end to end."""
        n = self.sizes[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - n), n)]


class Encoder:
    """The ids of words, each distinct one encoded once until MOST_WORDS are kept."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.parts: dict[str, int] = {"\n": -1}
        self.of_words, self.of_parts = _Lists(), _Lists()

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and their numbers."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def _add_parts(self, parts: list[str]) -> None:
        """Parts that the vocabulary's rule does not cut: the last id of each carries the mark of a word's end."""
        found = []
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            flat, _ = self._each([" ".join(some)])
            sizes = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
            found.append((flat, sizes) if len(sizes) == len(some) else self._each(some))  # else a part is cut after all
        if found:
            self.of_parts.add(*map(np.concatenate, zip(*found, strict=True)))
            self.parts.update(zip(parts, range(len(self.parts) - 1, len(self.parts) - 1 + len(parts)), strict=True))

    def _add_words(self, words: list[bytes]) -> None:
        texts = b"\n".join(words).decode().split("\n")
        plain = [bool(_PLAIN.fullmatch(x)) and "<|" not in x for x in texts]
        found = _CUT.findall("".join(f"{x}\n" for x, yes in zip(texts, plain, strict=True) if yes).lower())
        self._add_parts([p for p in dict.fromkeys(found) if p not in self.parts])
        at = np.fromiter(map(self.parts.__getitem__, found), np.int64, len(found))
        last = np.flatnonzero(at < 0)
        n = np.add.reduceat(np.where(at < 0, 0, self.of_parts.sizes[at]), np.concatenate([[0], last[:-1] + 1])) if len(last) else np.empty(0, np.int64)
        self.of_words.add(self.of_parts[at[at >= 0]], n)
        order = [w for w, yes in zip(words, plain, strict=True) if yes]
        others = [x for x, yes in zip(texts, plain, strict=True) if not yes]
        for i in range(0, len(others), 1000):
            self.of_words.add(*self._each(others[i : i + 1000]))
        order += [w for w, yes in zip(words, plain, strict=True) if not yes]
        self.words.update(zip(order, range(len(self.words), len(self.words) + len(order)), strict=True))

    def texts(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """The ids of each text, and the end id after them."""
        codes, distinct, bounds = coded_words(texts, _INSIDE)
        if len(self.words) + len(distinct) > MOST_WORDS or len(self.parts) > MOST_WORDS:
            self._clear()
        words = distinct.to_pylist()
        if new := [w for w in words if w not in self.words]:
            self._add_words(new)
        place = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ids, n = self.of_words[place[codes]], self.of_words.sizes[place[codes]]
        # the end id stands after the ids of each text's words
        cut = np.concatenate([[0], np.cumsum(n)])[bounds]
        out, cut = np.insert(ids, cut[1:], end), (cut + np.arange(len(cut))).tolist()
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of each sequence that a group's documents make, in their order there.

    Every sequence is as long as a tier, but for what a last window holds, which is cut at powers of two.
    """
    longest = tiers[-1]
    rests: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
    for i, n in enumerate(lengths):
        whole = n - n % longest
        for at in range(0, whole, longest):
            yield [(i, at, longest)]
        if n > whole:
            rests.append((n - whole, i, whole))
    rests.sort()
    while rests:
        n, i, at = rests.pop()
        size = next(t for t in tiers if t >= n)
        held, gap = [(i, at, n)], size - n
        while gap and rests:
            k = bisect_right(rests, (gap, 1 << 62, 0)) - 1
            if k >= 0:  # the longest rest that fits
                n, i, at = rests.pop(k)
                held.append((i, at, n))
                gap -= n
            else:  # all are longer than the gap: the shortest is cut
                n, i, at = rests.pop(0)
                held.append((i, at, gap))
                insort(rests, (n - gap, i, at + gap))
                gap = 0
        if not gap:
            yield held
        else:
            yield from _powers(held, size - gap)


def _powers(held: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a window that is not full, as sequences of the powers of two that make up its length."""
    k = 0
    for bit in range(total.bit_length() - 1, -1, -1):
        left, out = total & (1 << bit), []
        while left:
            i, at, n = held[k]
            took = min(n, left)
            out.append((i, at, took))
            left -= took
            if took == n:
                k += 1
            else:
                held[k] = (i, at + took, n - took)
        if out:
            yield out


def _packed(path: str, end: int, tiers: tuple[int, ...], group: int, with_ids: bool):
    """Documents to pieces: each task's documents in turn, by groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        total = docs = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids = [x for _, each in held for x in each]
            names = held[0][0].schema.names
            rows = pa.Table.from_batches([b for b, _ in held])
            found = []
            for pieces in windows([len(x) for x in ids], tiers):
                offset = 0
                for i, at, n in pieces:
                    found.append((i, at, n, crc32(ids[i][at : at + n].astype("<u4").tobytes()), len(ids[i]), (part << 33) + number, offset))
                    offset += n
                number += 1
            for a in range(0, len(found), 2000):
                columns = [np.array(c, np.int64) for c in zip(*found[a : a + 2000], strict=True)]
                kept = rows.take(pa.array(columns[0])).combine_chunks()
                more = [pa.array([ids[i][at : at + n] for i, at, n, *_ in found[a : a + 2000]], pa.list_(pa.int32()))] if with_ids else []
                yield from pa.table([*kept.columns, *map(pa.array, columns[1:]), *more], names=[*names, *_COLUMNS, *["ids"] * with_ids]).to_batches()

        for batch in small_batches(batches):
            texts = [x or b"" for x in batch.column("__text").cast(pa.binary()).to_pylist()]
            ids = encoder.texts(texts, end)
            held.append((batch.select([x for x in batch.schema.names if x != "__text"]), ids))
            total += sum(map(len, ids))
            docs += len(ids)
            if total >= group or docs >= GROUP_DOCS:
                yield from out()
                held, total, docs = [], 0, 0
        if held:
            yield from out()

    return run


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, end: int = END, tiers: tuple[int, ...] = TIERS, group: int = GROUP, ids: bool = False) -> DataFrame:
    """A written table of pieces: `keep` (all columns but the text: None), start, length, ids_crc32, doc_tokens, sequence_id and offset.

    With `ids` also the ids of each piece (array<int>): the content of a sequence is its pieces' ids in the order of offset.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in (*_COLUMNS, "tier", "step", "ids") and (keep is not None or c != text)]
    wide = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[:-1]] + [f"{c} bigint" for c in _COLUMNS] + ["ids array<int>"] * ids
    return staged(wide.mapInArrow(_packed(path, end, tiers, group, ids), ", ".join(schema)))


def balanced(pieces: DataFrame, step_ids: int = STEP_IDS) -> DataFrame:
    """pieces with tier, the length of their sequence, and step, a number within the tier.

    A tier's sequences are dealt to its steps by cost, to and fro. Ranks are made by range partitions; a sequence
    is a small row, and a tier is a group of one row for each partition only.
    """
    length, cost = F.sum("length").alias("tier"), F.sum(F.col("length") * F.col("length")).alias("__cost")
    sequences = pieces.groupBy("sequence_id").agg(length, cost)
    ranked = numbered(sequences, F.col("tier"), F.col("__cost").desc(), F.col("sequence_id"))
    sizes = ranked.groupBy("tier").agg(F.count(F.lit(1)).alias("__n"), F.min("__rank").alias("__first"))  # a row for each length, 13 at most
    at, steps = F.col("__rank") - F.col("__first"), F.ceil(F.col("__n") * F.col("tier") / F.lit(step_ids))
    turn, place = F.floor(at / steps), at % steps
    dealt = ranked.join(F.broadcast(sizes), "tier").select("sequence_id", "tier", F.when(turn % 2 == 0, place).otherwise(steps - 1 - place).alias("step"))
    names = [F.col(f"`{c}`") for c in pieces.columns]
    return pieces.join(dealt, "sequence_id").select(*names, "tier", "step")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document of `documents`: where it lies in it, its ids' digest, and its sequence, tier and step."""
    bounded_batches(spark)
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return balanced(pieces)
