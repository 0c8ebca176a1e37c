"""What several training-data operators share: the word rule, and Arrow batches of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.session import bounded_batches, staged  # noqa: F401

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[str]:
    """The words of a text; null has none."""
    return WORD.findall(text) if text else []


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes at most, so that what is built from a batch stays small."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, n * most_bytes // max(1, batch.nbytes))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def coded_words(texts: list[bytes], inside: np.ndarray, as_byte: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A dictionary of the words of some texts: (ids, distinct words, bounds).

    A word is a longest run of bytes b with inside[b], after as_byte[b] replaces each byte, where that is given. Words
    bounds[i]:bounds[i + 1] of ids are text i's. The distinct words are binary; equality is of their bytes.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    if as_byte is not None:
        data = as_byte[data]
    held = inside[data]
    edges = np.concatenate([[False], held, [False]])
    turns = np.flatnonzero(edges[1:] != edges[:-1])
    starts = turns[::2]
    offsets = np.concatenate([[0], np.cumsum(turns[1::2] - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[held])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.searchsorted(starts, at)


def numbered(df: DataFrame, *order: Column, name: str = "__rank") -> DataFrame:
    """A written table of df's rows with `name`, their place from 0 in the given order.

    Rows are ranged over partitions, sorted there and shifted by the numbers of rows before; only a number for each
    partition meets in one place.
    """
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sums = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
