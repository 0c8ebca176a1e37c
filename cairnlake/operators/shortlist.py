"""Exact search with a floor over one-byte codes: what the codes' error rules out is never read in full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.vectors import dot, unit
from cairnlake.session import drop_staged, staged

#: The least score of a passage, and passages at most.
FLOOR, MOST = 0.6, 20
CODES_SQL = "id bigint, code binary, scale float, residual float"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, scales, residuals = [], [], []
        for v in batch.column("v"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            scale = float(np.float32(np.abs(x).max(initial=0.0) / 127.0))
            code = np.clip(np.round(x / scale), -127, 127).astype(np.int8) if scale > 0 else np.zeros(len(x), np.int8)
            codes.append(code.tobytes())
            scales.append(scale)
            residuals.append(float(np.linalg.norm(x - scale * code)))
        up = np.nextafter(np.array(residuals, np.float32), np.float32(np.inf))  # rounded up, for it is a bound
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary()), pa.array(np.array(scales, np.float32)), pa.array(up)], names=["id", "code", "scale", "residual"])


def codes(vectors: DataFrame) -> DataFrame:
    """(id, code, scale, residual) of unit vectors (id, v): a byte for each number, and the length of what the bytes leave out."""
    return vectors.where("v IS NOT NULL AND size(v) > 0").select("id", unit(F.col("v")).alias("v")).mapInArrow(_coded, CODES_SQL)


def _bounded(q: np.ndarray, floor: float, most: int):
    """Rows that may be among the best: bounds of their scores, where the upper one reaches the floor and the last place of a task so far."""
    length, total = float(np.linalg.norm(q)), float(np.abs(q).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(most, -np.inf)
        for batch in batches:
            flat = batch.column("code").to_pylist()
            same = np.flatnonzero([len(x) == len(q) for x in flat])
            if not len(same):
                continue
            x = np.frombuffer(b"".join(flat[i] for i in same), np.int8).reshape(-1, len(q)).astype(np.float32)
            scale, residual = (batch.column(c).to_numpy()[same].astype(np.float64) for c in ("scale", "residual"))
            score = scale * (x @ q.astype(np.float32)).astype(np.float64)
            # a code is within half a step of its number; sums of 32-bit products are off by little
            error = np.minimum(0.5 * scale * total, residual * length) * 1.001 + 1e-4 * (1.0 + length)
            best = np.sort(np.concatenate([best, score - error]))[-most:]
            keep = score + error >= max(best[0], floor)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(same[keep])), pa.array((score - error)[keep]), pa.array((score + error)[keep])], names=["id", "lower", "upper"])

    return run


def best_above(coded: DataFrame, vectors: DataFrame, query: list[float], floor: float = FLOOR, most: int = MOST, counts: dict | None = None) -> DataFrame:
    """(id, score) of the `most` vectors nearest to a query, of `floor` at least, by score and id; exact.

    One pass reads the codes, a quarter of the vectors' bytes. A row is dropped where its upper bound misses the floor or
    the `most`-th best lower bound; the rest is read in full and scored. counts: gets the rows that were read in full.
    """
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    rows = staged(coded.mapInArrow(_bounded(q, floor, most), "id bigint, lower double, upper double"))
    lows = [r.lower for r in rows.orderBy(F.col("lower").desc()).limit(most).select("lower").collect()]
    last = max(floor, lows[-1]) if len(lows) == most else floor
    wanted = rows.where(F.col("upper") >= last).select("id")
    if counts is not None:
        counts["full"] = wanted.count()
    score = F.round(dot(unit(F.col("v")), F.array(*[F.lit(float(x)) for x in q])), 9)
    found = staged(vectors.join(wanted, "id", "left_semi").select("id", score.alias("score")).where(F.col("score") >= floor))
    drop_staged(rows)
    return found.orderBy(F.col("score").desc(), "id").limit(most)
