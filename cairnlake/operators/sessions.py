"""Gap sessions, bursts, takes and timelines."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import STOP_WORDS, jaccard, stem_of, tokens
from cairnlake.functions.vectors import dot, unit


def gap_sessions(rows: DataFrame, by: list[str], time: str, gap: float, order: str = "id", most: int | None = None) -> DataFrame:
    """Rows with `session`, numbered from 0 within each group; a new one starts where the gap is exceeded.

    With `most`, sessions are cut after so many rows. Windows are per group; where there is no natural group,
    add a coarse one (a day or a camera) so that no task sorts the whole table.
    """
    w = Window.partitionBy(*by).orderBy(time, order)
    new = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    out = rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")
    if most:
        n = F.row_number().over(Window.partitionBy(*by, "session").orderBy(time, order))
        out = out.withColumn("part", F.floor((n - 1) / most))
    return out


def session_spans(sessions: DataFrame, by: list[str], time: str, least: int = 1) -> DataFrame:
    """(session, n, first, last) of sessions with enough rows."""
    return sessions.groupBy(*by, "session").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).where(F.col("n") >= least)


def burst_candidates(rows: DataFrame, by: list[str], time: str, gap: float) -> DataFrame:
    """Rows whose neighbour before or after is within the gap."""
    w = Window.partitionBy(*by).orderBy(time, "id")
    near = (F.col(time) - F.lag(time).over(w) <= gap) | (F.lead(time).over(w) - F.col(time) <= gap)
    return rows.withColumn("__near", F.coalesce(near, F.lit(False))).where("__near").drop("__near")


def trimmed_spans(rows: DataFrame, by: str, time: str, least: int = 5, most_seconds: float = 4 * 86400.0) -> DataFrame:
    """(by, first, last): times at the 10th and 90th hundredth of each group, if it is large and short enough.

    Ranks come from a window in the group, so no group's times are gathered in one value.
    """
    w = Window.partitionBy(by)
    ranked = rows.where(F.col(time).isNotNull()).select(by, time, F.row_number().over(w.orderBy(time)).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * p) + 1, F.col(time)))
    spans = ranked.groupBy(by).agg(F.max("n").alias("n"), at(0.1).alias("first"), at(0.9).alias("last"))
    return spans.where((F.col("n") >= least) & (F.col("last") - F.col("first") <= most_seconds)).select(by, "n", "first", "last")


@dataclass(frozen=True)
class BurstLimits:
    """Limits of a group of shots; hashes decide alone only where a vector is missing and `by_hash_alone` is set."""

    gap: float
    span: float
    to_last: float
    to_first: float
    bits: int
    most: int
    by_hash_alone: bool = False


#: The three profiles.
NEAR_DUPLICATES = BurstLimits(2.0, 12.0, 0.97, 0.955, 8, 24)
TAKES = BurstLimits(4.0, 30.0, 0.93, 0.88, 12, 60, True)
CLIPS = BurstLimits(900.0, 3600.0, 0.90, 0.86, 0, 24)
SIDECAR_COSINE = 0.90


def aligned_sidecars(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose `seconds` is the least of those with the same stem and a like vector, so that an export sorts beside its original."""
    stem = F.lower(stem_of(F.col("path")))
    keyed = rows.withColumn("__stem", stem)
    many = keyed.groupBy(*by, "__stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twins = keyed.join(many, [*by, "__stem"], "left_semi").where("v IS NOT NULL AND seconds IS NOT NULL").select(*by, "__stem", "id", "seconds", unit(F.col("v")).alias("u"))
    other = twins.select(*by, "__stem", F.col("id").alias("o"), F.col("seconds").alias("t"), F.col("u").alias("w"))
    near = twins.join(other, [*by, "__stem"]).where((F.col("t") < F.col("seconds")) & (dot(F.col("u"), F.col("w")) >= SIDECAR_COSINE))
    earlier = near.groupBy("id").agg(F.min("t").alias("__earlier"))
    return keyed.join(earlier, "id", "left").withColumn("seconds", F.coalesce("__earlier", "seconds")).select(*rows.columns)


def group_bursts(rows: DataFrame, by: list[str], limits: BurstLimits = NEAR_DUPLICATES) -> DataFrame:
    """(id, burst): a greedy pass over shots in order of time, stem, path and id.

    rows: by, id, path, seconds, phash, v. A shot joins the open group while gap, span and size allow, if it has
    a member's stem, or is alike to the group's first and last; a shot without a time stands alone. The group is
    named by its first id. A larger gap always ends a group, so the pass runs over gap sessions, whose rows
    stream by in order: only the open group is held, however long a session is.
    """
    timed = aligned_sidecars(rows, by).withColumn("__stem", F.lower(stem_of(F.col("path"))))
    cut = gap_sessions(timed.where("seconds IS NOT NULL"), by, "seconds", limits.gap)
    keys = [*by, "session"]
    ordered = cut.select(F.xxhash64(*keys).alias("key"), F.struct(*keys).cast("string").alias("name"), "seconds", "__stem", "path", "id", "phash", unit(F.col("v")).alias("v"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "name", "seconds", "__stem", "path", "id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[tuple] = []
        at = None
        for f in frames:
            out = []
            for name, t, stem, path, i, h, v in zip(f.name, f.seconds, f["__stem"], f.path, f.id, f.phash, f.v, strict=True):
                row = (t, stem, path, i, None if pd.isna(h) else int(h), None if v is None else np.asarray(v, dtype=float))
                if name != at or not _joins(row, open_, limits):
                    open_, at = [], name
                open_.append(row)
                out.append(open_[0][3])
            yield pd.DataFrame({"id": f.id, "burst": pd.array(out, dtype="int64")})

    found = ordered.select("key", F.col("name"), "seconds", "__stem", "path", "id", "phash", "v").mapInPandas(fold, "id bigint, burst bigint")
    return found.unionByName(timed.where("seconds IS NULL").select("id", F.col("id").alias("burst")))


def take_groups(rows: DataFrame, by: list[str], limits: BurstLimits = TAKES) -> DataFrame:
    """(burst, key, captured_at, similarity, shots): groups of shots to choose from, with two shots or more.

    rows as for group_bursts, with content_hash and size_bytes. Of files with equal contents the first counts; files of
    one stem are one shot, whose first file stands for it. similarity: the least cosine of neighbouring shots; key: a
    digest of the ids in order.
    """
    j = group_bursts(rows, by, limits).join(rows, "id").withColumn("__stem", F.lower(stem_of(F.col("path"))))
    order = ["seconds", "__stem", "path", "id"]
    copies = F.row_number().over(Window.partitionBy("burst", "content_hash", "size_bytes").orderBy(*order))
    j = j.withColumn("__copy", F.when(F.col("content_hash").isNotNull(), copies).otherwise(1)).where("__copy = 1")
    members = j.groupBy("burst").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("id")), ","), 256).alias("key"), F.max("seconds").alias("captured_at"))
    first = j.withColumn("__r", F.row_number().over(Window.partitionBy("burst", "__stem").orderBy(*order))).where("__r = 1").withColumn("__u", unit(F.col("v")))
    near = dot(F.col("__u"), F.lag("__u").over(Window.partitionBy("burst").orderBy(*order)))
    shots = first.withColumn("__near", near).groupBy("burst").agg(F.count(F.lit(1)).alias("shots"), F.round(F.greatest(F.least(F.coalesce(F.min("__near"), F.lit(1.0)), F.lit(1.0)), F.lit(0.0)), 4).alias("similarity"))
    return members.join(shots.where("shots >= 2"), "burst").select("burst", "key", "captured_at", "similarity", "shots")


#: Limits of suggestions over chosen files.
SUGGESTED_GAP, SUGGESTED_COSINE, SUGGESTED_OPEN, SUGGESTED_MOST = 20 * 60.0, 0.90, 32, 100


def suggested_groups(rows: DataFrame, ids: list[int], limit: int = 100) -> DataFrame:
    """(rank, first_id, members, similarity) over 2 to 10,000 chosen ids of rows (id, seconds, content_hash, size_bytes, v).

    In order of time and id a file joins the open group whose first file it is most like (the later of equals); a
    group closes when it began too long ago or too many are open; equal contents count once. One pass over files
    that the request names, 10,000 at most, so it runs in one task.
    """
    chosen = sorted(set(ids))
    if not 2 <= len(chosen) <= 10_000 or chosen[0] <= 0 or not 1 <= limit <= 100:
        raise ValueError("2 to 10,000 positive ids and a limit of 1 to 100")
    some = rows.where(F.col("id").isin(chosen) & F.col("seconds").isNotNull() & F.col("v").isNotNull()).select(F.lit(0).alias("g"), "id", "seconds", "content_hash", "size_bytes", unit(F.col("v")).alias("v"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        open_: list[dict] = []
        done: list[dict] = []
        seen: set[tuple] = set()
        f = f.sort_values(["seconds", "id"])
        for i, t, h, n, v in zip(f.id, f.seconds, f.content_hash, f.size_bytes, f.v, strict=True):
            if h is not None and not pd.isna(h):
                if (h, n) in seen:
                    continue
                seen.add((h, n))
            while open_ and t - open_[0]["began"] > SUGGESTED_GAP:
                done.append(open_.pop(0))
            best, most = None, SUGGESTED_COSINE
            for g in open_:
                s = float(np.dot(v, g["v"]))
                if len(g["ids"]) < SUGGESTED_MOST and s >= most:
                    best, most = g, s
            if best is not None:
                best["ids"].append(i)
                best["latest"], best["least"] = t, min(best["least"], most)
                continue
            if len(open_) >= SUGGESTED_OPEN:
                done.append(open_.pop(0))
            open_.append({"began": t, "latest": t, "v": v, "ids": [i], "least": 1.0})
        found = sorted((g for g in done + open_ if len(g["ids"]) >= 2), key=lambda g: (-g["latest"], g["ids"][0]))[:limit]
        return pd.DataFrame({"rank": range(1, len(found) + 1), "first_id": [g["ids"][0] for g in found], "members": [g["ids"] for g in found], "similarity": [min(g["least"], 1.0) for g in found]})

    return some.groupBy("g").applyInPandas(fold, "rank bigint, first_id bigint, members array<bigint>, similarity double")


def _joins(row: tuple, group: list[tuple], limits: BurstLimits) -> bool:
    t, stem, path, _, h, v = row
    first, last = group[0], group[-1]
    if len(group) >= limits.most or t - last[0] > limits.gap or t - first[0] > limits.span:
        return False
    if any(g[1] == stem and g[2] != path for g in group):
        return True
    bits = ((h ^ last[4]) & ((1 << 64) - 1)).bit_count() if h and last[4] else None
    if v is None or last[5] is None or first[5] is None:
        return limits.by_hash_alone and bits is not None and bits <= limits.bits
    if len(v) != len(first[5]) or v @ first[5] < limits.to_first:
        return False
    to_last = v @ last[5]
    return bool(to_last >= limits.to_last or (bits is not None and bits <= limits.bits and to_last >= limits.to_first))


def change_samples(signals: DataFrame, durations: DataFrame, by: list[str], interval: float, least: float = 0.025, spacing: float = 1.5, most: int = 100_000) -> DataFrame:
    """(by, seconds): time 0 and one sample an interval: its strongest change if far enough from the sample before, else its end.

    signals: by, seconds, change; durations: by, duration. Peaks are grouped maxima (the earliest of equals); the
    pass over a file's intervals, `most` of them at most, depends on order.
    """
    files = durations.where((F.col("duration") > 0) & (F.col("duration") / interval <= most))
    valid = signals.join(files, by).where((F.col("seconds") >= 0) & (F.col("seconds") < F.col("duration")) & F.col("change").between(least, 1.0))
    peaks = valid.groupBy(*by, F.floor(F.col("seconds") / interval).alias("w")).agg(F.max_by("seconds", F.struct("change", -F.col("seconds"))).alias("peak"))
    windows = files.select(*by, "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration") / interval) - 1)).alias("w"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("w")
        out = [0.0]
        for w, d, peak in zip(f.w, f.duration, f.peak, strict=True):
            end = min(d, (w + 1) * interval)
            if not np.isnan(peak) and peak - out[-1] >= spacing:
                out.append(peak)
            elif end < d and end - out[-1] >= spacing:
                out.append(end)
        return pd.DataFrame({c: [f[c].iloc[0]] * len(out) for c in by} | {"seconds": out})

    schema = ", ".join([f"`{x.name}` {x.dataType.simpleString()}" for x in durations.select(*by).schema.fields] + ["seconds double"])
    return windows.join(peaks, [*by, "w"], "left").groupBy(*by).applyInPandas(fold, schema)


def sliding_windows(rows: DataFrame, by: list[str], length: str, stride: str) -> DataFrame:
    """Overlapping fixed windows with their row count and peak."""
    return rows.groupBy(*by, F.window("ts", length, stride).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.max_by("id", F.struct("value", -F.col("id"))).alias("peak_id")).select(*by, F.col("w.start").alias("start"), "n", "peak", "peak_id")


def merged_intervals(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: float = 0.0) -> DataFrame:
    """Gaps and islands: unions of intervals that overlap or are no further apart than `gap`."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0))
    return marked.withColumn("__g", F.sum("__new").over(w)).groupBy(*by, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


#: Limits of activity.
ACTIVITY_CHANGE, PAD, MERGE_GAP, WINDOW_SECONDS, WINDOW_FRAMES = 0.02, 0.5, 1.0, 2.5, 6


def activity_windows(frames: DataFrame, durations: DataFrame, by: list[str], least: float = ACTIVITY_CHANGE, pad: float = PAD, gap: float = MERGE_GAP, length: float = WINDOW_SECONDS, most: int = WINDOW_FRAMES) -> DataFrame:
    """(by, start, end, times): where frames change, in windows of `length` seconds with `most` of the frames' times.

    frames: by, seconds, change; durations: by, duration. A change spans from the frame before to the frame,
    padded and held to the file; spans not further apart than `gap` are one. Each is cut into even windows; of
    more frames than `most` evenly placed ones are kept; a window with fewer than two takes the two frames nearest
    to its start. Frames meet windows by cells of `length`, never all of a file's.
    """
    order = Window.partitionBy(*by).orderBy("seconds")
    known = frames.join(durations.where("duration > 0"), by)
    changed = known.withColumn("__before", F.lag("seconds").over(order)).where(F.col("__before").isNotNull() & (F.col("change") >= least))
    spans = changed.select(*by, F.greatest(F.col("__before") - pad, F.lit(0.0)).alias("start"), F.least(F.col("seconds") + pad, "duration").alias("end"))
    islands = merged_intervals(spans, by, gap=gap)
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / length), F.lit(1)).cast("int")
    cut = islands.select(*by, "start", "end", n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("__i"))
    size = (F.col("end") - F.col("start")) / F.col("__n")
    cut = cut.select(*by, (F.col("start") + F.col("__i") * size).alias("__a"), F.when(F.col("__i") == F.col("__n") - 1, F.col("end")).otherwise(F.col("start") + F.col("__i") * size + size).alias("__b"))
    cells = cut.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__a") / length), F.floor(F.col("__b") / length))))
    inside = cells.join(frames.select(*by, "seconds", F.floor(F.col("seconds") / length).alias("__cell")), [*by, "__cell"]).where("seconds BETWEEN __a AND __b")
    times = inside.groupBy(*by, "__a", "__b").agg(F.array_sort(F.collect_list("seconds")).alias("__t"))
    # the frames about a window's start: the two up to it and the two after
    near = lambda k: F.lead("seconds", k).over(order) if k > 0 else F.lag("seconds", -k).over(order)
    about = frames.select(*by, F.col("seconds").alias("__at"), F.array("seconds", near(-1), near(1), near(2)).alias("__f"), F.lit(None).cast("double").alias("__a"), F.lit(None).cast("double").alias("__b"))
    asked = cut.select(*by, F.col("__a").alias("__at"), F.lit(None).cast("array<double>").alias("__f"), "__a", "__b")
    upto = Window.partitionBy(*by).orderBy("__at", F.col("__a").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    from_ = Window.partitionBy(*by).orderBy("__at", F.col("__a").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    both = about.unionByName(asked).withColumn("__f", F.coalesce(F.last("__f", ignorenulls=True).over(upto), F.first("__f", ignorenulls=True).over(from_))).where("__a IS NOT NULL")
    nearest = F.slice(F.array_sort(F.transform(F.array_compact("__f"), lambda x: F.struct(F.abs(x - F.col("__a")).alias("d"), x.alias("x")))), 1, 2)
    joined = both.select(*by, "__a", "__b", F.transform(nearest, lambda x: x["x"]).alias("__near")).join(times, [*by, "__a", "__b"], "left").withColumn("__t", F.coalesce("__t", F.array().cast("array<double>")))
    step = (F.size("__t") - 1) / (most - 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get("__t", F.floor(k * step + 0.5).cast("int")))
    found = F.when(F.size("__t") > most, even).when(F.size("__t") < 2, F.array_sort(F.array_union("__t", "__near"))).otherwise(F.col("__t"))
    out = joined.select(*by, "__a", "__b", found.alias("times")).where(F.size("times") >= 2)
    return out.select(*by, F.least("__a", F.element_at("times", 1)).alias("start"), F.greatest("__b", F.element_at("times", -1)).alias("end"), "times")


def still_spans(windows: DataFrame, durations: DataFrame, by: list[str], least: float = 0.001) -> DataFrame:
    """(by, from, to): what no window (start, end) covers of 0..duration, before the first and after the last too."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.coalesce(F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0))
    between = windows.select(*by, reach.alias("from"), F.col("start").alias("to"))
    ends = windows.groupBy(*by).agg(F.max("end").alias("from"))
    tail = durations.join(ends, by, "left").select(*by, F.greatest(F.coalesce("from", F.lit(0.0)), F.lit(0.0)).alias("from"), F.col("duration").alias("to"))
    return between.unionByName(tail).where(F.col("to") > F.col("from") + least)


def chapter_starts(captions: DataFrame, by: list[str], unlike: float = 0.12, like: float = 0.35, least: int = 3) -> DataFrame:
    """(by, start, end, text): drafts of chapters at captions unlike the one before and like the one after.

    captions: by, id, seconds, text; blank ones are left out, files with fewer than `least` or without such a
    caption have no chapters. The first caption starts the first chapter; the last one's end is null.
    """
    words = lambda x: F.array_except(F.array_distinct(tokens(x)), F.array(*[F.lit(w) for w in STOP_WORDS]))
    order = Window.partitionBy(*by).orderBy("seconds", "id")
    c = captions.where((F.col("seconds") >= 0) & (F.trim("text") != "")).withColumn("__s", words(F.col("text")))
    c = c.withColumn("__before", F.lag("__s").over(order)).withColumn("__after", F.lead("__s").over(order)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    boundary = F.col("__before").isNotNull() & F.col("__after").isNotNull() & (jaccard(F.col("__before"), F.col("__s")) < unlike) & (jaccard(F.col("__s"), F.col("__after")) >= like)
    c = c.where(F.col("__n") >= least).withColumn("__boundary", F.coalesce(boundary, F.lit(False))).withColumn("__any", F.max("__boundary").over(Window.partitionBy(*by)))
    starts = c.where(F.col("__any") & (F.col("__boundary") | F.col("__before").isNull()))
    following = F.lead("seconds").over(order)
    return starts.select(*by, F.col("seconds").alias("start"), F.greatest("seconds", following - 0.001).alias("end"), "text").withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")))


@dataclass(frozen=True)
class SceneLimits:
    """M04. Cosine to the scene so far and to its first frame, frames that confirm a cut, least and greatest seconds of a scene."""

    cut: float = 0.85
    drift: float = 0.70
    confirm: int = 2
    least: float = 2.0
    most: float = 20.0


def scenes(frames: DataFrame, durations: DataFrame, by: list[str], limits: SceneLimits = SceneLimits()) -> DataFrame:  # noqa: B008
    """(by, scene, start, end, representative, frames) of each file's frames (by, id, seconds, v) in order of time.

    A scene ends where `confirm` frames in a row are unlike the sum of its frames or its first one, after its least
    length, and at the latest after its greatest. The frame most like the mean stands for it. durations: (by, duration);
    files without a positive one are left out. Frames are sampled, some thousands a file at most, so a task holds a file.
    """

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["seconds", "id"])
        v = [np.asarray(x, float) for x in f.v]
        t, duration = f.seconds.tolist(), float(f.duration.iloc[0])
        bounds, total, pending = [0], v[0].copy(), 0
        for i in range(1, len(v)):
            start = bounds[-1]
            length = t[i] - t[start]
            if length >= limits.most:
                bounds.append(i)
                total, pending = v[i].copy(), 0
                continue
            alike = len(v[i]) == len(total) and _cosine(v[i], total) >= limits.cut and _cosine(v[i], v[start]) >= limits.drift
            pending = pending + 1 if not alike and length >= limits.least else 0
            if pending >= limits.confirm:
                first = i + 1 - limits.confirm
                bounds.append(first)
                total, pending = sum(v[first + 1 : i + 1], v[first].copy()), 0
            elif len(v[i]) == len(total):
                total += v[i]
        ends, ids = [*bounds[1:], len(v)], f.id.tolist()
        rows = []
        for n, (a, b) in enumerate(zip(bounds, ends, strict=True)):
            mean = sum((x for x in v[a + 1 : b] if len(x) == len(v[a])), v[a].copy())
            best = max(range(a, b), key=lambda i: (_cosine(v[i], mean), -i))
            rows.append((n, 0.0 if a == 0 else t[a], t[b] if b < len(v) else duration, ids[best], b - a))
        return pd.DataFrame({c: [f[c].iloc[0]] * len(rows) for c in by} | dict(zip(("scene", "start", "end", "representative", "frames"), zip(*rows, strict=True), strict=True)))

    some = frames.join(durations.where("duration > 0"), by)
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*by).schema.fields]
    return some.groupBy(*by).applyInPandas(fold, ", ".join([*schema, "scene bigint, start double, end double, representative bigint, frames bigint"]))


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if len(a) == len(b) and n > 0 else 0.0


#: Marks that join the word before without a space: those of ASCII and the ones listed.
MARKS = frozenset(string.punctuation) | {chr(c) for c in range(0x2010, 0x2028)} | set("\u3001\u3002\uff01\uff0c\uff1f\u00a1\u00bf")
#: Seconds of sound that a chunk owns, and those it hears beyond them on either side.
CORE, OVERLAP = 45.0, 1.5


def owned_words(words: DataFrame, durations: DataFrame, by: list[str], core: float = CORE, overlap: float = OVERLAP) -> DataFrame:
    """(by, chunk, id, start, end, text, confidence): each word heard in overlapping chunks once, where its middle is owned.

    words: (by, chunk, id, timestamp, duration, text, confidence), times from where the chunk begins to hear; durations:
    (by, length). Words without text or finite times, and those past the end, are left out.
    """
    owned = F.col("chunk") * core
    heard, text = F.greatest(owned - overlap, F.lit(0.0)), F.trim("text")
    j = words.join(durations.where("length > 0"), by)
    start = heard + F.greatest("timestamp", F.lit(0.0))
    end = F.least(F.col("length"), heard + F.greatest(F.col("timestamp"), F.col("timestamp") + F.col("duration")))
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("timestamp", "duration", "confidence")]
    j = j.where(finite[0] & finite[1] & finite[2] & (text != "")).withColumns({"start": start, "end": end})
    middle = F.col("start") + (F.col("end") - F.col("start")) / 2
    mine = (middle >= owned) & (middle < F.least(owned + core, F.col("length"))) & (F.col("start") < F.col("length")) & (F.col("end") >= F.col("start"))
    return j.where(mine).select(*by, "chunk", "id", "start", "end", text.alias("text"), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"), "length")


def passages(words: DataFrame, durations: DataFrame, by: list[str], pause: float = 1.25, span: float = 8.0, chars: int = 280, core: float = CORE, overlap: float = OVERLAP) -> DataFrame:
    """(by, chunk, start, end, text, confidence): owned words of a chunk joined until a pause, a span or a text budget is exceeded.

    A pause counts from the end of the word before; punctuation joins without a space. A task holds a chunk's words.
    """

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["start", "id"])
        groups: list[list] = []
        size = 0
        for w in f.itertuples():
            if groups and w.start - groups[-1][-1].end <= pause and w.start - groups[-1][0].start <= span and size + len(w.text) <= chars:
                groups[-1].append(w)
                size += len(w.text)
            else:
                groups.append([w])
                size = len(w.text)
        length = float(f.length.iloc[0])
        rows = []
        for g in groups:
            text = "".join(w.text if i == 0 or w.text[0] in MARKS else f" {w.text}" for i, w in enumerate(g))
            end = min(length, g[-1].start + max(g[-1].end - g[-1].start, 0.001))
            rows.append((g[0].start, max(g[0].start + 0.001, end), text, sum(w.confidence for w in g) / len(g)))
        head = {c: [f[c].iloc[0]] * len(rows) for c in [*by, "chunk"]}
        return pd.DataFrame(head | dict(zip(("start", "end", "text", "confidence"), zip(*rows, strict=True), strict=True)))

    own = owned_words(words, durations, by, core, overlap)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in own.select(*by, "chunk").schema.fields] + ["start double, end double, text string, confidence double"])
    return own.groupBy(*by, "chunk").applyInPandas(fold, schema)


def goodness(n: Column, age_days: Column) -> Column:
    """How good a take group is to keep: its size up to 12, and its age with a half-life of 14 days."""
    return 0.6 * F.least(n, F.lit(12)) / 12 + 0.4 * F.pow(F.lit(0.5), age_days / 14)


def take_scores(rows: DataFrame, group: str, weights: dict[str, float], penalty: Column | None = None) -> DataFrame:
    """(group, id, total, rank): measures scaled by their group's greatest, blended, less a penalty; ties by sharpness, then id."""
    w = Window.partitionBy(group)
    total = F.lit(0.0)
    for name, weight in weights.items():
        top = F.max(name).over(w)
        total += weight * F.when(top > 0, F.col(name) / top).otherwise(0.0)
    if penalty is not None:
        total -= penalty
    scored = rows.withColumn("total", F.round(total, 4))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.col("total").desc(), F.col(next(iter(weights))).desc(), "id")).cast("long"))


def representatives(members: DataFrame, penalty: float = 0.001) -> DataFrame:
    """(group, id): the member with the greatest sum of cosines to the others of its group; raw files lose a little, ties go to the least id.

    members: group, id, raw, v. A member's sum is its product with the sum of all unit vectors of the group, less
    its own, so no pairs are made.
    """
    u = members.withColumn("u", unit(F.col("v")))
    sums = u.select("group", F.posexplode("u").alias("i", "x")).groupBy("group", "i").agg(F.sum("x").alias("x"))
    total = sums.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    s = dot(F.col("u"), F.col("total")) - dot(F.col("u"), F.col("u")) - F.when(F.col("raw"), penalty).otherwise(0.0)
    scored = u.join(total, "group").select("group", "id", F.round(s, 9).alias("s"))
    return scored.groupBy("group").agg(F.max(F.struct("s", (-F.col("id")).alias("back"))).alias("x")).select("group", (-F.col("x.back")).alias("id"))
