"""Proposals of related takes over a whole library: sessions of a timeline, and groups of like shots in each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import stem_of
from cairnlake.functions.vectors import cosine
from cairnlake.operators import sessions
from cairnlake.session import staged


@dataclass(frozen=True)
class TakeLimits:
    """Seconds from the latest and the first of a group, least cosine to its first without and with a common subject, seconds of one moment."""

    gap: float
    span: float
    alike: float
    with_subject: float
    at_once: float


#: Limits of photos and videos, of sessions and groups, and of files whose whole content is hashed.
PHOTOS, VIDEOS = TakeLimits(120.0, 1200.0, 0.90, 0.86, 2.0), TakeLimits(1200.0, 7200.0, 0.88, 0.84, 30.0)
SESSION_GAP, SESSION_FILES, OPEN_GROUPS, GROUP_FILES = 1800.0, 2000, 32, 100
FULL_HASH_BYTES = 16 << 20
VERSION = "related-takes-v1"
#: Extensions of raw photos, which never stand for a shot that has another file.
RAW = ("3fr", "arw", "cr2", "cr3", "dng", "iiq", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "srw", "x3f")

PROPOSAL_SQL = "session string, media string, key string, relation string, file_ids array<bigint>, evidence array<string>, similarity double, captured_at double"


def timeline_sessions(rows: DataFrame, by: str, time: str, gap: float, most: int) -> DataFrame:
    """rows (id, by, time, ...) with `part`, a number of their session: a new one begins after a gap or after `most` rows.

    A timeline of all rows has few keys and no natural cut, so rows are ranged by time, each range counts its own, and a
    row for each range tells the next where it stands. A session may span ranges.
    """
    order = [F.col(by), F.col(time), F.col("id")]
    ranged = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__p", F.shiftright("__at", 33))
    own = Window.partitionBy("__p", by).orderBy("__at")
    before = Window.partitionBy(by).orderBy("__p")
    ends = ranged.groupBy(by, "__p").agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    ends = ends.select(by, "__p", (F.sum("n").over(before) - F.col("n")).alias("rows_before"), F.lag("last").over(before).alias("time_before"))
    placed = ranged.join(F.broadcast(ends), [by, "__p"])
    gone = F.col(time) - F.coalesce(F.lag(time).over(own), F.col("time_before"))
    placed = placed.withColumn("__rank", F.row_number().over(own) + F.col("rows_before")).withColumn("__new", gone.isNull() | (gone > gap))
    placed = staged(placed.withColumn("__start", F.max(F.when(F.col("__new"), F.col("__rank"))).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    starts = placed.groupBy(by, "__p").agg(F.max("__start").alias("__s"))
    starts = starts.select(by, "__p", F.max("__s").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    start = F.coalesce("__start", "__carried")
    number = start + F.floor((F.col("__rank") - start) / most) * most
    return placed.join(F.broadcast(starts), [by, "__p"]).select(*rows.columns, number.cast("bigint").alias("part"))


def eligible(files: DataFrame, subjects: DataFrame) -> DataFrame:
    """Photos and videos (id, media, path, stem, raw, seconds, camera, v, people, fingerprint) that may be proposed; of equal contents the lowest id.

    files: (id, kind, path, extension, seconds, camera, content_hash, size_bytes, modified_at, v); subjects: (file_id, person).
    """
    some = files.where(F.col("kind").isin("image", "video") & F.col("seconds").isNotNull() & ~F.isnan("seconds") & F.col("v").isNotNull())
    whole = F.col("content_hash").isNotNull() & F.col("size_bytes").between(0, FULL_HASH_BYTES)
    first = some.where(whole).groupBy("content_hash", "size_bytes").agg(F.min("id").alias("id")).select("id")
    kept = some.where(~F.coalesce(whole, F.lit(False))).unionByName(some.where(whole).join(first, "id", "left_semi"))
    people = subjects.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("person")).alias("people"))
    camera = F.when(F.trim("camera") != "", F.trim("camera"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    mark = F.concat_ws("|", text("size_bytes"), text("modified_at"), text("seconds"), F.coalesce(camera, F.lit("")), F.array_join(F.col("people").cast("array<string>"), ","), "path")
    found = kept.join(people, "id", "left").withColumn("people", F.coalesce("people", F.array().cast("array<bigint>")))
    return found.select(
        "id", F.when(F.col("kind") == "image", "photos").otherwise("videos").alias("media"), "path", F.lower(stem_of(F.col("path"))).alias("stem"),
        F.coalesce(F.lower("extension").isin(*RAW), F.lit(False)).alias("raw"), "seconds", camera.alias("camera"), F.col("v").cast("array<double>").alias("v"), "people", mark.alias("fingerprint"),
    )


def take_proposals(files: DataFrame, subjects: DataFrame, photos: TakeLimits = PHOTOS, videos: TakeLimits = VIDEOS, gap: float = SESSION_GAP, most: int = SESSION_FILES, model: str = "", stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(proposals, members): groups of related takes, and each file's session with its fingerprint.

    In a session a file joins the open group whose first file it is most like, if it is like enough (less is asked where
    it shows somebody whom all of the group show), comes soon enough after its latest and first, and does not only show
    people whom nobody of the group shows. A group closes when its time is over or too many are open; two shots or
    more make a proposal. A session has `most` files at most, so a task holds one session.

    stored: (file_id, session, fingerprint) of an earlier run; sessions whose files all are as they were are left out of
    proposals, and refreshed() keeps their old ones.
    """
    placed = timeline_sessions(eligible(files, subjects), "media", "seconds", gap, most)
    members = placed.groupBy("media", "part").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # `most` ids at most
    digest = F.substring(F.sha2(F.concat(F.lit(f"{VERSION}|{model}|"), "media", F.lit("|"), F.array_join(F.col("ids").cast("array<string>"), ",")), 256), 1, 16)
    named = staged(placed.join(members.select("media", "part", F.concat("media", F.lit("-"), digest).alias("session")), ["media", "part"]).drop("part"))
    open_ = named
    if stored is not None:
        same = named.join(stored.select(F.col("file_id").alias("id"), "session", "fingerprint"), ["id", "session", "fingerprint"], "left_semi").groupBy("session").agg(F.count(F.lit(1)).alias("same"))
        sizes = named.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
        open_ = named.join(sizes.join(same, "session", "left").where("same IS NULL OR same < n").select("session"), "session", "left_semi")
    proposals = open_.groupBy("session").applyInPandas(_session(photos, videos), PROPOSAL_SQL)
    return proposals, named.select(F.col("id").alias("file_id"), "session", "fingerprint")


def refreshed(old: DataFrame, new: DataFrame, members: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored proposals after a run: those of sessions that are as they were, and the new ones of the others."""
    now = members.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    same = members.join(stored, ["file_id", "session", "fingerprint"], "left_semi").groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return old.join(now.join(same, ["session", "n"]).select("session"), "session", "left_semi").unionByName(new)


@dataclass(eq=False)
class _Open:
    anchor: np.ndarray
    began: float
    latest: float
    rows: list
    common: frozenset
    known: frozenset
    lowest: float = 1.0


def _session(photos: TakeLimits, videos: TakeLimits) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        limits = photos if f.media.iloc[0] == "photos" else videos
        open_: list[_Open] = []
        done: list[_Open] = []
        for r in f.sort_values(["seconds", "id"]).itertuples():
            v, people, t = np.asarray(r.v, float), frozenset(r.people), r.seconds
            norm = v @ v
            if not abs(norm - 1.0) <= 0.02:  # not a unit vector, or not finite
                continue
            v = v / np.sqrt(norm)
            over = lambda g: t - g.latest > limits.gap or t - g.began > limits.span  # noqa: E731, B023
            done += filter(over, open_)
            open_ = [g for g in open_ if not over(g)]
            best, most = None, -np.inf
            for g in open_:
                if len(g.rows) >= GROUP_FILES or (people and g.known and people.isdisjoint(g.known)):
                    continue
                s = float(v @ g.anchor) if len(v) == len(g.anchor) else -1.0
                if s >= (limits.alike if people.isdisjoint(g.common) else limits.with_subject) and s > most:
                    best, most = g, s
            if best is not None:
                best.rows.append(r)
                best.latest, best.lowest, best.common, best.known = t, min(best.lowest, most), best.common & people, best.known | people
                continue
            if len(open_) >= OPEN_GROUPS:
                done.append(open_.pop(0))
            open_.append(_Open(v, t, t, [r], people, people))
        found = [p for g in done + open_ if (p := _proposal(g, limits)) is not None]
        media, session = f.media.iloc[0], f.session.iloc[0]
        return pd.DataFrame([(session, media, *p) for p in found], columns=[c.split()[0] for c in PROPOSAL_SQL.split(", ")])

    return run


def _proposal(group: _Open, limits: TakeLimits) -> tuple | None:
    """(key, relation, file_ids, evidence, similarity, captured_at) of a group of two shots or more; files of one stem are one shot."""
    stems: dict[str, list] = {}
    for r in group.rows:
        stems.setdefault(r.stem, []).append(r)
    if len(stems) < 2:
        return None
    shots = sorted(((min(r.seconds for r in rows), min(rows, key=lambda r: (r.raw, r.id))) for rows in stems.values()), key=lambda s: (s[0], s[1].id))
    first = [r for _, r in shots]
    ids = sorted(r.id for r in group.rows)
    relation, camera = take_relation([(r.camera, r.seconds) for r in first], limits.at_once)
    evidence = ["captureSession", "visualSimilarity", *["sharedSubject"] * bool(group.common), camera]
    key = "takes-" + hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()[:16]
    return key, relation, ids, evidence, float(np.floor(min(max(group.lowest, 0.0), 1.0) * 10_000 + 0.5) / 10_000), max(r.seconds for r in group.rows)


def take_relation(shots: list[tuple[str | None, float]], at_once: float) -> tuple[str, str]:
    """(relation, why) of shots (camera, seconds) in order: alternate views by two cameras at once, else repeated attempts by one camera, else uncertain."""
    timed = sorted(((t, c) for c, t in shots if c is not None), key=lambda x: x[0])
    for i, (t, c) in enumerate(timed):
        for u, d in timed[i + 1 :]:
            if u - t > at_once:
                break
            if c != d:
                return "alternateViews", "simultaneousCameras"
    cameras = {c for c, _ in shots}
    if None in cameras:
        return "uncertain", "cameraDetailsMissing"
    return ("repeatedAttempts", "sameCamera") if len(cameras) == 1 else ("uncertain", "mixedCameras")


def relations(shots: DataFrame, by: str, at_once: float) -> DataFrame:
    """(by, relation, why) of groups of shots (by, id, camera, seconds), as take_relation tells it.

    Two shots of one moment by different cameras are next to each other in time, or others between them are such a pair.
    """
    w = Window.partitionBy(by).orderBy("seconds", "id")
    pair = (F.col("camera") != F.lag("camera").over(w)) & (F.col("seconds") - F.lag("seconds").over(w) <= at_once)
    both = shots.where("camera IS NOT NULL").withColumn("pair", pair).groupBy(by).agg(F.coalesce(F.bool_or("pair"), F.lit(False)).alias("views"), F.countDistinct("camera").alias("cameras"))
    all_ = shots.groupBy(by).agg(F.bool_and(F.col("camera").isNotNull()).alias("known")).join(both, by, "left")
    told = [F.when(F.coalesce("views", F.lit(False)), a).when(~F.col("known"), b).when(F.col("cameras") == 1, c).otherwise(d) for a, b, c, d in (("alternateViews", "uncertain", "repeatedAttempts", "uncertain"), ("simultaneousCameras", "cameraDetailsMissing", "sameCamera", "mixedCameras"))]
    return all_.select(by, told[0].alias("relation"), told[1].alias("why"))


def recommendations(takes: DataFrame, by: str = "event", confident: float = 0.65, least: float = 0.5, close: float = 0.05, better: float = 0.1) -> DataFrame:
    """(by, status, file_ids): which take of an event serves its goal.

    takes: (by, goal, file_id, preferred, stale, outcome, confidence, quality). Without a goal or a second take nothing is
    told; takes that the user prefers win, several tie; otherwise every take needs fresh and confident evidence of the
    outcome and one `least` of it. Takes `close` to the best lead; of several leaders one that is `better` in quality is
    ranked first, if the quality of all is known, and else they tie.
    """
    sure = ~F.col("stale") & F.col("outcome").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= confident)
    liked = F.array_sort(F.collect_list(F.when(F.col("preferred") & ~F.col("stale"), F.col("file_id"))))
    g = takes.groupBy(by).agg(F.first("goal").alias("goal"), F.count(F.lit(1)).alias("n"), liked.alias("liked"), F.bool_and(sure).alias("sure"), F.greatest(F.max("outcome"), F.lit(0.0)).alias("best"))
    lead = takes.join(g.where("sure").select(by, "best"), by).where(F.col("outcome") >= F.col("best") - close)
    first = lead.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("quality").desc(), "file_id")))
    at = lambda i, c: F.max(F.when(F.col("r") == i, F.col(c)))
    leaders = first.groupBy(by).agg(F.array_sort(F.collect_list("file_id")).alias("ids"), F.count_if(F.col("quality").isNull()).alias("unknown"), at(1, "file_id").alias("top"), (at(1, "quality") - at(2, "quality")).alias("lead"))
    answer = lambda status, ids: F.struct(F.lit(status).alias("status"), ids.alias("file_ids"))
    none = F.array().cast("array<bigint>")
    told = (
        F.when((F.coalesce("goal", F.lit("")) == "") | (F.col("n") < 2), answer("insufficient", none)).when(F.size("liked") == 1, answer("preferred", F.col("liked"))).when(F.size("liked") > 1, answer("tie", F.col("liked")))
        .when(~F.col("sure") | (F.col("best") < least), answer("insufficient", none)).when(F.size("ids") == 1, answer("ranked", F.col("ids")))
        .when((F.col("unknown") == 0) & (F.col("lead") >= better), answer("ranked", F.array("top"))).otherwise(answer("tie", F.col("ids")))
    )
    return g.join(leaders, by, "left").select(by, told.alias("x")).select(by, "x.*")


def loose_events(files: DataFrame, gap: float, least: int) -> DataFrame:
    """(id, folder) for loose photos and videos (id, seconds): events wherever more than `gap` seconds lie between two.

    An event of `least` files or more has a dated folder, with a range where it ends on another day; smaller ones go to
    their month. Files without a time are left out.
    """
    timed = files.where("seconds > 0").select("id", "seconds", F.lit(0).alias("all"))
    placed = timeline_sessions(timed, "all", "seconds", gap, 1 << 40)
    g = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.timestamp_seconds(F.min("seconds")).alias("a"), F.timestamp_seconds(F.max("seconds")).alias("b"))
    day = lambda x, form: F.date_format(x, form)
    name = F.when(F.col("n") < least, day("a", "MMMM")).when(F.to_date("a") == F.to_date("b"), day("a", "yyyy-MM-dd")).otherwise(F.concat(day("a", "yyyy-MM-dd"), F.lit(" to "), day("b", "MM-dd")))
    return placed.join(g.select("part", F.concat(F.lit("Photos/"), day("a", "yyyy"), F.lit("/"), name).alias("folder")), "part").select("id", "folder")


def discovered_takes(files: DataFrame, decisions: DataFrame | None = None, limit: int = 100, photos: sessions.BurstLimits = sessions.TAKES, videos: sessions.BurstLimits = sessions.CLIPS) -> DataFrame:
    """(rank, key, media, status, captured_at, similarity, shots, file_ids): groups of tries to choose from, best first.

    files: (id, kind, path, extension, seconds, phash, v, content_hash, size_bytes). Bursts of photos and of videos have
    their own limits; of equal contents (of files that are hashed whole) the lowest id counts; files of one stem are one
    shot, which its first file that is not raw stands for, and two shots or more make a group. similarity is the least
    cosine of neighbouring shots. decisions: (decision, file_ids): a group inside a `keepAll` is gone, one inside a `skip`
    stands last. Groups go by 0.6 * shots, twelve at most, + 0.4 * age, halved each fortnight before the newest.
    """
    some = files.where(F.col("kind").isin("image", "video") & F.col("seconds").isNotNull() & ~F.isnan("seconds") & (F.abs("seconds") < float("inf")))
    some = some.withColumns({"media": F.when(F.col("kind") == "image", "photos").otherwise("videos"), "raw": F.coalesce(F.lower("extension").isin(*RAW), F.lit(False)), "stem": F.lower(stem_of(F.col("path")))})
    rows = staged(sessions.aligned_sidecars(some.select("id", "media", "path", "stem", "raw", "seconds", "phash", "v", "content_hash", "size_bytes"), ["media"]))
    found = None
    for media, limits in (("photos", photos), ("videos", videos)):
        # a longer gap always ends a burst, so a session is a part of its own
        own = timeline_sessions(rows.where(F.col("media") == media), "media", "seconds", limits.gap, 1 << 40)
        bursts = sessions.group_bursts(own, ["media", "part"], limits)
        found = bursts if found is None else found.union(bursts)
    j = staged(found).join(rows, "id")
    whole = F.col("content_hash").isNotNull() & F.col("size_bytes").between(0, FULL_HASH_BYTES)
    copy = F.row_number().over(Window.partitionBy("burst", "content_hash", "size_bytes").orderBy("id"))
    members = j.withColumn("copy", F.when(whole, copy).otherwise(1)).where("copy = 1").drop("copy")
    shots = members.groupBy("burst", "stem").agg(F.min("seconds").alias("at"), F.min(F.struct("raw", "id", "v")).alias("x")).select("burst", "at", F.col("x.id").alias("id"), "x.v")
    order = Window.partitionBy("burst").orderBy("at", "id")
    near = shots.where("v IS NOT NULL").withColumn("near", cosine(F.col("v"), F.lag("v").over(order))).groupBy("burst").agg(F.min("near").alias("near"))
    sizes = shots.groupBy("burst").agg(F.count(F.lit(1)).alias("shots")).where("shots >= 2")
    ids = members.groupBy("burst").agg(F.array_sort(F.collect_list("id")).alias("file_ids"), F.greatest(F.max("seconds"), F.lit(0.0)).alias("captured_at"), F.first("media").alias("media"))  # a burst's shots at most
    key = F.concat(F.lit("takes-"), F.substring(F.sha2(F.array_join(F.col("file_ids").cast("array<string>"), ","), 256), 1, 16))
    clamped = F.least(F.greatest(F.coalesce("near", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    groups = staged(ids.join(sizes, "burst").join(near, "burst", "left").select(key.alias("key"), "media", "captured_at", F.round(clamped, 4).alias("similarity"), "shots", "file_ids"))
    inside = lambda decision: F.lit(False)
    if decisions is not None:
        chosen = decisions.withColumn("d", F.monotonically_increasing_id()).select("d", "decision", F.explode(F.array_distinct("file_ids")).alias("id"))
        met = groups.select("key", F.size("file_ids").alias("n"), F.explode("file_ids").alias("id")).join(staged(chosen), "id").groupBy("key", "n", "d", "decision").agg(F.count(F.lit(1)).alias("m")).where("m = n")
        groups = groups.join(met.groupBy("key").agg(F.collect_set("decision").alias("decided")), "key", "left")
        inside = lambda decision: F.coalesce(F.array_contains("decided", decision), F.lit(False))
    visible = groups.where(~inside("keepAll")).withColumn("status", F.when(inside("skip"), "skipped").otherwise("open"))
    newest = visible.agg(F.max("captured_at").alias("newest"))
    value = sessions.goodness(F.col("shots"), F.greatest(F.col("newest") - F.col("captured_at"), F.lit(0.0)) / 86_400.0)
    order = [F.col("status") == "skipped", F.col("value").desc(), F.col("captured_at").desc(), F.col("key")]
    first = visible.join(F.broadcast(newest), F.lit(True)).withColumn("value", value).orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # `limit` rows
    return first.select(rank.alias("rank"), "key", "media", "status", "captured_at", "similarity", "shots", "file_ids")
