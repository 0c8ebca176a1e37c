"""Sessions, bursts, takes and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import STOP_WORDS
from cairnlake.functions.vectors import cosine
from cairnlake.operators import proposals
from cairnlake.operators import sessions as T
from cairnlake.plans.registry import query

_SESS = """
WITH d AS (SELECT *, CASE WHEN seconds - lag(seconds) OVER (PARTITION BY "user" ORDER BY seconds, id) > {0} THEN 1 ELSE 0 END AS new FROM signals),
s AS (SELECT *, sum(new) OVER (PARTITION BY "user" ORDER BY seconds, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM d)
"""


@query("sess_gap_2h", _SESS.format(7200) + 'SELECT "user", session, count(*) AS n, round(max(seconds) - min(seconds), 3) AS span FROM s GROUP BY "user", session')
def _(c):
    s = T.gap_sessions(c.signals, ["user"], "seconds", 7200)
    return T.session_spans(s, ["user"], "seconds").select("user", "session", "n", F.round(F.col("last") - F.col("first"), 3).alias("span"))


@query("sess_gap_30m_cap", _SESS.format(1800).replace('"user"', "kind") + "SELECT id, kind, session, ((row_number() OVER (PARTITION BY kind, session ORDER BY seconds, id) - 1) // 2000)::BIGINT AS part FROM s")
def _(c):
    return T.gap_sessions(c.signals, ["kind"], "seconds", 1800, most=2000).select("id", "kind", "session", "part")


@query("sess_loose_events", """
WITH f AS (SELECT id, CASE WHEN id % 37 = 0 THEN 0 ELSE coalesce(created_at, modified_at) END AS t FROM files WHERE kind IN ('image', 'video') AND id % 3 <> 0), n AS (SELECT *, coalesce(t - lag(t) OVER (ORDER BY t, id) > 100000, true) AS new FROM f WHERE t > 0),
s AS (SELECT *, sum(new::INT) OVER (ORDER BY t, id) AS s FROM n), g AS (SELECT s, count(*) AS n, make_timestamp((min(t) * 1e6)::BIGINT) AS a, make_timestamp((max(t) * 1e6)::BIGINT) AS b FROM s GROUP BY s)
SELECT id, strftime(a, 'Photos/%Y/') || CASE WHEN n < 5 THEN strftime(a, '%B') WHEN a::DATE = b::DATE THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || strftime(b, ' to %m-%d') END AS folder FROM s JOIN g ON g.s = s.s""")
def _(c):
    some = c.files.where("kind IN ('image', 'video') AND id % 3 <> 0")
    return proposals.loose_events(some.select("id", F.when(F.col("id") % 37 == 0, 0.0).otherwise(F.coalesce("created_at", "modified_at")).alias("seconds")), 100_000.0, 5)


@query("burst_candidates", 'SELECT id FROM (SELECT id, seconds - lag(seconds) OVER w AS b, lead(seconds) OVER w - seconds AS a FROM signals WINDOW w AS (PARTITION BY "user" ORDER BY seconds, id)) WHERE b <= 1800 OR a <= 1800')
def _(c):
    return T.burst_candidates(c.signals, ["user"], "seconds", 1800).select("id")


def _shots(c):
    v = c.vectors.select("id", "v", "label")
    return v.join(c.signals.select("id", "seconds", "value"), "id")


@query("burst_groups")
def _(c):
    shots = c.signals.select("id", "seconds").join(c.vectors.select("id", "v", "phash", "label"), "id")
    path = F.concat(F.lit("/shots/"), F.when(F.col("id") % 7 == 0, F.col("id") - 1).otherwise(F.col("id")).cast("string"), F.when(F.col("id") % 7 == 0, ".jpg").otherwise(".arw"))
    return T.group_bursts(shots.withColumn("path", path), ["label"], T.BurstLimits(86400.0, 5 * 86400.0, 0.2, -0.1, 24, 24, True))


def _takes_rows(c):
    shots = c.signals.select("id", "seconds").join(c.vectors.select("id", "v", "phash", "label"), "id").join(c.files.select("id", "path", "content_hash", "size_bytes"), "id")
    return shots


@query("take_groups")
def _(c):
    return T.take_groups(_takes_rows(c), ["label"], T.BurstLimits(10 * 86400.0, 30 * 86400.0, 0.1, -0.1, 28, 24, True))


@query("take_suggestions")
def _(c):
    # the request names files 1..400
    rows = _takes_rows(c).withColumn("seconds", F.col("seconds") / 3000)
    return T.suggested_groups(rows.withColumn("v", F.slice("v", 1, 2)), list(range(1, 401)))


@query("burst_representatives", """
WITH p AS (SELECT x.label, x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS s FROM vectors x JOIN vectors y ON x.label = y.label AND x.id < y.id), t AS (SELECT label, a AS id, s FROM p UNION ALL SELECT label, b, s FROM p),
u AS (SELECT label, id, round(sum(s) - CASE WHEN id % 3 = 0 THEN 0.001 ELSE 0 END, 9) AS s FROM t GROUP BY label, id) SELECT label AS "group", id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS r FROM u) WHERE r = 1""")
def _(c):
    return T.representatives(c.vectors.select(F.col("label").alias("group"), "id", (F.col("id") % 3 == 0).alias("raw"), "v"))


_TAKES = """
WITH t AS (SELECT id, "user" AS g, value AS sharp, (id % 17) / 16.0::DOUBLE AS faces FROM signals),
s AS (SELECT id, g, sharp, round(0.0::DOUBLE + 0.6 * CASE WHEN max(sharp) OVER (PARTITION BY g) > 0 THEN sharp / max(sharp) OVER (PARTITION BY g) ELSE 0 END + 0.4 * CASE WHEN max(faces) OVER (PARTITION BY g) > 0 THEN faces / max(faces) OVER (PARTITION BY g) ELSE 0 END - CASE WHEN id % 5 = 0 THEN 0.05 ELSE 0 END, 4) AS total FROM t),
r AS (SELECT id, g, total, row_number() OVER (PARTITION BY g ORDER BY total DESC, sharp DESC, id) AS rank FROM s)
"""


def _takes(c):
    t = c.signals.select("id", F.col("user").alias("g"), F.col("value").alias("sharp"), ((F.col("id") % 17) / 16.0).alias("faces"))
    return T.take_scores(t, "g", {"sharp": 0.6, "faces": 0.4}, F.when(F.col("id") % 5 == 0, 0.05).otherwise(0.0)).select("id", "g", "total", "rank")


@query("take_rank", _TAKES + "SELECT id, g, total, rank FROM r")
def _(c):
    return _takes(c)


# five files are an event, some without a goal; a file may be preferred, stale, or without evidence of the outcome
_TAKES_SQL = """
WITH t AS (SELECT id // 5 AS event, CASE WHEN id // 5 % 7 = 0 THEN '' ELSE 'goal' END AS goal, id AS file_id, id // 5 % 3 = 0 AND id % 4 = 1 AS preferred, id % 50 = 3 AS stale, CASE WHEN id % 60 <> 5 THEN (id * 31 % 100)::DOUBLE / 100 * (1 - id // 5 % 2 * 0.8::DOUBLE) END AS outcome,
  0.64::DOUBLE + (id * 17 % 50)::DOUBLE / 100 AS confidence, quality FROM files),
"""


def _evidence(c):
    i, event = F.col("id"), F.floor(F.col("id") / 5)
    outcome = F.when(i % 60 != 5, (i * 31 % 100).cast("double") / 100 * (1 - event % 2 * F.lit(0.8)))
    return c.files.select(
        event.alias("event"), F.when(event % 7 == 0, "").otherwise("goal").alias("goal"), i.alias("file_id"), ((event % 3 == 0) & (i % 4 == 1)).alias("preferred"), (i % 50 == 3).alias("stale"), outcome.alias("outcome"),
        (F.lit(0.64) + (i * 17 % 50).cast("double") / 100).alias("confidence"), "quality",
    )


@query("take_recommend", _TAKES_SQL + """
g AS (SELECT event, any_value(goal) AS goal, count(*) AS n, list(file_id ORDER BY file_id) FILTER (preferred AND NOT stale) AS liked, bool_and(NOT stale AND outcome IS NOT NULL AND coalesce(confidence, 0) >= 0.65) AS sure, greatest(max(outcome), 0) AS best FROM t GROUP BY event),
l AS (SELECT g.event, list(file_id ORDER BY file_id) AS ids, list(file_id ORDER BY quality DESC, file_id)[1] AS top, count(*) FILTER (quality IS NULL) AS unknown, list_sort(list(quality), 'DESC') AS q FROM g JOIN t ON t.event = g.event AND t.outcome >= g.best - 0.05 GROUP BY g.event),
s AS (SELECT g.event, CASE WHEN goal = '' OR n < 2 THEN {s: 'insufficient', f: []::BIGINT[]} WHEN len(liked) = 1 THEN {s: 'preferred', f: liked} WHEN len(liked) > 1 THEN {s: 'tie', f: liked} WHEN NOT sure OR best < 0.5 THEN {s: 'insufficient', f: []::BIGINT[]}
  WHEN len(ids) = 1 THEN {s: 'ranked', f: ids} WHEN unknown = 0 AND q[1] - q[2] >= 0.1 THEN {s: 'ranked', f: [top]} ELSE {s: 'tie', f: ids} END AS x FROM g LEFT JOIN l ON l.event = g.event)
SELECT event, x.s AS status, array_to_string(x.f, ',') AS file_ids FROM s""")
def _(c):
    return proposals.recommendations(_evidence(c)).select("event", "status", F.array_join(F.col("file_ids").cast("array<string>"), ",").alias("file_ids"))


@query("take_goodness", "SELECT \"user\" AS g, round(0.6 * least(count(*), 12) / 12 + 0.4 * pow(0.5, (max(seconds) - min(seconds)) / 86400 / 14), 6) AS score FROM signals GROUP BY 1")
def _(c):
    g = c.signals.groupBy(F.col("user").alias("g")).agg(F.count(F.lit(1)).alias("n"), ((F.max("seconds") - F.min("seconds")) / 86400).alias("age"))
    return g.select("g", F.round(T.goodness(F.col("n"), F.col("age")), 6).alias("score"))


@query("take_companions", "SELECT stem, count(*) AS n, min(id) AS first_id FROM files WHERE kind IN ('image', 'video') GROUP BY stem HAVING count(*) > 1")
def _(c):
    return c.files.where("kind IN ('image', 'video')").groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("take_relation", """
WITH t AS (SELECT id // 4 AS "group", id, CASE WHEN id // 4 % 3 = 0 THEN coalesce(camera, 'Pixel 8') WHEN id // 4 % 3 = 1 AND camera IS NOT NULL THEN 'Pixel 8' ELSE camera END AS camera, modified_at + id % 7 * 20 AS seconds FROM files),
g AS (SELECT "group", count(camera) = count(*) AS known, count(DISTINCT camera) AS cameras FROM t GROUP BY 1), a AS (SELECT DISTINCT x."group" FROM t x JOIN t y ON x."group" = y."group" AND x.camera <> y.camera AND abs(x.seconds - y.seconds) <= 60)
SELECT g."group", CASE WHEN a."group" IS NOT NULL THEN 'alternateViews' WHEN known AND cameras = 1 THEN 'repeatedAttempts' ELSE 'uncertain' END AS relation,
  CASE WHEN a."group" IS NOT NULL THEN 'simultaneousCameras' WHEN NOT known THEN 'cameraDetailsMissing' WHEN cameras = 1 THEN 'sameCamera' ELSE 'mixedCameras' END AS why FROM g LEFT JOIN a ON a."group" = g."group" """)
def _(c):
    group = F.floor(F.col("id") / 4)
    camera = F.when(group % 3 == 0, F.coalesce("camera", F.lit("Pixel 8"))).when((group % 3 == 1) & F.col("camera").isNotNull(), "Pixel 8").otherwise(F.col("camera"))
    return proposals.relations(c.files.select(group.alias("group"), "id", camera.alias("camera"), (F.col("modified_at") + F.col("id") % 7 * 20).alias("seconds")), "group", 60.0)


def _proposed(c):
    # a shot a minute; the vectors are nearly orthogonal, so little likeness is asked for
    shots = c.files.select("id", "path", "extension", "kind", F.col("modified_at").alias("seconds"), "camera", "content_hash", "size_bytes", "modified_at").join(c.vectors.select("id", "v"), "id")
    named = c.faces.where("excluded = 0").join(c.persons.where("name IS NOT NULL AND is_unknown = 0").select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return shots, named.select("file_id", F.col("person_id").alias("person"))


_LOW = proposals.TakeLimits(600.0, 3600.0, 0.15, 0.05, 120.0)


@query("take_proposals")
def _(c):
    return proposals.take_proposals(*_proposed(c), _LOW, _LOW, gap=600.0, most=200)[0]


@query("take_discovered")
def _(c):
    shots = _proposed(c)[0].join(c.vectors.select("id", "phash"), "id")
    decided = c.files.where("id < 0").select(F.lit("keepAll").alias("decision"), F.array("id").alias("file_ids")).union(c.files.groupBy(F.floor(F.col("id") / 60).alias("g")).agg(F.collect_list("id").alias("f")).where("g % 4 = 1").select(F.when(F.col("g") % 8 == 1, "skip").otherwise("keepAll"), "f"))
    loose = T.BurstLimits(600.0, 3600.0, 0.1, -0.1, 24, 60, True)
    return proposals.discovered_takes(shots, decided, 100, loose, loose)


@query("take_sessions", """
WITH f AS (SELECT files.*, row_number() OVER (PARTITION BY CASE WHEN content_hash IS NOT NULL AND size_bytes BETWEEN 0 AND 16777216 THEN content_hash || size_bytes ELSE files.id::VARCHAR END ORDER BY files.id) AS copy FROM files JOIN vectors ON vectors.id = files.id WHERE kind IN ('image', 'video')),
o AS (SELECT id, CASE kind WHEN 'image' THEN 'photos' ELSE 'videos' END AS media, modified_at AS t FROM f WHERE copy = 1),
n AS (SELECT *, coalesce(t - lag(t) OVER w > 150, true) AS new FROM o WINDOW w AS (PARTITION BY media ORDER BY t, id)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY media ORDER BY t, id) AS s FROM n),
c AS (SELECT *, (row_number() OVER (PARTITION BY media, s ORDER BY t, id) - 1) // 3 AS c FROM s)
SELECT id AS file_id, media || '-' || sha256('related-takes-v1|clip|' || media || '|' || string_agg(id::VARCHAR, ',' ORDER BY id) OVER (PARTITION BY media, s, c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))[:16] AS session FROM c""")
def _(c):
    return proposals.take_proposals(*_proposed(c), gap=150.0, most=3, model="clip")[1].select("file_id", "session")


@query("sess_trimmed_spans", """
WITH r AS (SELECT "user", seconds, row_number() OVER (PARTITION BY "user" ORDER BY seconds) AS r, count(*) OVER (PARTITION BY "user") AS n FROM signals)
SELECT "user", max(n) AS n, round(max(CASE WHEN r = floor((n - 1) * 0.1::DOUBLE) + 1 THEN seconds END), 3) AS first, round(max(CASE WHEN r = floor((n - 1) * 0.9::DOUBLE) + 1 THEN seconds END), 3) AS last FROM r GROUP BY "user"
HAVING max(n) >= 5 AND max(CASE WHEN r = floor((n - 1) * 0.9::DOUBLE) + 1 THEN seconds END) - max(CASE WHEN r = floor((n - 1) * 0.1::DOUBLE) + 1 THEN seconds END) <= 2000000""")
def _(c):
    s = T.trimmed_spans(c.signals, "user", "seconds", most_seconds=2_000_000.0)
    return s.select("user", "n", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"))


@query("sess_median_time", 'SELECT "user", round(list_sort(list(seconds))[count(*) // 2 + 1], 3) AS median FROM signals GROUP BY "user"')
def _(c):
    w = Window.partitionBy("user")
    r = c.signals.select("user", "seconds", F.row_number().over(w.orderBy("seconds")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select("user", F.round("seconds", 3).alias("median"))


@query("sess_unique_event", """
WITH e AS (SELECT "user", min(seconds) AS a, max(seconds) AS b FROM signals WHERE kind = 'signup' GROUP BY "user"), m AS (SELECT s.id, e."user" AS event FROM signals s JOIN e ON s."user" = e."user" AND s.seconds BETWEEN e.a - 10800 AND e.b + 10800 WHERE s.kind = 'view')
SELECT id, min(event) AS event FROM m GROUP BY id HAVING count(*) = 1""")
def _(c):
    e = c.signals.where("kind = 'signup'").groupBy("user").agg(F.min("seconds").alias("a"), F.max("seconds").alias("b"))
    m = c.signals.where("kind = 'view'").join(e, "user").where("seconds BETWEEN a - 10800 AND b + 10800")
    return m.groupBy("id").agg(F.min("user").alias("event"), F.count(F.lit(1)).alias("n")).where("n = 1").select("id", "event")


@query("timeline_adjacent_change", 'SELECT id, round(abs(value - lag(value) OVER (PARTITION BY "user" ORDER BY seconds, id)), 6) AS change FROM signals')
def _(c):
    w = Window.partitionBy("user").orderBy("seconds", "id")
    return c.signals.select("id", F.round(F.abs(F.col("value") - F.lag("value").over(w)), 6).alias("change"))


@query("timeline_sliding", """
WITH w AS (SELECT kind, id, value, unnest([floor(seconds / 21600) * 21600, floor(seconds / 21600) * 21600 - 21600]) AS start, seconds FROM signals)
SELECT kind, start::BIGINT AS start, count(*) AS n, round(max(value), 6) AS peak, arg_max(id, (value, -id)) AS peak_id FROM w WHERE seconds < start + 43200 GROUP BY kind, start""")
def _(c):
    rows = c.signals.withColumn("ts", F.timestamp_seconds(F.col("seconds")))
    w = T.sliding_windows(rows, ["kind"], "12 hours", "6 hours")
    return w.select("kind", F.unix_timestamp("start").alias("start"), "n", F.round("peak", 6).alias("peak"), "peak_id")


_FILES = """
WITH RECURSIVE o AS (SELECT "user", id, seconds - min(seconds) OVER (PARTITION BY "user") AS t, (id * 37 % 101) / 1000.0::DOUBLE AS change FROM signals), d AS (SELECT "user", max(t) + 1.0 AS duration FROM o GROUP BY "user")
"""


def _frames(c):
    """A timeline per user as (user, seconds, change), and its (user, duration)."""
    first = F.min("seconds").over(Window.partitionBy("user"))
    o = c.signals.select("user", "id", (F.col("seconds") - first).alias("seconds"), (F.col("id") * 37 % 101 / 1000.0).alias("change"))
    return o, o.groupBy("user").agg((F.max("seconds") + 1.0).alias("duration"))


@query("timeline_change_samples", _FILES.replace("WITH RECURSIVE", "WITH") + """
, p AS (SELECT o."user", floor(t / 86400)::BIGINT AS w, arg_max(t, (change, -t)) AS peak FROM o JOIN d ON d."user" = o."user" WHERE change >= 0.025 AND t < duration GROUP BY 1, 2),
w AS (SELECT d."user", duration, unnest(range(ceil(duration / 86400)::BIGINT)) AS w FROM d), j AS (SELECT w.*, peak, least(duration, (w.w + 1) * 86400.0::DOUBLE) AS e FROM w LEFT JOIN p ON p."user" = w."user" AND p.w = w.w),
r AS (SELECT "user", (-1)::BIGINT AS w, 0.0::DOUBLE AS last, 0.0::DOUBLE AS pick FROM d UNION ALL
  SELECT j."user", j.w, coalesce(CASE WHEN peak - last >= 40000 THEN peak WHEN e < duration AND e - last >= 40000 THEN e END, last), CASE WHEN peak - last >= 40000 THEN peak WHEN e < duration AND e - last >= 40000 THEN e END FROM r JOIN j ON j."user" = r."user" AND j.w = r.w + 1)
SELECT "user", round(pick, 3) AS seconds FROM r WHERE pick IS NOT NULL""")
def _(c):
    o, d = _frames(c)
    return T.change_samples(o, d, ["user"], 86400.0, spacing=40000.0).select("user", F.round("seconds", 3).alias("seconds"))


_ISLANDS = """
WITH i AS (SELECT "user", seconds AS a, seconds + value * 600 AS b FROM signals), p AS (SELECT *, max(b) OVER (PARTITION BY "user" ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p), m AS (SELECT "user", min(a) AS a, max(b) AS b FROM g GROUP BY "user", g)
"""


def _islands(c):
    return T.merged_intervals(c.signals.select("user", F.col("seconds").alias("start"), (F.col("seconds") + F.col("value") * 600).alias("end")), ["user"])


@query("timeline_islands", _ISLANDS + 'SELECT "user", round(a, 3) AS start, round(b, 3) AS "end" FROM m')
def _(c):
    return _islands(c).select("user", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_WINDOWS = _FILES.replace("WITH RECURSIVE", "WITH") + """
, c AS (SELECT o."user", greatest(b - 1800, 0) AS a, least(t + 1800, duration) AS b FROM (SELECT *, lag(t) OVER (PARTITION BY "user" ORDER BY t) AS b FROM o) o JOIN d ON d."user" = o."user" WHERE b IS NOT NULL AND change >= 0.02),
p AS (SELECT *, max(b) OVER (PARTITION BY "user" ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p),
m AS (SELECT "user", min(a) AS a, max(b) AS b FROM g GROUP BY "user", g), n AS (SELECT *, greatest(ceil((b - a) / 90000), 1)::INTEGER AS n FROM m), x AS (SELECT *, unnest(range(n)) AS i FROM n),
k AS (SELECT "user", a + i * ((b - a) / n) AS a, CASE WHEN i = n - 1 THEN b ELSE a + i * ((b - a) / n) + (b - a) / n END AS b FROM x), f AS (SELECT "user", list(t ORDER BY t) AS f FROM o GROUP BY "user"),
y AS (SELECT k.*, f, list_filter(f, lambda t: t >= a AND t <= b) AS t FROM k JOIN f ON f."user" = k."user"),
z AS (SELECT "user", a, b, CASE WHEN len(t) > 6 THEN list_transform(range(6), lambda q: t[floor(q * ((len(t) - 1) / 5.0::DOUBLE) + 0.5)::INTEGER + 1])
  WHEN len(t) < 2 THEN list_sort(list_distinct(list_concat(t, list_transform(list_sort(list_transform(f, lambda v: {'d': abs(v - a), 'x': v}))[1:2], lambda v: v.x)))) ELSE t END AS t FROM y),
win AS (SELECT "user", least(a, t[1]) AS start, greatest(b, t[len(t)]) AS "end", t AS times FROM z WHERE len(t) >= 2)
"""


def _windows(c):
    o, d = _frames(c)
    return T.activity_windows(o.select("user", "seconds", "change"), d, ["user"], pad=1800.0, gap=3600.0, length=90000.0), d


@query("timeline_activity_frames", _WINDOWS + 'SELECT "user", round(start, 3) AS start, round("end", 3) AS "end", len(times)::BIGINT AS n, round(list_sum(times), 2) AS total, round(times[1], 3) AS first FROM win')
def _(c):
    w, _ = _windows(c)
    total = F.aggregate("times", F.lit(0.0), lambda s, x: s + x)
    return w.select("user", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.size("times").cast("long").alias("n"), F.round(total, 2).alias("total"), F.round(F.get("times", 0), 3).alias("first"))


@query("timeline_still_spans", _WINDOWS + """
, s AS (SELECT "user", greatest(coalesce(max("end") OVER (PARTITION BY "user" ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS f, start AS t FROM win UNION ALL
  SELECT d."user", coalesce(max("end"), 0), max(duration) FROM d LEFT JOIN win ON win."user" = d."user" GROUP BY d."user")
SELECT "user", round(f, 3) AS "from", round(t, 3) AS "to" FROM s WHERE t > f + 0.001""")
def _(c):
    w, d = _windows(c)
    return T.still_spans(w, d, ["user"]).select("user", F.round("from", 3).alias("from"), F.round("to", 3).alias("to"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("timeline_chapters", rf"""
WITH cap AS (SELECT conv, turn, arg_min(text, turn) OVER (PARTITION BY conv, turn // 2) AS text FROM messages), w AS (SELECT conv, turn, list_filter(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')), lambda x: x NOT IN ({_STOP})) AS s FROM cap WHERE trim(text) <> ''),
p AS (SELECT *, lag(s) OVER q AS b, lead(s) OVER q AS a, count(*) OVER (PARTITION BY conv) AS n FROM w WINDOW q AS (PARTITION BY conv ORDER BY turn)),
j AS (SELECT *, coalesce(b IS NOT NULL AND a IS NOT NULL AND coalesce(len(list_intersect(s, b))::DOUBLE / nullif(len(list_distinct(list_concat(s, b))), 0), 0) < 0.12 AND coalesce(len(list_intersect(s, a))::DOUBLE / nullif(len(list_distinct(list_concat(s, a))), 0), 0) >= 0.35, false) AS x FROM p WHERE n >= 3),
k AS (SELECT *, bool_or(x) OVER (PARTITION BY conv) AS has FROM j), s AS (SELECT conv, turn, lead(turn) OVER (PARTITION BY conv ORDER BY turn) AS nxt FROM k WHERE has AND (x OR b IS NULL))
SELECT conv, turn::DOUBLE AS start, round(nxt - 0.001, 3) AS "end" FROM s""")
def _(c):
    # captions that hold for two turns, so that some are unlike the one before and like the one after
    same = F.min_by("text", "turn").over(Window.partitionBy("conv", F.floor(F.col("turn") / 2)))
    captions = c.messages.select("conv", F.col("turn").alias("id"), F.col("turn").cast("double").alias("seconds"), same.alias("text"))
    return T.chapter_starts(captions, ["conv"]).select("conv", "start", F.round("end", 3).alias("end"))


@query("timeline_scene_cuts")
def _(c):
    frames = _shots(c).select((F.col("label") * 1000 + F.floor(F.col("id") / 100)).alias("video"), "id", (F.col("id") % 100 / 2).alias("seconds"), "v")
    durations = frames.select("video").distinct().withColumn("duration", F.lit(51.0))
    return T.scenes(frames, durations, ["video"], T.SceneLimits(cut=0.1, drift=-0.2))


# a turn is ten seconds; its words are heard by every chunk that covers them
@query("timeline_passages", r"""
WITH t AS (SELECT conv, turn, regexp_extract_all(text, '[\p{L}\p{N}]+|[.,!?]') AS ws FROM messages), w AS (SELECT conv, turn * 1000 + i AS id, turn * 10 + i * 0.31::DOUBLE + CASE WHEN i % 17 = 16 THEN 0.9 ELSE 0 END AS s, ws[i + 1] AS text FROM t, unnest(range(least(len(ws), 40))) r(i)),
d AS (SELECT conv, max(turn) * 10.0::DOUBLE + 9 AS length FROM messages GROUP BY conv), o AS (SELECT w.*, least(s + 0.2, length) AS e, length FROM w JOIN d ON d.conv = w.conv WHERE s < length),
c AS (SELECT *, floor((s + (e - s) / 2) / 45)::BIGINT AS chunk FROM o WHERE s + (e - s) / 2 < length), k AS (SELECT *, row_number() OVER (PARTITION BY conv, chunk ORDER BY s, id) AS k FROM c),
z AS (SELECT conv, chunk, k, s AS g0, e, length(text) AS n, 1 AS g FROM k WHERE k = 1 UNION ALL
  SELECT k.conv, k.chunk, k.k, CASE WHEN x THEN k.s ELSE g0 END, k.e, CASE WHEN x THEN length(k.text) ELSE n + length(k.text) END, g + x::INT FROM (SELECT z.*, k.s AS ks, k.e AS ke, k.text AS kt, k.s - z.e > 1.25 OR k.s - g0 > 8 OR n + length(k.text) > 280 AS x FROM z JOIN k ON k.conv = z.conv AND k.chunk = z.chunk AND k.k = z.k + 1) y JOIN k ON k.conv = y.conv AND k.chunk = y.chunk AND k.k = y.k + 1)
SELECT z.conv, z.chunk, round(min(k.s), 6) AS start, round(max(k.e), 6) AS "end", trim(string_agg(CASE WHEN k.text IN ('.', ',', '!', '?') THEN k.text ELSE ' ' || k.text END, '' ORDER BY k.k)) AS text FROM z JOIN k ON k.conv = z.conv AND k.chunk = z.chunk AND k.k = z.k GROUP BY z.conv, z.chunk, g""")
def _(c):
    ws = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[.,!?]"), F.lit(0))
    w = c.messages.select("conv", "turn", F.posexplode(F.slice(ws, 1, 40)).alias("i", "text"))
    at = F.col("turn") * 10 + F.col("i") * F.lit(0.31) + F.when(F.col("i") % 17 == 16, 0.9).otherwise(0.0)
    w = w.select("conv", (F.col("turn") * 1000 + F.col("i")).alias("id"), at.alias("s"), "text")
    chunks = F.filter(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: (F.floor(F.col("s") / 45) + k).cast("long")), lambda k: (k >= 0) & (F.col("s") >= k * 45 - 1.5) & (F.col("s") < k * 45 + 46.5))
    heard = w.withColumn("chunk", F.explode(chunks)).withColumn("timestamp", F.col("s") - F.greatest(F.col("chunk") * 45 - 1.5, F.lit(0.0)))
    lengths = c.messages.groupBy("conv").agg((F.max("turn") * 10.0 + 9).alias("length"))
    out = T.passages(heard.withColumns({"duration": F.lit(0.2), "confidence": F.lit(0.9)}), lengths, ["conv"])
    return out.select("conv", "chunk", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")
