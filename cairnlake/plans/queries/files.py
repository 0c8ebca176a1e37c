"""What a new scan changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.sources import ingest as I
from cairnlake.plans.registry import query

_FOUND = """
WITH found AS (SELECT path, CASE WHEN id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN id % 10 = 0 THEN modified_at + 60 ELSE modified_at END AS modified_at FROM files WHERE id % 9 <> 0)
"""


def _found(c):
    i = F.col("id")
    return c.files.where("id % 9 <> 0").select(
        "path", F.when(i % 6 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(i % 10 == 0, F.col("modified_at") + 60).otherwise(F.col("modified_at")).alias("modified_at")
    )


@query("ingest_kinds", "SELECT lower(extension) AS extension, kind, count(*) AS n FROM all_files GROUP BY 1, 2")
def _(c):
    return c.all_files.groupBy(F.lower("extension").alias("extension"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_skip_set", _FOUND + """
SELECT f.path FROM files f JOIN found ON found.path = f.path WHERE f.size_bytes = found.size_bytes AND abs(f.modified_at - found.modified_at) < 1e-6 AND f.id IN (SELECT id FROM vectors)
UNION SELECT path FROM all_files WHERE failed = 1 AND id % 4 >= 3""")
def _(c):
    gave_up = c.all_files.where("failed = 1").select("path", (F.col("id") % 4).alias("attempts"))
    return I.skip_set(c.files, _found(c), c.vectors, gave_up)


@query("ingest_placeholders", "SELECT id FROM all_files WHERE id % 13 = 0 AND kind IN ('image', 'video', 'pdf')")
def _(c):
    return I.placeholders(c.all_files.withColumn("content_hash", F.when(F.col("id") % 13 != 0, F.col("content_hash")))).select("id")


@query("ingest_moved", """
WITH gone AS (SELECT * FROM files WHERE id % 9 = 0), new AS (SELECT path, content_hash, size_bytes, modified_at FROM files WHERE id % 9 <> 0), p AS (SELECT gone.id, new.path AS new_path, abs(gone.modified_at - new.modified_at) AS d FROM gone JOIN new ON gone.content_hash = new.content_hash AND gone.size_bytes = new.size_bytes),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, new_path) AS r, row_number() OVER (PARTITION BY new_path ORDER BY d, id) AS q FROM p) SELECT id AS old_id, new_path FROM r WHERE r = 1 AND q = 1""")
def _(c):
    return I.moved(c.files.where("id % 9 = 0"), c.files.where("id % 9 <> 0"))


@query("ingest_upsert", """
WITH o AS (SELECT id, size_bytes, description, quality FROM files WHERE id % 3 <> 0), n AS (SELECT id, size_bytes * 2 AS size_bytes, CASE WHEN id % 2 = 0 THEN 'new' END AS description, 0.5::DOUBLE AS quality, id % 4 = 0 AS ran FROM files WHERE id % 5 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.size_bytes ELSE o.size_bytes END AS size_bytes, CASE WHEN n.id IS NOT NULL THEN coalesce(n.description, o.description) ELSE o.description END AS description,
  CASE WHEN n.id IS NOT NULL THEN CASE WHEN n.ran THEN n.quality ELSE o.quality END ELSE o.quality END AS quality FROM o FULL JOIN n ON o.id = n.id""")
def _(c):
    columns = ("id", "size_bytes", "description", "quality")
    old = c.files.where("id % 3 <> 0").select(*columns)
    new = c.files.where("id % 5 = 0").select("id", (F.col("size_bytes") * 2).alias("size_bytes"), F.when(F.col("id") % 2 == 0, "new").alias("description"), F.lit(0.5).alias("quality"), (F.col("id") % 4 == 0).alias("ran"))
    return I.upsert(old, I.with_presence(new), "id", ["description"], F.col("n.ran"), ("quality",))


@query("ingest_twin_copy", """
WITH d AS (SELECT content_hash, id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS hv FROM files WHERE trim(coalesce(description, '')) <> ''), b AS (SELECT content_hash, id, row_number() OVER (PARTITION BY content_hash ORDER BY hv DESC, id) AS r FROM d)
SELECT f.id, b.id AS donor FROM files f JOIN b ON b.content_hash = f.content_hash AND r = 1 WHERE trim(coalesce(f.description, '')) = ''""")
def _(c):
    return I.twin_copy(c.files, c.files.withColumn("has_vector", F.when(F.col("id") % 2 == 0, 1).otherwise(0)))


@query("ingest_soft_hide", _FOUND + "SELECT id FROM files WHERE starts_with(path, '/lib/src1/') AND path NOT IN (SELECT path FROM found)")
def _(c):
    return I.soft_hide(c.files, _found(c), "/lib/src1")


@query("ingest_purge", "SELECT id FROM all_files WHERE failed = 1 AND 1706800000 - modified_at > 30 * 86400 AND modified_at <= 1706800000")
def _(c):
    return I.purge(c.all_files, 1706800000.0)


@query("ingest_exclusion_purge", "SELECT id FROM all_files WHERE starts_with(path, '/lib/src7/') OR starts_with(path, '/lib/src8/de/')")
def _(c):
    p = F.col("path")
    return c.all_files.where(((p >= "/lib/src7/") & (p < "/lib/src70")) | ((p >= "/lib/src8/de/") & (p < "/lib/src8/de0"))).select("id")


@query("ingest_backlog_batch", "SELECT id FROM faces WHERE id % 4 < 3 ORDER BY id LIMIT 50")
def _(c):
    return I.backlog(c.faces.withColumn("version", F.col("id") % 4), 3, 50)


@query("ingest_backlog_seed", """
WITH b AS (SELECT id AS face_id, CASE WHEN id % 6 = 0 THEN 'old' ELSE 'now' END AS model, 'v1' AS processing, (['pending', 'missing', 'offline', 'failed', 'done', 'done'])[(id % 7 % 6 + 1)::INTEGER] AS state, (id % 3)::INTEGER AS attempts, CASE WHEN id % 7 = 3 THEN 'unreadable' END AS reason FROM faces WHERE id % 2 = 0),
o AS (SELECT id AS face_id FROM faces WHERE id % 5 < 3)
SELECT face_id, model, processing, CASE WHEN model = 'now' AND (state IN ('missing', 'offline', 'failed') OR state = 'done' AND face_id IN (SELECT face_id FROM o)) THEN 'pending' ELSE state END AS state, attempts, reason FROM b
UNION ALL SELECT face_id, 'now', 'v1', 'pending', 0, NULL FROM o WHERE face_id NOT IN (SELECT face_id FROM b WHERE model = 'now')""")
def _(c):
    i = F.col("id")
    states = F.array(*[F.lit(x) for x in ("pending", "missing", "offline", "failed", "done", "done")])
    b = c.faces.where(i % 2 == 0).select(
        i.alias("face_id"), F.when(i % 6 == 0, "old").otherwise("now").alias("model"), F.lit("v1").alias("processing"), F.get(states, (i % 7 % 6).cast("int")).alias("state"), (i % 3).cast("int").alias("attempts"), F.when(i % 7 == 3, "unreadable").alias("reason"),
    )
    return I.seeded_backlog(b, c.faces.where(i % 5 < 3).select(i.alias("face_id")), "now", "v1")


@query("ingest_snapshot_restore", "SELECT file_id, tag, source FROM tags")
def _(c):
    kept = I.snapshot({"tags": c.tags}, "file_id", 12)
    return I.restore(kept, "tags", c.tags.where("file_id <> 12"), ["file_id", "tag", "source"]).select("file_id", "tag", "source")


@query("ingest_owed_stages", "SELECT count(*) FILTER (m % 2 = 1) AS tags, count(*) FILTER ((m // 2) % 2 = 1) AS text, count(*) FILTER ((m // 4) % 2 = 1) AS scan_text FROM (SELECT id % 8 AS m FROM files)")
def _(c):
    m = F.col("id") % 8
    return c.files.agg(*[F.count_if(I.owed(m, s)).alias(s) for s in I.STAGES])


@query("ingest_zero_bytes", "SELECT id, path, 1 AS failed FROM all_files WHERE size_bytes - size_bytes % 500 = 0")
def _(c):
    return I.zero_bytes(c.all_files.withColumn("size_bytes", F.col("size_bytes") - F.col("size_bytes") % 500))


@query("ingest_content_hash", "SELECT id, content_hash FROM all_files")
def _(c):
    return c.all_files.select("id", "content_hash")


@query("ingest_orphans", "SELECT DISTINCT file_id FROM tags WHERE file_id NOT IN (SELECT id FROM files)")
def _(c):
    return c.tags.select("file_id").distinct().join(c.files.select(F.col("id").alias("file_id")), "file_id", "left_anti")


@query("ingest_pending_model", "SELECT count(*) FILTER (camera IS NULL OR camera <> 'Canon EOS R5') AS pending FROM files")
def _(c):
    return c.files.agg(F.count_if(F.col("camera").isNull() | (F.col("camera") != "Canon EOS R5")).alias("pending"))
