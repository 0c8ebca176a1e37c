"""Counts, filters, listings, windows and set operations over files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions import text as X
from cairnlake.operators import facts, filters
from cairnlake.operators.filters import Filter, moment, taken
from cairnlake.plans.registry import query

_TAKEN = "coalesce(created_at, modified_at)"
_MONTH = f"strftime(to_timestamp({_TAKEN}) AT TIME ZONE 'UTC', '%Y-%m')"


@query("facts_totals", "SELECT count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM files WHERE kind IN ('image', 'video') AND size_bytes > 500")
def _(c):
    return facts.totals(Filter(kinds=("image", "video"), above_bytes=500).apply(c.files))


@query("facts_by_kind", "SELECT kind, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY kind")
def _(c):
    return facts.counts_by(c.files, F.col("kind"), "kind")


@query("facts_by_format", "SELECT coalesce(nullif(lower(extension), ''), 'none') AS format, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1")
def _(c):
    return facts.counts_by(c.files, F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("none")), "format")


@query("facts_by_year", f"SELECT strftime(to_timestamp({_TAKEN}) AT TIME ZONE 'UTC', '%Y') AS period, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1")
def _(c):
    return facts.by_period(c.files, "yyyy")


@query("facts_by_month", f"SELECT {_MONTH} AS period, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1 ORDER BY 1 DESC NULLS LAST LIMIT 24")
def _(c):
    return facts.by_period(c.files, "yyyy-MM").orderBy(F.col("period").desc_nulls_last()).limit(24)


@query("facts_folders", """
WITH g AS (SELECT folder, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY folder),
p AS (SELECT folder, list_filter(string_split(folder, '/'), lambda x: x <> '') AS parts FROM g),
l AS (SELECT folder, depth, array_to_string(parts[len(parts) - depth + 1:], '/') AS label FROM (SELECT folder, parts, unnest(range(least(2, len(parts)), least(7, len(parts)) + 1)) AS depth FROM p)),
u AS (SELECT depth, label, min(folder) AS folder FROM l GROUP BY depth, label HAVING count(*) = 1),
b AS (SELECT folder, arg_min(label, depth) AS label FROM u GROUP BY folder)
SELECT g.folder, coalesce(label, g.folder) AS label, n, bytes FROM g LEFT JOIN b ON b.folder = g.folder""")
def _(c):
    return facts.folder_totals(c.files)


@query("facts_date_range", f"SELECT strftime(to_timestamp(min({_TAKEN})) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_day, strftime(to_timestamp(max({_TAKEN})) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_day FROM files")
def _(c):
    return facts.capture_range(c.files)


@query("facts_overview", """
SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(size_bytes)::BIGINT FROM files) AS bytes, (SELECT count(DISTINCT folder) FROM files) AS folders,
  (SELECT count(DISTINCT kind) FROM files) AS kinds""")
def _(c):
    return facts.overview(c.files)


@query("facts_counters", """
SELECT count(*) FILTER (failed = 0) AS visible, count(*) FILTER (failed = 1) AS failed, count(*) FILTER (failed = 0 AND kind = 'other') AS other,
  count(*) FILTER (description IS NULL) AS pending, count(*) FILTER (description IS NOT NULL AND trim(description) <> '') AS captioned FROM all_files""")
def _(c):
    return c.all_files.agg(
        F.count_if(F.col("failed") == 0).alias("visible"), F.count_if(F.col("failed") == 1).alias("failed"),
        F.count_if((F.col("failed") == 0) & (F.col("kind") == "other")).alias("other"), F.count_if(F.col("description").isNull()).alias("pending"),
        F.count_if(F.col("description").isNotNull() & (F.trim("description") != "")).alias("captioned"),
    )


@query("facts_size_percentile", """
SELECT size_bytes AS value FROM (SELECT size_bytes, row_number() OVER (ORDER BY size_bytes) AS r, count(*) OVER () AS n FROM files) WHERE r = round((n - 1) * 0.95::DOUBLE)::BIGINT + 1""")
def _(c):
    return facts.rank_percentile(c.files, "size_bytes", 0.95)


for _order, _sql in (
    ("newest", f"{_TAKEN} DESC NULLS LAST, id"), ("oldest", f"{_TAKEN} ASC NULLS LAST, id"), ("largest", "size_bytes DESC, id"), ("smallest", "size_bytes, id"),
):
    query(f"list_{_order}", f"SELECT id, path, size_bytes FROM files ORDER BY {_sql} LIMIT 50")(lambda c, o=_order: facts.listing(c.files, o, 50).select("id", "path", "size_bytes"))


@query("list_offset_page", f"SELECT id, path FROM files ORDER BY {_TAKEN} DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def _(c):
    return facts.listing(c.files, "newest", 20, 40).select("id", "path")


@query("list_keyset_page", "SELECT id, path FROM files WHERE id > 300 ORDER BY id LIMIT 40")
def _(c):
    return facts.keyset_page(c.files, 300, 40).select("id", "path")


@query("list_nulls_last", "SELECT id, created_at, row_number() OVER (ORDER BY created_at ASC NULLS LAST, id) - 1 AS rank FROM files")
def _(c):
    return facts.in_order(c.files.select("id", "created_at"), F.col("created_at").asc_nulls_last(), F.col("id").asc())


@query("facts_by_kind_under_root", "SELECT kind, count(*) AS n FROM files WHERE path >= '/lib/src1/' AND path < '/lib/src10' GROUP BY kind")
def _(c):
    # The half-open range of a root's paths
    return c.files.where("path >= '/lib/src1/' AND path < '/lib/src10'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("names_pending", """
SELECT id, path, 'name ' || id AS proposed FROM files WHERE id % 5 NOT IN (0, 1) ORDER BY modified_at + id * 31 % 1000 * 600 DESC, id LIMIT 40""")
def _(c):
    i = F.col("id")
    proposed = F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 5 == 1, "").otherwise(F.concat(F.lit("name "), i.cast("string")))
    return facts.pending_names(c.files.select("id", "path", proposed.alias("proposed"), (F.col("modified_at") + i * 31 % 1000 * 600).alias("analysed_at")), 40)


@query("timeline_tracks", """
WITH e AS (SELECT "user" AS file_id, CASE WHEN id % 5 = 0 THEN 'speech:' ELSE 'f' END || id AS id, kind, seconds AS s, CASE WHEN id % 3 > 0 THEN seconds + value END AS e FROM signals),
t AS (SELECT file_id, 'examined' AS track, s, e FROM e WHERE kind IN ('view', 'click') AND NOT starts_with(id, 'speech:') UNION ALL SELECT file_id, 'speech', s, coalesce(e, s) FROM e WHERE kind <> 'error' AND starts_with(id, 'speech:')),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, track ORDER BY s, e NULLS FIRST) AS r FROM t) SELECT file_id, track, round(s, 3) AS start, round(e, 3) AS "end" FROM r WHERE r <= 8""")
def _(c):
    i = F.col("id")
    e = c.signals.select(
        F.col("user").alias("file_id"), F.concat(F.when(i % 5 == 0, "speech:").otherwise("f"), i.cast("string")).alias("id"), F.when(F.col("kind") == "view", "sampled").when(F.col("kind") == "click", "verified").otherwise("owed").alias("status"),
        (F.col("kind") == "error").alias("stale"), F.col("seconds").alias("start"), F.when(i % 3 > 0, F.col("seconds") + F.col("value")).alias("end"),
    )
    return facts.timeline_tracks(e, e, 8).select("file_id", "track", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_ACTIVE = """
WITH a AS (SELECT * FROM faces WHERE excluded = 0 AND person_id IS NOT NULL AND file_id IN (SELECT id FROM files)), p AS (SELECT id, name, is_unknown, id * 10 + CASE WHEN id % 2 = 0 THEN id ELSE 1 END AS pick FROM persons),
l AS (SELECT p.id, p.name, count(DISTINCT a.file_id) AS files, count(*) AS faces, coalesce(max(CASE WHEN a.id = pick THEN pick END), arg_max(a.id, ({0}, -a.id))) AS anchor FROM p JOIN a ON a.person_id = p.id {1} GROUP BY p.id, p.name)
"""


def _people(c, best):
    pick = F.col("id") * 10 + F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(1)
    persons = c.persons.withColumn("pick", pick)
    return facts.people_list(persons.where("is_unknown = 0") if best == "quality" else persons, facts.active_faces(c.faces.where("person_id IS NOT NULL"), c.files), best)


@query("people_list_best", _ACTIVE.format("coalesce(quality, 0)", "WHERE is_unknown = 0") + "SELECT id, coalesce(name, 'Person ' || id) AS name, faces, anchor FROM l ORDER BY faces DESC, id")
def _(c):
    p = _people(c, "quality")
    return p.select("id", F.coalesce("name", F.concat(F.lit("Person "), F.col("id").cast("string"))).alias("name"), "faces", "anchor").orderBy(F.col("faces").desc(), "id")


@query("people_list_lowest", _ACTIVE.format("0", "") + "SELECT id, name, files, anchor FROM l ORDER BY CASE WHEN trim(coalesce(name, '')) = '' THEN 1 ELSE 0 END, files DESC, id")
def _(c):
    unnamed = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", 1).otherwise(0)
    return _people(c, "lowest").orderBy(unnamed, F.col("files").desc(), "id").select("id", "name", "files", "anchor")


@query("people_faces_of", "SELECT f.id AS face, file_id, path FROM faces f JOIN files ON files.id = file_id WHERE person_id = 3 AND excluded = 0 ORDER BY modified_at DESC, f.id LIMIT 500")
def _(c):
    return facts.faces_of(3, c.faces, c.files)


_PAGE = "greatest(w, h)::DOUBLE / least(w, h)"


@query("text_bearing", f"""
WITH g AS (SELECT file_id, list(tag) AS tags FROM (SELECT DISTINCT file_id, CASE tag WHEN 'view' THEN 'Sticky_Note ' WHEN 'error' THEN 'Receipt' ELSE tag END AS tag FROM tags) GROUP BY file_id),
s AS (SELECT id, camera, 600 + id % 60 AS w, 850 + id % 7 AS h FROM files)
SELECT id, coalesce(len(list_intersect(tags, ['Sticky_Note ', 'Receipt'])) > 0, false) AS bearing, camera IS NULL AND (abs({_PAGE} - 11.0::DOUBLE / 8.5) < 0.015 OR abs({_PAGE} - sqrt(2)) < 0.015) AS page FROM s LEFT JOIN g ON g.file_id = s.id""")
def _(c):
    tag = F.when(F.col("tag") == "view", "Sticky_Note ").when(F.col("tag") == "error", "Receipt").otherwise(F.col("tag"))
    g = c.tags.groupBy(F.col("file_id").alias("id")).agg(F.collect_set(tag).alias("tags"))
    page = X.document_shape(600 + F.col("id") % 60, 850 + F.col("id") % 7, F.col("camera").isNotNull())
    return c.files.join(g, "id", "left").select("id", F.coalesce(X.text_bearing(F.col("tags")), F.lit(False)).alias("bearing"), page.alias("page"))


@query("rows_by_id_list", "WITH w AS (SELECT unnest([30, 7, 500, 12]) AS id, unnest([0, 1, 2, 3]) AS pos) SELECT files.id, path, pos FROM w JOIN files ON files.id = w.id")
def _(c):
    ids = c.spark.createDataFrame([(30, 0), (7, 1), (500, 2), (12, 3)], "id long, pos int")
    return F.broadcast(ids).join(c.files, "id").select("id", "path", "pos")


@query("filter_kind_ext", "SELECT id FROM files WHERE kind IN ('image', 'doc') AND lower(extension) IN ('jpg', 'txt')")
def _(c):
    return Filter(kinds=("image", "doc"), extensions=("JPG", "txt")).apply(c.files).select("id")


@query("filter_bytes", "SELECT id, size_bytes FROM files WHERE size_bytes > 200 AND size_bytes < 3000")
def _(c):
    return Filter(above_bytes=200, below_bytes=3000).apply(c.files).select("id", "size_bytes")


@query("filter_any_people", "SELECT id FROM files WHERE id IN (SELECT file_id FROM faces WHERE person_id IN (2, 5))")
def _(c):
    return Filter(any_people=(2, 5)).apply(c.files, c.faces).select("id")


@query("filter_all_people", "SELECT id FROM files WHERE id IN (SELECT file_id FROM faces WHERE person_id = 2) AND id IN (SELECT file_id FROM faces WHERE person_id = 5)")
def _(c):
    return Filter(all_people=(2, 5)).apply(c.files, c.faces).select("id")


@query("filter_excluded_people", "SELECT id FROM files WHERE id NOT IN (SELECT file_id FROM faces WHERE person_id IN (1, 3))")
def _(c):
    return Filter(no_people=(1, 3)).apply(c.files, c.faces).select("id")


@query("filter_date_window", f"SELECT id FROM files WHERE {_TAKEN} >= 1680307200 AND {_TAKEN} < 1688169600")
def _(c):
    return Filter(start=1680307200.0, end=1688169600.0).apply(c.files).select("id")


@query("filter_months", f"SELECT id FROM files WHERE month(to_timestamp({_TAKEN}) AT TIME ZONE 'UTC') IN (12, 1, 2)")
def _(c):
    return Filter(months=(12, 1, 2)).apply(c.files).select("id")


@query("filter_folder", "SELECT id FROM files WHERE contains(lower(path), '/src3/') OR starts_with(path, 'src3')")
def _(c):
    return Filter(folder="src3").apply(c.files).select("id")


@query("filter_undescribed", "SELECT id FROM files WHERE kind IN ('image', 'video', 'pdf', 'doc', 'audio') AND coalesce(trim(description), '') = ''")
def _(c):
    return Filter(undescribed=True).apply(c.files).select("id")


@query("filter_prefix_range", "SELECT id FROM files WHERE path >= '/lib/src1/' AND path < '/lib/src10'")
def _(c):
    return Filter(root="/lib/src1").apply(c.files).select("id")


@query("filter_root_owner", "SELECT id FROM files WHERE starts_with(path, '/lib/src2/') AND NOT starts_with(path, '/lib/src2/en/')")
def _(c):
    return filters.owned_by_root(c.files, "/lib/src2", ["/lib", "/lib/src2", "/lib/src2/en", "/lib/src5"]).select("id")


@query("filter_subtree_nocase", "SELECT id FROM files WHERE starts_with(lower(path), '/lib/src4/')")
def _(c):
    return c.files.where(filters.under(F.lower("path"), "/lib/src4")).select("id")


@query("semi_union_ids", "SELECT id FROM files WHERE id IN (SELECT file_id FROM faces WHERE excluded = 0 UNION SELECT file_id FROM tags WHERE tag = 'error')")
def _(c):
    seen = c.faces.where("excluded = 0").select("file_id").union(c.tags.where("tag = 'error'").select("file_id")).distinct()
    return c.files.join(seen, F.col("id") == F.col("file_id"), "left_semi").select("id")


@query("set_and_or_words", """
SELECT id FROM files WHERE (contains(lower(text), 'the') AND contains(lower(text), 'license')) OR (contains(lower(text), 'der') AND contains(lower(text), 'ung'))""")
def _(c):
    t = F.lower("text")
    word = lambda w: c.texts.where(t.contains(w)).select("id")
    return word("the").join(word("license"), "id", "left_semi").union(word("der").join(word("ung"), "id", "left_semi")).distinct()


@query("set_subset", """
WITH t AS (SELECT file_id, list(DISTINCT tag) AS g FROM tags GROUP BY file_id) SELECT file_id FROM t WHERE len(list_filter(g, lambda x: x NOT IN ('view', 'click', 'purchase'))) = 0""")
def _(c):
    g = c.tags.groupBy("file_id").agg(F.collect_set("tag").alias("g"))
    return g.where(F.size(F.array_except("g", F.array(F.lit("view"), F.lit("click"), F.lit("purchase")))) == 0).select("file_id")


@query("set_disjoint_people", """
WITH p AS (SELECT DISTINCT person_id, file_id FROM faces WHERE person_id IS NOT NULL)
SELECT a.person_id AS a, b.person_id AS b FROM (SELECT DISTINCT person_id FROM p) a, (SELECT DISTINCT person_id FROM p) b
WHERE a.person_id < b.person_id AND NOT EXISTS (SELECT 1 FROM p x JOIN p y ON x.file_id = y.file_id WHERE x.person_id = a.person_id AND y.person_id = b.person_id)""")
def _(c):
    p = c.faces.where("person_id IS NOT NULL").select("person_id", "file_id").distinct()
    ids = p.select("person_id").distinct()
    pairs = ids.select(F.col("person_id").alias("a")).join(ids.select(F.col("person_id").alias("b")), F.col("a") < F.col("b"))
    met = p.select(F.col("person_id").alias("a"), "file_id").join(p.select(F.col("person_id").alias("b"), "file_id"), "file_id").where("a < b").select("a", "b").distinct()
    return pairs.join(met, ["a", "b"], "left_anti")


_KEEPER = "coalesce(quality, 0) DESC, size_bytes DESC, coalesce(created_at, 1e308) ASC, length(path) ASC, path, id"


def keeper_window(keys=("content_hash", "size_bytes")):
    return Window.partitionBy(*keys).orderBy(
        F.coalesce("quality", F.lit(0.0)).desc(), F.col("size_bytes").desc(), F.coalesce("created_at", F.lit(1e308)).asc(), F.length("path"), "path", "id"
    )


@query("win_twin_count", "SELECT id, count(*) OVER (PARTITION BY content_hash, size_bytes) - 1 AS twins FROM files")
def _(c):
    return c.files.select("id", (F.count(F.lit(1)).over(Window.partitionBy("content_hash", "size_bytes")) - 1).alias("twins"))


@query("win_member_rank", "SELECT id, r FROM (SELECT id, row_number() OVER (PARTITION BY kind ORDER BY size_bytes DESC, id) AS r FROM files) WHERE r <= 5")
def _(c):
    r = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("size_bytes").desc(), "id"))
    return c.files.select("id", r.cast("long").alias("r")).where("r <= 5")


@query("win_top_tags", """
WITH t AS (SELECT file_id, trim(CASE tag WHEN 'view' THEN ' View ' WHEN 'click' THEN upper(tag) ELSE tag END) AS tag, CASE source WHEN 'clip' THEN CASE WHEN file_id % 3 = 0 THEN 'clip' ELSE 'auto' END ELSE source END AS source, score FROM tags UNION ALL SELECT file_id, lower(tag), source, score FROM tags WHERE source = 'vlm'),
k AS (SELECT *, CASE source WHEN 'user' THEN 0 WHEN 'vlm' THEN 1 ELSE 2 END AS pri FROM t WHERE source IN ('auto', 'user', 'vlm') AND tag <> '' AND lower(tag) NOT IN ('image', 'photo', 'picture', 'photography', 'shot', 'view', 'object', 'item', 'background', 'foreground', 'indoor', 'outdoor')),
one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY file_id, lower(tag) ORDER BY pri, coalesce(score, 0) DESC, tag) = 1)
SELECT file_id, tag, row_number() OVER (PARTITION BY file_id ORDER BY pri, coalesce(score, 0) DESC, tag) AS r FROM one QUALIFY r <= 2""")
def _(c):
    tag = F.when(F.col("tag") == "view", " View ").when(F.col("tag") == "click", F.upper("tag")).otherwise(F.col("tag"))
    source = F.when(F.col("source") != "clip", F.col("source")).when(F.col("file_id") % 3 == 0, "clip").otherwise("auto")
    more = c.tags.where("source = 'vlm'").select("file_id", F.lower("tag").alias("tag"), "source", "score")
    return facts.display_tags(c.tags.select("file_id", tag.alias("tag"), source.alias("source"), "score").union(more), 2)


@query("chat_last_n", "SELECT conv, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS r FROM messages WHERE role = 'user') WHERE r <= 4")
def _(c):
    r = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").desc()))
    return c.messages.where("role = 'user'").withColumn("r", r).where("r <= 4").select("conv", "turn", "role")


@query("tags_of_files", "SELECT file_id, array_to_string(list(tag ORDER BY tag), ',') AS tags FROM (SELECT DISTINCT file_id, tag FROM tags) GROUP BY file_id")
def _(c):
    return c.tags.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("tags_max_score", "SELECT tag, round(max(score), 6) AS score, count(DISTINCT file_id) AS files FROM tags GROUP BY tag ORDER BY score DESC, tag LIMIT 24")
def _(c):
    return c.tags.groupBy("tag").agg(F.round(F.max("score"), 6).alias("score"), F.countDistinct("file_id").alias("files")).orderBy(F.col("score").desc(), "tag").limit(24)


@query("tag_vocabulary", """
WITH w AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM files)
SELECT term, count(*) AS n FROM w WHERE length(term) >= 3 GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 256""")
def _(c):
    w = c.texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term")).where("length(term) >= 3")
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.col("n").desc(), "term").limit(256)


@query("text_word_forms", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM files)
SELECT w, CASE WHEN length(w) >= 4 AND NOT ends_with(w, 'ss') THEN CASE WHEN ends_with(w, 'ies') THEN w || ',' || w[:-4] || 'y' WHEN ends_with(w, 'es') THEN w || ',' || w[:-3] || ',' || w[:-2]
  WHEN ends_with(w, 's') THEN w || ',' || w[:-2] ELSE w END ELSE w END AS forms FROM w""")
def _(c):
    w = c.texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", F.array_join(X.word_forms(F.col("w")), ",").alias("forms"))


@query("text_light_stem", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM files)
SELECT w, CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN w[:-4] WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END AS stem FROM w""")
def _(c):
    w = c.texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", X.light_stem(F.col("w")).alias("stem"))


@query("text_path_parts", r"""
SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM files""")
def _(c):
    p = F.col("path")
    return c.files.select("id", X.folder_of(p).alias("folder"), X.base_name(p).alias("base"), X.stem_of(p).alias("stem"))


@query("text_size_labels", """
WITH z AS (SELECT id, size_bytes * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 999 WHEN 2 THEN 1000003 ELSE 1000000007 END AS s FROM files)
SELECT id, CASE WHEN s = 1 THEN '1 byte' WHEN s < 1000 THEN s || ' bytes' WHEN floor(s * 10 / 1e3 + 0.5) < 10000 THEN format('{:.1f} KB', floor(s * 10 / 1e3 + 0.5) / 10) WHEN floor(s * 10 / 1e6 + 0.5) < 10000 THEN format('{:.1f} MB', floor(s * 10 / 1e6 + 0.5) / 10)
  WHEN floor(s * 10 / 1e9 + 0.5) < 10000 THEN format('{:.1f} GB', floor(s * 10 / 1e9 + 0.5) / 10) ELSE format('{:.1f} TB', floor(s * 10 / 1e12 + 0.5) / 10) END AS label FROM z""")
def _(c):
    scale = F.element_at(F.array(F.lit(1), F.lit(999), F.lit(1000003), F.lit(1000000007)), (F.col("id") % 4 + 1).cast("int"))
    return c.files.select("id", X.size_label(F.col("size_bytes") * scale).alias("label"))


@query("text_html_visible", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?</script\s*>', ' ', 'gsi'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gsi'), '<head\b[^>]*>.*?</head\s*>', ' ', 'gsi') AS x FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM a)
SELECT page_id, trim(regexp_replace(x, '[ \t\n\r\f]+', ' ', 'g')) AS text FROM b""")
def _(c):
    return c.pages.select("page_id", "text")


@query("text_jaccard", """
WITH w AS (SELECT conv, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM messages),
p AS (SELECT conv, turn, s, lag(s) OVER (PARTITION BY conv ORDER BY turn) AS b FROM w)
SELECT conv, turn, CASE WHEN len(list_distinct(list_concat(s, b))) > 0 THEN round(len(list_intersect(s, b))::DOUBLE / len(list_distinct(list_concat(s, b))), 6) ELSE 0 END AS likeness FROM p WHERE b IS NOT NULL""")
def _(c):
    s = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    w = c.messages.select("conv", "turn", s.alias("s")).withColumn("b", F.lag("s").over(Window.partitionBy("conv").orderBy("turn")))
    return w.where("b IS NOT NULL").select("conv", "turn", F.round(X.jaccard(F.col("s"), F.col("b")), 6).alias("likeness"))


@query("text_keyphrases")
def _(c):
    return X.phrases_and_names(c.texts).select("id", F.array_join("phrases", "; ").alias("phrases"), "name")


@query("text_garbled_share")
def _(c):
    return c.texts.select("id", F.round(X.garbled_share(F.col("text")), 6).alias("share"))


@query("text_title", r"""
WITH t AS (SELECT id, CASE id % 9 WHEN 0 THEN '...' WHEN 1 THEN '?! ' || text WHEN 2 THEN '  .' || text WHEN 3 THEN repeat('x', 90 + id % 3) ELSE text END AS text FROM files),
p AS (SELECT id, text, list_filter(string_split_regex(text, '[.!?\n]'), lambda x: x <> '')[1] AS piece FROM t), f AS (SELECT id, trim(coalesce(piece, text), E' \t\r\n') AS f FROM p),
w AS (SELECT id, f, substr(f, 1, 88) AS s, list_filter(range(1, 89), lambda i: substr(f, i, 1) IN (' ', E'\t', E'\r'))[-1] AS cut FROM f)
SELECT id, CASE WHEN length(f) <= 88 THEN f WHEN cut IS NULL THEN s || '…' ELSE substr(s, 1, cut - 1) || '…' END AS title FROM w""")
def _(c):
    i = F.col("id")
    text = F.when(i % 9 == 0, "...").when(i % 9 == 1, F.concat(F.lit("?! "), "text")).when(i % 9 == 2, F.concat(F.lit("  ."), "text")).when(i % 9 == 3, F.repeat(F.lit("x"), (90 + i % 3).cast("int"))).otherwise(F.col("text"))
    return c.texts.select("id", X.title_of(text).alias("title"))



@query("fn_year_month", f"SELECT id, CASE WHEN {_TAKEN} > 0 THEN {_MONTH} END AS month FROM files")
def _(c):
    return c.files.select("id", F.when(taken() > 0, F.date_format(moment(taken()), "yyyy-MM")).alias("month"))


@query("fn_gps_bucket", "SELECT id, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN round(lat * 2) / 2 END AS lat, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN round(lon * 2) / 2 END AS lon FROM files WHERE lat IS NOT NULL")
def _(c):
    ok = (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    half = lambda x: F.when(ok, F.round(F.col(x) * 2) / 2).alias(x)
    return c.files.where("lat IS NOT NULL").select("id", half("lat"), half("lon"))


@query("fn_camera_tags", f"""
WITH c AS (SELECT id, CASE WHEN id % 40 = 1 THEN 0 WHEN id % 40 = 2 THEN 631000000 ELSE created_at END AS created_at, CASE WHEN id % 40 = 3 THEN 0 ELSE modified_at END AS modified_at,
  ([camera, 'SONY ILCE-7', 'Google Pixel 8', 'iPad Pro', 'FUJIFILM X-T5', 'Leica Q', 'GoPro HERO', 'samsung SM', 'Kodak', camera])[(id % 10 + 1)::INTEGER] AS camera FROM files),
y AS (SELECT id, camera, CASE WHEN created_at > 0 THEN created_at ELSE modified_at END AS t FROM c), x AS (SELECT id, CASE WHEN t > 0 THEN year(make_timestamp((t * 1e6)::BIGINT)) END AS y, lower(camera) AS low FROM y),
f AS (SELECT id, y, list_filter(['iPhone', 'iPad', 'Canon', 'Nikon', 'Sony', 'Fuji', 'Leica', 'GoPro', 'Samsung', 'Pixel'], lambda n: contains(low, lower(n)))[1] AS family FROM x)
SELECT id, concat_ws(',', CASE WHEN y > 1990 AND y < 2100 THEN 'Year_' || y END, family) AS tags FROM f""")
def _(c):
    i = F.col("id")
    names = F.array(F.col("camera"), *[F.lit(x) for x in ("SONY ILCE-7", "Google Pixel 8", "iPad Pro", "FUJIFILM X-T5", "Leica Q", "GoPro HERO", "samsung SM", "Kodak")], F.col("camera"))
    created, modified = F.when(i % 40 == 1, 0.0).when(i % 40 == 2, 631000000.0).otherwise(F.col("created_at")), F.when(i % 40 == 3, 0.0).otherwise(F.col("modified_at"))
    return c.files.select("id", F.array_join(X.plain_tags(created, modified, F.get(names, (i % 10).cast("int"))), ",").alias("tags"))


_RECIPE = "2 * pi() * "


@query("fn_cyclic_time", f"""
WITH t AS (SELECT id, CASE WHEN id % 23 = 0 THEN -5 ELSE {_TAKEN} + id % 86400 + 0.5::DOUBLE END AS t FROM files), s AS (SELECT *, floor(t)::BIGINT AS s FROM t)
SELECT id, CASE WHEN t <= 0 THEN 0 ELSE round(sin({_RECIPE}(s // 86400 % 365) / 365), 6) + 0.0 END AS day_sin, CASE WHEN t <= 0 THEN 0 ELSE round(cos({_RECIPE}(s // 86400 % 365) / 365), 6) + 0.0 END AS day_cos,
  CASE WHEN t <= 0 THEN 0 ELSE round(sin({_RECIPE}(s % 86400) / 86400), 6) + 0.0 END AS time_sin, CASE WHEN t <= 0 THEN 0 ELSE round(cos({_RECIPE}(s % 86400) / 86400), 6) + 0.0 END AS time_cos,
  CASE WHEN t <= 0 THEN 0 ELSE round(ln(1 + least(t / (365.25::DOUBLE * 86400), 100)) / ln(101), 6) END AS years FROM s""")
def _(c):
    t = F.when(F.col("id") % 23 == 0, -5.0).otherwise(taken() + F.col("id") % 86400 + 0.5)
    five = c.files.select("id", X.time_features(t).alias("x"))
    return five.select("id", *[(F.round(F.get("x", F.lit(k)), 6) + 0.0).alias(n) for k, n in enumerate(("day_sin", "day_cos", "time_sin", "time_cos", "years"))])


@query("fn_group_keys", "SELECT source, substr(sha256(string_agg(id::VARCHAR, ',' ORDER BY id)), 1, 16) AS key FROM files GROUP BY source")
def _(c):
    ids = F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))
    return c.files.groupBy("source").agg(F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 16).alias("key"))


@query("fn_json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(c):
    return c.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_FOLDER_NAMES = ("DCIM", "100CANON", "IMG_2041", "Summer in Rome", "new folder 2", "new folder x", "a1", "2023", "Paris 2019", "Trip DSC-0042", "P1010042", " Downloads ", "ab")
_GENERIC = ", ".join(f"'{x}'" for x in X.GENERIC_FOLDERS)


@query("fn_folder_names", rf"""
WITH n AS (SELECT DISTINCT source AS name FROM files UNION ALL SELECT unnest([{", ".join(f"'{x}'" for x in _FOLDER_NAMES)}])), l AS (SELECT name, lower(trim(name)) AS n FROM n)
SELECT name, n = '' OR n IN ({_GENERIC}) OR regexp_matches(n, '^(new folder|untitled folder|untitled)( [0-9]+)?$') OR regexp_matches(n, '^[0-9]{{3}}[a-z_]{{3,5}}$') AS generic,
  length(n) >= 3 AND NOT contains(n, '_') AND NOT regexp_matches(n, '\b(dsc|dscf|dscn|img|imgp|pxl|mvi|gopr|gp|dji|p\d{{3}}|_mg|mg)[_-]?\d{{3,}}') AND NOT regexp_matches(n, '\b[a-z]{{0,4}}\d{{4,}}\b') AS usable FROM l""")
def _(c):
    more = c.spark.createDataFrame([(x,) for x in _FOLDER_NAMES], "name string")
    return c.files.select(F.col("source").alias("name")).distinct().union(more).select("name", X.generic_folder(F.col("name")).alias("generic"), X.usable_folder(F.col("name")).alias("usable"))
