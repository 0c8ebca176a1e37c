"""Plans for folders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions import text as X
from cairnlake.operators import facts, naming
from cairnlake.operators import organize as O
from cairnlake.plans.registry import query

_PLAN = """
WITH sp AS (SELECT file_id, min(name) AS person FROM faces LEFT JOIN persons ON persons.id = person_id GROUP BY file_id HAVING count(*) = count(name) AND count(DISTINCT CASE WHEN name IS NOT NULL THEN person_id END) = 1),
j AS (SELECT id, folder, stem, extension, kind, lat, lon, person, id % 31 = 5 AS has_text, CASE WHEN id % 29 = 0 THEN 0 ELSE coalesce(created_at, modified_at) END AS t FROM files LEFT JOIN sp ON sp.file_id = files.id),
y AS (SELECT *, CASE WHEN t > 86400 THEN '/' || strftime(make_timestamp((t * 1e6)::BIGINT), '%Y') ELSE '' END AS y, CASE WHEN t > 86400 THEN '/' || strftime(make_timestamp((t * 1e6)::BIGINT), '%B') ELSE '' END AS month,
  format('{:.1f}_{:.1f}', round(lat * 2) / 2, round(lon * 2) / 2) AS place, abs(lat) <= 90 AND abs(lon) <= 180 AS here FROM j),
p AS (SELECT id, folder, stem, extension, person, x.d AS destination, x.c AS category, x.h AS confidence FROM (SELECT *, CASE
  WHEN person IS NOT NULL THEN {d: 'People/' || person || y, c: 'People/' || person, h: CASE y WHEN '' THEN 'review' ELSE 'auto' END}
  WHEN here THEN {d: 'Places/' || place || y, c: 'Places/' || place, h: 'review'}
  WHEN has_text OR kind = 'pdf' OR kind = 'doc' THEN {d: 'Documents' || y, c: 'document', h: CASE y WHEN '' THEN 'ask' ELSE 'review' END}
  WHEN kind = 'image' THEN {d: 'Photos' || y || month, c: 'photo', h: CASE y WHEN '' THEN 'ask' ELSE 'review' END}
  WHEN kind = 'video' THEN {d: 'Videos' || y, c: 'video', h: CASE y WHEN '' THEN 'ask' ELSE 'review' END}
  WHEN kind = 'audio' THEN {d: 'Audio' || y, c: 'audio', h: 'review'} WHEN kind = 'model' THEN {d: '3D Models', c: 'model', h: 'review'} ELSE {d: 'Misc', c: 'misc', h: 'ask'} END AS x FROM y)),
tiers AS (SELECT folder, sum(n)::BIGINT AS n, CASE WHEN sum(n) <= 2 THEN 'junk' WHEN max(n) / sum(n) >= 0.8 THEN 'anchor' ELSE 'mixed' END AS tier FROM (SELECT folder, category, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2) GROUP BY folder)
"""
_GENERIC = ", ".join(f"'{x}'" for x in facts.GENERIC_FOLDERS)
_PLACES = _PLAN + f"""
, q AS (SELECT id, category, CASE WHEN id % 11 = 0 THEN folder || '/Downloads' WHEN id % 11 = 1 AND category = 'document' THEN '/LIB' WHEN id % 11 = 2 AND category = 'document' THEN '/lib/papers' ELSE folder END AS folder FROM p),
qt AS (SELECT folder, sum(n)::BIGINT AS n, CASE WHEN lower(regexp_extract(folder, '([^/]*)$', 1)) IN ({_GENERIC}) OR sum(n) <= 2 THEN 'junk' WHEN lower(folder) <> '/lib' AND max(n) / sum(n) >= 0.8 THEN 'anchor' ELSE 'mixed' END AS tier FROM (SELECT folder, category, count(*)::DOUBLE AS n FROM q GROUP BY 1, 2) GROUP BY folder)
"""


def _places(c):
    """The plan with some files in a folder of a generic name, in the library's root, and in one of a single category."""
    i, document = F.col("id"), F.col("category") == "document"
    place = F.when(i % 11 == 0, F.concat("folder", F.lit("/Downloads"))).when((i % 11 == 1) & document, "/LIB").when((i % 11 == 2) & document, "/lib/papers").otherwise(F.col("folder"))
    return _plan(c).withColumn("folder", place)



def _plan(c):
    """The plan of all files, of which some have no date and some bear text."""
    i = F.col("id")
    files = c.files.withColumns({"has_text": i % 31 == 5, "created_at": F.when(i % 29 == 0, 0.0).otherwise(F.col("created_at"))})
    return O.plan(files, O.single_person(c.faces, c.persons))


@query("org_cascade", _PLAN + "SELECT id, destination, category, confidence FROM p")
def _(c):
    return _plan(c).select("id", "destination", "category", "confidence")


@query("org_confidence_counts", _PLAN + "SELECT confidence, category, count(*) AS n FROM p GROUP BY 1, 2")
def _(c):
    return _plan(c).groupBy("confidence", "category").agg(F.count(F.lit(1)).alias("n"))


@query("org_folder_tier", _PLACES + "SELECT folder, n, tier FROM qt")
def _(c):
    return facts.folder_tiers(_places(c), "/lib")


@query("org_without_anchors", _PLACES + "SELECT q.id, p.destination FROM q JOIN p ON p.id = q.id JOIN qt ON qt.folder = q.folder WHERE tier <> 'anchor' OR starts_with(q.category, 'People/')")
def _(c):
    p = _places(c)
    return O.without_anchors(p, facts.folder_tiers(p, "/lib"), F.col("category").startswith("People/")).select("id", "destination")


@query("org_collision_free", _PLAN + ", k AS (SELECT *, row_number() OVER (PARTITION BY destination, lower(stem), lower(extension) ORDER BY id) AS r FROM p) SELECT id, destination || '/' || stem || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.' || extension AS target FROM k")
def _(c):
    return O.without_collisions(_plan(c))


_TOKENS = r"""
WITH t AS (SELECT source AS g, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM files), f AS (SELECT g, token, count(*) AS tf FROM t WHERE length(token) >= 4 GROUP BY 1, 2)
"""


@query("org_ctfidf", """
WITH t AS (SELECT DISTINCT source AS g, id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM files), f AS (SELECT * FROM t WHERE length(token) >= 4),
x AS (SELECT g, token, count(*) / (SELECT count(DISTINCT id) FROM f z WHERE z.g = f.g) * ln((SELECT count(DISTINCT id) FROM f) / (SELECT count(DISTINCT id) FROM f w WHERE w.token = f.token)) AS s FROM f GROUP BY g, token),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(s, 9) DESC, token) AS r FROM x WHERE round(s, 9) > 0)
SELECT g AS "group", (SELECT string_agg(upper(token[1]) || token[2:], ' ' ORDER BY r) FROM r WHERE r.g = n.g AND r <= 2) AS name FROM (SELECT DISTINCT g FROM f) n""")
def _(c):
    t = c.texts.select(F.col("source").alias("group"), "id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("tokens"))
    return O.group_names(t)


_FILE_WORDS = ", ".join(f"'{w}'" for w in O.FILE_WORDS)


@query("org_feedback_boost", _PLAN + f"""
, m AS (SELECT id, string_split(destination, '/')[-1] AS folder, confidence, id % 3 = 0 AS applied, list_filter(regexp_extract_all(lower(stem), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '\\p{{L}}') AND NOT list_contains([{_FILE_WORDS}], t)) AS tokens FROM p),
w AS (SELECT token, folder, count(*) AS weight FROM (SELECT folder, unnest(tokens) AS token FROM m WHERE applied) GROUP BY 1, 2),
h AS (SELECT id FROM (SELECT id, folder, unnest(tokens) AS token FROM m WHERE confidence = 'review' AND NOT applied) x JOIN w USING (token, folder) GROUP BY id HAVING sum(weight) >= 3)
SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN 'auto' ELSE confidence END AS confidence FROM m WHERE NOT applied""")
def _(c):
    # a third of the plan was applied
    moves = _plan(c).select("id", "stem", F.element_at(F.split("destination", "/"), -1).alias("folder"), "confidence")
    applied = F.col("id") % 3 == 0
    return O.boosted(moves.where(~applied), O.recorded_moves(moves.where(applied))).select("id", "confidence")


@query("org_majority_votes", """
WITH l AS (SELECT "user", kind AS vote FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY seconds DESC, id) AS r FROM signals WHERE kind IN ('view', 'click')) WHERE r <= 50), e AS (SELECT "user", vote, count(*) AS n FROM l GROUP BY 1, 2)
SELECT "user", vote FROM e JOIN (SELECT "user" AS u, sum(n) AS t FROM e GROUP BY 1) x ON u = "user" WHERE t >= 3 AND 2 * n > t""")
def _(c):
    r = F.row_number().over(Window.partitionBy("user").orderBy(F.col("seconds").desc(), "id"))
    votes = c.signals.where("kind IN ('view', 'click')").withColumn("r", r).where("r <= 50").select("user", F.col("kind").alias("vote"))
    return O.majority(votes, "user")


@query("org_signature_vocabulary", r"""
WITH t AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(stem), '[a-z]+'))) AS token FROM files) SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 512""")
def _(c):
    t = c.files.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("stem"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.col("n").desc(), "token").limit(512)


@query("org_safe_names", r"""
WITH n AS (SELECT id, replace(path, '/lib/', CASE id % 3 WHEN 0 THEN '..' WHEN 1 THEN 'a:b*' ELSE '' END) AS p FROM files) SELECT id, regexp_replace(regexp_replace(p, '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM n""")
def _(c):
    p = F.replace(F.col("path"), F.lit("/lib/"), F.when(F.col("id") % 3 == 0, "..").when(F.col("id") % 3 == 1, "a:b*").otherwise(""))
    return c.files.select("id", X.safe_component(p).alias("name"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query("org_prototype_folders", rf"""
WITH m AS (SELECT files.id, folder, stem, v FROM vectors JOIN files ON files.id = vectors.id), u AS (SELECT folder, unnest(range(64)) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM m), a AS (SELECT folder, i, avg(x) AS x, count(*) AS n FROM u GROUP BY 1, 2),
l AS (SELECT folder, max(n) AS n, sqrt(sum(x * x)) AS l, max(CASE WHEN i = 0 THEN x END) AS x0, max(CASE WHEN i = 63 THEN x END) AS x63 FROM a GROUP BY folder HAVING max(n) >= 3),
t AS (SELECT folder, unnest(regexp_split_to_array(lower(stem), '[^\p{{L}}\p{{N}}]+')) AS t FROM m UNION ALL SELECT folder, unnest(regexp_split_to_array(lower(regexp_extract(folder, '([^/]*)$', 1)), '[^\p{{L}}\p{{N}}]+')) FROM m),
k AS (SELECT folder, string_agg(DISTINCT t, ' ' ORDER BY t) AS tokens FROM t WHERE length(t) >= 3 AND NOT regexp_matches(t, '^\p{{N}}+$') AND t NOT IN ({_STOP}) GROUP BY folder)
SELECT l.folder, n, round(x0 / l, 6) AS first, round(x63 / l, 6) AS last, coalesce(tokens, '') AS tokens FROM l LEFT JOIN k ON k.folder = l.folder""")
def _(c):
    p = O.folder_prototypes(c.files, c.vectors, 3)
    return p.select("folder", "n", F.round(F.get("centroid", 0), 6).alias("first"), F.round(F.get("centroid", 63), 6).alias("last"), F.array_join("tokens", " ").alias("tokens"))


@query("org_smart_names")
def _(c):
    tags = c.tags.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    files = c.files.join(tags, "id", "left").select("id", F.col("stem").alias("original"), "description", "tags")
    return naming.propose_names(files)


@query("org_sequence_names", """
WITH g AS (SELECT id, folder, lang AS name, extension FROM files), u AS (SELECT id, folder, name, extension, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY id) AS n FROM g)
SELECT id, name || CASE WHEN n + CASE WHEN contains(folder, 'src1/') THEN 1 ELSE 0 END > 1 THEN '_' || (n + CASE WHEN contains(folder, 'src1/') THEN 1 ELSE 0 END) ELSE '' END || '.' || extension AS final FROM u""")
def _(c):
    proposals = c.files.select("id", "folder", F.col("lang").alias("name"), "extension")
    taken = c.files.where(F.col("folder").contains("src1/")).select("folder", F.col("lang").alias("name")).distinct()
    return naming.unique_names(proposals, taken)


@query("org_numbered_shots", """
WITH m AS (SELECT id, folder || id // 30 % 7 AS g, lower(stem) AS stem, rtrim(repeat('Trip to Rome - ', 1 + id % 6)) AS name FROM files), s AS (SELECT g, stem, row_number() OVER (PARTITION BY g ORDER BY min(id)) AS n, count(*) OVER (PARTITION BY g) AS shots FROM m GROUP BY g, stem),
x AS (SELECT m.id, name, CASE WHEN shots = 1 THEN '' WHEN shots >= 10 AND n < 10 THEN ' 0' || n ELSE ' ' || n END AS suffix FROM m JOIN s ON s.g = m.g AND s.stem = m.stem)
SELECT id, CASE suffix WHEN '' THEN name ELSE trim(substr(name, 1, 60 - length(suffix)), ' -_') || suffix END AS final FROM x""")
def _(c):
    i = F.col("id")
    group = F.concat("folder", (F.floor(i / 30) % 7).cast("string"))
    name = F.rtrim(F.repeat(F.lit("Trip to Rome - "), (1 + i % 6).cast("int")))
    return naming.sequence_names(c.files.select("id", group.alias("group"), i.alias("position"), "path", name.alias("name")))


@query("org_semantic")
def _(c):
    folders = c.files.select("id", "folder")
    return O.semantic_plan(c.files, c.vectors.select("id", "v"), folders, 0.2, 0.02, 0.3)


@query("org_signatures", r"""
WITH t AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(stem), '[a-z]+'))) AS token FROM files), voc AS (SELECT token FROM t GROUP BY token HAVING count(*) >= 2 ORDER BY count(*) DESC, token LIMIT 512), n AS (SELECT id, count(*) AS n FROM t WHERE token IN (SELECT token FROM voc) GROUP BY id)
SELECT id, n AS ones, round(1 / sqrt(n), 6) AS weight FROM n""")
def _(c):
    t = c.files.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("stem"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    top = t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.col("n").desc(), "token").limit(512)
    vocabulary = top.select("token", (F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) - 1).alias("i"))
    return O.signatures(t, vocabulary).select("id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("ones"), F.round(F.array_max("v"), 6).alias("weight"))


def _role_sql(x):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '(^|[^\\p{{L}}])({'|'.join(words)})([^\\p{{L}}]|$)') THEN '{role}'" for role, words in O.ROLE_WORDS.items()) + " END"


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


_FILE_ROLE = f"CASE WHEN lower(extension) IN ({_in(O.RAW_EXTENSIONS)}) THEN 'raw' WHEN kind = 'video' THEN 'video' WHEN lower(extension) IN ({_in(O.JPEG_EXTENSIONS)}) THEN 'jpeg' ELSE 'photo' END"
_FITS = "coalesce({1} IS NULL OR {1} = {0} OR ({1} = 'photo' AND {0} <> 'video'), false)"


@query("org_folder_roles", f"""
WITH n AS (SELECT id, kind, extension, (['RAW', 'jpeg export', 'Video clips', 'My photos', 'trip'])[(id % 5 + 1)::INTEGER] AS folder FROM files), r AS (SELECT id, {_role_sql('folder')} AS fr, {_FILE_ROLE} AS r FROM n)
SELECT id, fr AS folder_role, r AS file_role, {_FITS.format('r', 'fr')} AS fits FROM r""")
def _(c):
    folder = F.element_at(F.array(*[F.lit(x) for x in ("RAW", "jpeg export", "Video clips", "My photos", "trip")]), (F.col("id") % 5 + 1).cast("int"))
    a, b = O.folder_role(folder), O.file_role(F.col("kind"), F.col("extension"))
    return c.files.select("id", a.alias("folder_role"), b.alias("file_role"), F.coalesce(O.fits(b, a), F.lit(False)).alias("fits"))


_GENERIC_NAME = f"(trim(lower(f)) = '' OR trim(lower(f)) IN ({_in(X.GENERIC_FOLDERS)}) OR regexp_matches(trim(lower(f)), '^(new folder|untitled folder|untitled)( [0-9]+)?$') OR regexp_matches(trim(lower(f)), '^[0-9]{{3}}[a-z_]{{3,5}}$'))"
_USABLE = r"(length(trim(f)) >= 3 AND NOT contains(f, '_') AND NOT regexp_matches(trim(lower(f)), '\b(dsc|dscf|dscn|img|imgp|pxl|mvi|gopr|gp|dji|p\d{3}|_mg|mg)[_-]?\d{3,}') AND NOT regexp_matches(trim(lower(f)), '\b[a-z]{0,4}\d{4,}\b'))"
_MOVES = _PLAN + """
, v AS (SELECT p.id, files.kind, p.extension, CASE p.id % 4 WHEN 0 THEN '/lib/DCIM/100CANON/x.' || p.extension WHEN 1 THEN '/lib/inbox/x.' || p.extension WHEN 2 THEN '/lib/trip/JPEGs/x.' || p.extension ELSE files.path END AS path,
  CASE p.id % 4 WHEN 2 THEN 'trip/RAW' WHEN 3 THEN p.destination WHEN 0 THEN CASE WHEN p.id % 8 = 0 THEN 'Photos/2023/May' ELSE 'Rome 2019/IMG_2041' END ELSE 'Paris holiday/videos' END AS destination FROM p JOIN files ON files.id = p.id)
"""


@query("org_respected", _MOVES + f"""
, w AS (SELECT *, string_split(path, '/')[3:len(string_split(path, '/')) - 1] AS src, string_split(destination, '/') AS dst, {_FILE_ROLE} AS role FROM v),
r AS (SELECT *, {_role_sql('dst[len(dst)]')} AS dr, {_role_sql('src[len(src)]')} AS sr FROM w)
SELECT id, destination FROM r WHERE CASE WHEN len(list_filter(src, lambda f: NOT {_GENERIC_NAME})) > 0
  THEN len(src) = len(dst) AND len(src) >= 2 AND src[1:len(src) - 1] = dst[1:len(dst) - 1] AND dr IS NOT NULL AND NOT {_FITS.format('role', 'sr')} AND {_FITS.format('role', 'dr')}
  ELSE {_FITS.format('role', 'dr')} AND len(list_filter(dst, lambda f: NOT (list_contains(src, f) OR {_USABLE} OR {_role_sql('f')} IS NOT NULL OR regexp_matches(f, '^[0-9]{{4}}$') OR f IN ({_in(O.MONTHS)})))) = 0 END""")
def _(c):
    i = F.col("id")
    p = _plan(c).join(c.files.select("id", "kind"), "id")
    file = F.concat(F.lit("/x."), F.col("extension"))
    path = F.when(i % 4 == 0, F.concat(F.lit("/lib/DCIM/100CANON"), file)).when(i % 4 == 1, F.concat(F.lit("/lib/inbox"), file)).when(i % 4 == 2, F.concat(F.lit("/lib/trip/JPEGs"), file)).otherwise(F.col("path"))
    to = F.when(i % 4 == 2, "trip/RAW").when(i % 4 == 3, F.col("destination")).when(i % 8 == 0, "Photos/2023/May").when(i % 4 == 0, "Rome 2019/IMG_2041").otherwise("Paris holiday/videos")
    return O.respected(p.select("id", "kind", "extension", path.alias("path"), to.alias("destination")), "/lib").select("id", "destination")


_FOLDERS = ("New Folder", "1850", "2019", "Rome", "Backup 3", "332699", "2100", "1900", "Downloads (2)", "Temp-files", "2 desktop", "New Folder 2", "Other", "others", "temporary", "")


@query("org_junk_prototypes", f"""
WITH n AS (SELECT DISTINCT lower(([{", ".join(f"'{x}'" for x in _FOLDERS)}])[(id % {len(_FOLDERS)} + 1)::INTEGER]) AS name FROM files),
w AS (SELECT *, list_filter(string_split_regex(name, '[^a-z]+'), lambda x: x <> '')[1] AS first FROM n)
SELECT name, CASE WHEN list_contains(['downloads', 'downloaded', 'desktop', 'new folder', 'untitled', 'temp', 'tmp', 'misc', 'other', 'stuff', 'things', 'files', 'unsorted', 'inbox'], name) THEN true
  WHEN name <> '' AND regexp_full_match(name, '[0-9]*') AND NOT (length(name) = 4 AND try_cast(name AS INTEGER) BETWEEN 1900 AND 2099) THEN true
  ELSE coalesce(list_contains(['desktop', 'downloads', 'download', 'downloaded', 'temp', 'tmp', 'unsorted', 'inbox', 'misc'], first), false) END AS junk FROM w""")
def _(c):
    name = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("id") % len(_FOLDERS) + 1).cast("int"))
    return c.files.select(F.lower(name).alias("name")).distinct().select("name", O.junk_prototype(F.col("name")).alias("junk"))


@query("fn_reply_fields", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def _(c):
    reply = F.when(F.col("event_id") % 3 == 0, F.lit("no idea")).otherwise(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")))
    return c.table("events").select("event_id", O.reply_fields(reply, "k string")["k"].alias("k"))


_STORED = _PLAN + """
, s AS (SELECT p.id, files.path AS source, CASE WHEN p.id % 13 = 0 THEN '/elsewhere/' || p.id WHEN p.id % 13 = 1 THEN upper(files.path) WHEN p.id % 13 = 2 THEN '/lib/taken.txt' ELSE '/lib/' || p.destination || '/' || p.id || '.' || p.extension END AS destination, confidence FROM p JOIN files ON files.id = p.id WHERE p.id % 17 <> 0),
now AS (SELECT id, CASE WHEN id % 17 = 0 AND id % 2 = 0 THEN '/lib/taken.txt' WHEN id % 19 = 1 THEN path || '.old' ELSE path END AS path FROM files WHERE id % 23 <> 0)
"""


def _stored(c):
    """A plan as it was stored, and the files as they are later."""
    i = F.col("id")
    p = _plan(c).join(c.files.select("id", F.col("path").alias("source")), "id").where(i % 17 != 0)
    to = F.when(i % 13 == 0, F.concat(F.lit("/elsewhere/"), i.cast("string"))).when(i % 13 == 1, F.upper("source")).when(i % 13 == 2, "/lib/taken.txt").otherwise(F.concat(F.lit("/lib/"), "destination", F.lit("/"), i.cast("string"), F.lit("."), "extension"))
    now = c.files.where(i % 23 != 0).select("id", F.when((i % 17 == 0) & (i % 2 == 0), "/lib/taken.txt").when(i % 19 == 1, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"))
    return p.select("id", "source", to.alias("destination"), "confidence"), now


@query("org_plan_checked", _STORED + """
SELECT s.id, CASE WHEN now.path IS NULL THEN 'missing' WHEN now.path <> source THEN 'moved' WHEN lower(source) = lower(destination) THEN 'noop' WHEN NOT starts_with(destination, '/lib/') OR contains(destination, '/../') THEN 'outside'
  WHEN lower(destination) IN (SELECT lower(path) FROM now WHERE id NOT IN (SELECT id FROM s)) THEN 'taken' WHEN count(*) OVER (PARTITION BY lower(destination)) > 1 THEN 'clash' ELSE 'ok' END AS verdict FROM s LEFT JOIN now ON now.id = s.id""")
def _(c):
    plan, now = _stored(c)
    return O.checked_plan(plan, now, "/lib")


@query("org_plan_page", _STORED + "SELECT id, source, destination FROM s WHERE confidence = 'review' AND id > 100 ORDER BY id LIMIT 50")
def _(c):
    plan, _ = _stored(c)
    return O.plan_page(plan, "review", 100, 50).select("id", "source", "destination")
