"""Search, fusion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import light_stem, stemmed_tokens
from cairnlake.functions.vectors import cosine
from cairnlake.operators import ask
from cairnlake.operators import retrieval as R
from cairnlake.operators import similarity as S
from cairnlake.operators.filters import Filter
from cairnlake.operators.shortlist import best_above, codes
from cairnlake.plans.registry import query
from cairnlake.session import written

_BM25 = r"""
WITH t AS (SELECT id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM files),
f AS (SELECT id, len(t) AS length, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: x = 'license')) AS tf1 FROM t),
s AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f),
hits AS (SELECT id, ln(1 + (n - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE)) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean)) + ln(1 + (n - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean)) AS score FROM f, s WHERE tf0 > 0 AND tf1 > 0),
kw AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, score FROM hits QUALIFY rank <= 30)
"""
_VISUAL = """, vis AS (SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE id = 17)), 9) DESC, id) AS rank FROM vectors QUALIFY rank <= 30),
fused AS (SELECT id, sum(1 / (60.0::DOUBLE + rank)) AS score, min(l * 1000 + rank) AS place FROM (SELECT id, rank, 0 AS l FROM kw UNION ALL SELECT id, rank, 1 FROM vis) GROUP BY id)
"""


def _index(c):
    return R.text_index(c.spark, c.documents_path, c.texts, F.col("text"))


def _keyword(c):
    return R.ranked(R.bm25(_index(c), ["the", "license"]), 30)


def _visual(c):
    q = c.vectors.where("id = 17").select("v").first()[0]
    return R.ranked(S.top_k(c.vectors, q, 30), 30)


@query("text_bm25", _BM25 + "SELECT id, rank, round(score, 6) AS score FROM kw")
def _(c):
    hits = R.bm25(_index(c), ["the", "license"])
    return R.ranked(hits, 30).join(hits, "id").select("id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("rrf_fusion", _BM25 + _VISUAL + "SELECT id, round(score, 9) AS score FROM fused ORDER BY round(score, 12) DESC, place, id LIMIT 50")
def _(c):
    return R.fuse([_keyword(c), _visual(c)]).select("id", F.round("score", 9).alias("score"))


@query("hybrid_search", _BM25 + _VISUAL + "SELECT fused.id, round(score, 9) AS score, path FROM fused JOIN files ON files.id = fused.id WHERE kind IN ('image', 'doc', 'pdf', 'video') ORDER BY round(score, 12) DESC, place, fused.id LIMIT 20")
def _(c):
    hits = R.restrict(R.fuse([_keyword(c), _visual(c)], limit=60), Filter(kinds=("image", "doc", "pdf", "video")).apply(c.files))
    return hits.orderBy(F.round("score", 12).desc(), "at", "id").limit(20).join(c.files.select("id", "path"), "id").select("id", F.round("score", 9).alias("score"), "path")


@query("search_restrict_fill", _BM25 + ", h AS (SELECT id, rank::INTEGER AS rank FROM kw WHERE id IN (SELECT id FROM files WHERE size_bytes > 800)), m AS (SELECT id, 2147483647 AS rank FROM files WHERE kind = 'pdf' AND id NOT IN (SELECT id FROM h) ORDER BY id LIMIT 40) SELECT id, rank FROM (SELECT * FROM h UNION ALL SELECT * FROM m) ORDER BY rank, id LIMIT 40")
def _(c):
    hits = R.restrict(_keyword(c), Filter(above_bytes=800).apply(c.files))
    return R.fill(hits, c.files.where("kind = 'pdf'"), 40)


@query("text_phrase", r"""
WITH t AS (SELECT id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM files)
SELECT id FROM t WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'licensed' AND t[i + 1] = 'under')) > 0 AND list_contains(t, 'the')""")
def _(c):
    return R.phrase_hits(_index(c), '-- "Licensed-under" ! thé')


@query("text_subject_and_or", r"""
WITH t AS (SELECT id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM files)
SELECT id FROM t WHERE (list_has_any(t, ['licenses', 'licens', 'license']) AND list_has_any(t, ['the'])) OR (list_has_any(t, ['clown']) AND list_has_any(t, ['idiots', 'idiot']))""")
def _(c):
    return R.subject_ids(_index(c), [["licenses", "the"], ["clown", "idiots"]])


_SEEN = "SELECT file_id, CASE tag WHEN 'view' THEN 'Mountain_View ' WHEN 'signup' THEN 'Sign-ups' ELSE tag END AS tag, CASE source WHEN 'clip' THEN CASE WHEN file_id % 5 = 0 THEN 'other' ELSE 'auto' END ELSE source END AS source, score FROM tags"


@query("text_tag_prefix", f"""
WITH t AS ({_SEEN}), k AS (SELECT * FROM t WHERE source IN ('auto', 'user', 'vlm')), q AS (SELECT unnest(['errors', 'errors', 'errors', 'mountains', 'mountains', 'sign', 'views', 'views']) AS word, unnest(['errors', 'error', 'error', 'mountains', 'mountain', 'sign', 'views', 'view']) AS form),
w AS (SELECT file_id, count(DISTINCT word) AS words FROM k JOIN q ON ' ' || replace(lower(tag), '_', ' ') LIKE '% ' || form || '%' GROUP BY file_id ORDER BY words DESC, file_id DESC LIMIT 100), b AS (SELECT * FROM w WHERE words = (SELECT max(words) FROM w)),
o AS (SELECT b.file_id, words, replace(trim(tag), '_', ' ') AS tag, min({{p: CASE source WHEN 'user' THEN 0 WHEN 'vlm' THEN 1 ELSE 2 END, s: -coalesce(score, 0)}}) AS o FROM b JOIN k ON k.file_id = b.file_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY o, tag) AS r FROM o) SELECT file_id, words, 'Tags: ' || string_agg(tag, ', ' ORDER BY r) AS text FROM r WHERE r <= 8 GROUP BY file_id, words""")
def _(c):
    tag = F.when(F.col("tag") == "view", "Mountain_View ").when(F.col("tag") == "signup", "Sign-ups").otherwise(F.col("tag"))
    source = F.when(F.col("source") != "clip", F.col("source")).when(F.col("file_id") % 5 == 0, "other").otherwise("auto")
    return R.tag_hits(c.tags.select("file_id", tag.alias("tag"), source.alias("source"), "score"), "of errors, SIGN mountains; Views")


@query("grid_keyword", """
SELECT id FROM files WHERE contains(lower(text), 'license') OR contains(lower(path), 'paris') OR contains(lower(coalesce(description, '')), 'the') OR id IN (SELECT file_id FROM tags WHERE tag = 'error')
  OR id IN (SELECT file_id FROM faces JOIN persons ON persons.id = person_id WHERE contains(lower(name), 'fra'))""")
def _(c):
    people = c.faces.join(c.persons.where(F.lower("name").contains("fra")).select(F.col("id").alias("person_id")), "person_id", "left_semi").select("file_id")
    also = c.tags.where("tag = 'error'").select("file_id").union(people).distinct().withColumnRenamed("file_id", "id").withColumn("also", F.lit(True))
    text = F.lower("text").contains("license") | F.lower("path").contains("paris") | F.lower(F.coalesce("description", F.lit(""))).contains("the")
    return c.texts.join(also, "id", "left").where(text | F.col("also").isNotNull()).select("id")


@query("evidence_ordered", "SELECT conv, turn, CASE role WHEN 'system' THEN 'chapter' WHEN 'assistant' THEN 'passage' ELSE 'frame' END AS kind FROM messages WHERE contains(lower(text), 'th') ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, conv, turn LIMIT 80")
def _(c):
    kind = F.when(F.col("role") == "system", "chapter").when(F.col("role") == "assistant", "passage").otherwise("frame")
    m = c.messages.where(F.lower("text").contains("th")).select("conv", "turn", kind.alias("kind"))
    return m.orderBy(R.evidence_order(F.col("kind")), "conv", "turn").limit(80)


@query("evidence_by_tier", "SELECT id, tier, CASE tier WHEN 'content' THEN 0 WHEN 'ocr' THEN 1 ELSE 2 END AS source_rank FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'filename' WHEN 1 THEN 'ocr' ELSE 'content' END AS tier FROM files) ORDER BY source_rank, id * 7 % 50, id LIMIT 100")
def _(c):
    tier = F.when(F.col("id") % 3 == 0, "filename").when(F.col("id") % 3 == 1, "ocr").otherwise("content")
    hits = c.files.select("id", tier.alias("tier"), (F.col("id") * 7 % 50).alias("ordinal"))
    return R.by_tier(hits, 100).select("id", "tier", R.source_rank(F.col("tier")).alias("source_rank"))


@query("evidence_near_time", "SELECT a.id AS shot, b.id AS near FROM signals a JOIN signals b ON a.\"user\" = b.\"user\" AND a.id <> b.id AND abs(a.seconds - b.seconds) <= 600 WHERE a.kind = 'purchase' AND b.kind = 'error'")
def _(c):
    # Equality on the user and on ten-minute cells, so the band never meets all rows of a user
    cell = F.floor(F.col("seconds") / 600)
    a = c.signals.where("kind = 'purchase'").select("user", F.col("id").alias("shot"), F.col("seconds").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = c.signals.where("kind = 'error'").select("user", F.col("id").alias("near"), F.col("seconds").alias("to"), cell.alias("cell"))
    return a.join(b, ["user", "cell"]).where("abs(at - to) <= 600").select("shot", "near")


@query("first_hit_per_file", "SELECT conv, turn FROM (SELECT conv, turn, row_number() OVER (PARTITION BY conv ORDER BY length(text) DESC, turn) AS r FROM messages) WHERE r = 1")
def _(c):
    best = c.messages.groupBy("conv").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("turn")).alias("back"))).alias("x"))
    return best.select("conv", (-F.col("x.back")).alias("turn"))


@query("selection_blend", r"""
WITH e AS (SELECT id, list_distinct(list_transform(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)) AS stems FROM files),
p AS (SELECT file_id AS id, list(DISTINCT person_id) AS people FROM faces WHERE person_id IS NOT NULL AND excluded = 0 GROUP BY 1),
x AS (SELECT e.id, CASE WHEN e.id % 6 <> 0 THEN list_cosine_similarity(v, (SELECT v FROM vectors WHERE id = 2)) END AS clip, list_filter([{s: 'the', w: 'the'}, {s: 'que', w: 'ques'}, {s: 'und', w: 'und'}], lambda t: list_contains(stems, t.s)) AS m,
  len(list_intersect(coalesce(people, []), [1, 4])) AS n FROM e JOIN vectors ON vectors.id = e.id LEFT JOIN p ON p.id = e.id)
SELECT id, array_to_string(list_transform(m, lambda t: t.w), ',') AS matched, round((coalesce(0.6::DOUBLE * least(greatest((clip - 0.18) / 0.17, 0), 1), 0) + 0.3::DOUBLE * len(m) / 3 + 0.3::DOUBLE * n / 2) / (0.6::DOUBLE + CASE WHEN clip IS NULL THEN 0 ELSE 0.6 END), 4) AS score FROM x""")
def _(c):
    q = c.vectors.where("id = 2").select("v").first()[0]
    clip = F.when(F.col("id") % 6 != 0, cosine(F.col("v"), F.array(*[F.lit(x) for x in q])))
    people = c.faces.where("person_id IS NOT NULL AND excluded = 0").groupBy(F.col("file_id").alias("id")).agg(F.collect_set("person_id").alias("people"))
    words = F.regexp_extract_all(F.lower(F.coalesce("description", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = c.files.join(c.vectors.select("id", "v"), "id").join(people, "id", "left")
    rows = rows.select("id", clip.alias("clip"), F.transform(words, light_stem).alias("stems"), F.coalesce("people", F.array().cast("array<bigint>")).alias("people"))
    return R.selection(rows, [("the", "the"), ("que", "ques"), ("und", "und")], [1, 4]).select("id", F.array_join("matched", ",").alias("matched"), "score")


@query("text_stemmed_terms")
def _(c):
    t = c.messages.select(F.explode(stemmed_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("ask_count_videos", "SELECT count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM files WHERE kind = 'video' AND coalesce(created_at, modified_at) >= 1672531200 AND coalesce(created_at, modified_at) < 1704067200")
def _(c):
    return ask.answer(ask.parse("how many videos from 2023?", today="2024-06-15"), c.files, c.faces)


@query("ask_largest_photos", "SELECT id, path, size_bytes FROM files WHERE kind = 'image' ORDER BY size_bytes DESC, id LIMIT 5")
def _(c):
    return ask.answer(ask.parse("show the 5 largest photos", today="2024-06-15"), c.files, c.faces).select("id", "path", "size_bytes")


@query("ask_by_month", "SELECT strftime(to_timestamp(coalesce(created_at, modified_at)) AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files WHERE kind = 'audio' AND size_bytes > 1000 GROUP BY 1")
def _(c):
    return ask.answer(ask.parse("audio files bigger than 1 kb by month", today="2024-06-15"), c.files, c.faces)


@query("win_follow_ups", "SELECT conv, turn, lag(turn) OVER (PARTITION BY conv, role ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv) AS n FROM messages")
def _(c):
    return c.messages.select("conv", "turn", F.lag("turn").over(Window.partitionBy("conv", "role").orderBy("turn")).alias("before"), F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("n"))


@query("vec_passages_floor", "SELECT id, round(list_cosine_similarity(v, (SELECT v FROM vectors WHERE id = 30)), 6) AS score FROM vectors WHERE list_cosine_similarity(v, (SELECT v FROM vectors WHERE id = 30)) >= 0.2 ORDER BY score DESC, id LIMIT 20")
def _(c):
    q = c.vectors.where("id = 30").select("v").first()[0]
    coded = written(c.spark, "codes", f"{c.sf_dir}/embeddings.parquet", lambda: codes(c.vectors.select("id", "v")))
    return best_above(coded, c.vectors.select("id", "v"), q, 0.2).select("id", F.round("score", 6).alias("score"))


@query("chat_retrieval", _BM25 + _VISUAL + r"""
, r AS (SELECT id, score, place FROM fused WHERE id IN (SELECT id FROM files WHERE kind IN ('doc', 'pdf'))), h AS (SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, place, id)::INTEGER AS rank FROM r),
m AS (SELECT id, 2147483647 AS rank FROM files WHERE kind IN ('doc', 'pdf') AND list_contains(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), 'license') AND id NOT IN (SELECT id FROM h) ORDER BY id LIMIT 50) SELECT id, rank FROM (SELECT * FROM h UNION ALL SELECT * FROM m) ORDER BY rank, id LIMIT 50""")
def _(c):
    query_, kinds = ask.search_plan(["license files", "only documents"])
    found = Filter(kinds=kinds).apply(c.files)
    hits = R.restrict(R.fuse([_keyword(c), _visual(c)], limit=100), found)
    ranked = hits.select("id", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "at", "id")).alias("rank"))
    return R.fill(ranked, found.join(R.phrase_hits(_index(c), query_), "id", "left_semi"), 50)


_FLAT = r"substr(array_to_string(list_filter(regexp_split_to_array({0}, '[\n\r\x0B\f\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: x <> ''), ' '), 1, {1})"


@query("chat_history_blocks", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS r FROM messages), f AS (SELECT conv, turn, role, {_FLAT.format("coalesce(text, '')", 200)} AS t FROM r WHERE r <= 4)
SELECT conv, 'Earlier in this conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || t, chr(10) ORDER BY turn) || chr(10) AS block FROM f WHERE trim(t) <> '' GROUP BY conv""")
def _(c):
    return ask.history_blocks(c.messages, 4, 200)


@query("chat_evidence_lines", f"""
SELECT rank AS n, '[' || rank || '] ' || regexp_extract(path, '([^/]*)$', 1) || ' (' || concat_ws(', ', kind, CASE WHEN kind = 'video' THEN 'at ' || round(modified_at % 90)::BIGINT || ' s' END, CASE WHEN kind = 'pdf' THEN 'page ' || id % 9 END) || '): ' || {_FLAT.format("coalesce(text, '')", 400)} AS line
FROM (SELECT *, row_number() OVER (ORDER BY size_bytes DESC, id) AS rank FROM files) WHERE rank <= 30""")
def _(c):
    top = c.texts.orderBy(F.col("size_bytes").desc(), "id").limit(30)
    hits = top.select(F.row_number().over(Window.orderBy(F.col("size_bytes").desc(), "id")).cast("long").alias("rank"), "path", "kind", F.when(F.col("kind") == "video", F.round(F.col("modified_at") % 90)).alias("seconds"), F.when(F.col("kind") == "pdf", F.col("id") % 9).alias("page"), "text")
    return ask.evidence_lines(hits, 30)
