"""Where files should go, and what stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import base_name, generic_folder, name_tokens, safe_component, tokens, usable_folder
from cairnlake.operators.filters import moment, taken
from cairnlake.operators.similarity import centroids
from cairnlake.session import staged


#: A time up to a day after the epoch is no date.
NO_DATE = 86_400.0


def cascade() -> Column:
    """struct(destination, category, confidence) by the first rule that fits: person, place, document, photo, video, audio, model, misc.

    Columns: person, lat, lon, kind, has_text, created_at, modified_at. Destinations hold the year where there is a date;
    without one, documents, photos and videos are asked about, and a named person's files are reviewed.
    """
    when = taken()
    dated = ~F.isnan(when) & (F.abs(when) != float("inf")) & (when > NO_DATE)
    year, month = F.date_format(moment(when), "yyyy"), F.date_format(moment(when), "MMMM")
    under = lambda top, *more: F.when(dated, F.concat_ws("/", top, *more)).otherwise(top)
    half = lambda x: F.format_string("%.1f", F.round(F.col(x) * 2) / 2)
    bucket = F.concat(half("lat"), F.lit("_"), half("lon"))
    here = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    safe = safe_component(F.col("person"))
    rule = lambda to, category, how: F.struct(to.alias("destination"), category.alias("category"), how.alias("confidence"))
    sure = lambda yes, no: F.when(dated, yes).otherwise(no)
    people, places = F.concat(F.lit("People/"), safe), F.concat(F.lit("Places/"), bucket)
    kind, review = F.col("kind"), F.lit("review")
    return (
        F.when(F.col("person").isNotNull(), rule(under(people, year), people, sure("auto", "review")))
        .when(here, rule(under(places, year), places, review))
        .when(F.coalesce("has_text", F.lit(False)) | kind.isin("pdf", "doc"), rule(under(F.lit("Documents"), year), F.lit("document"), sure("review", "ask")))
        .when(kind == "image", rule(under(F.lit("Photos"), year, month), F.lit("photo"), sure("review", "ask")))
        .when(kind == "video", rule(under(F.lit("Videos"), year), F.lit("video"), sure("review", "ask")))
        .when(kind == "audio", rule(under(F.lit("Audio"), year), F.lit("audio"), review))
        .when(kind == "model", rule(F.lit("3D Models"), F.lit("model"), review))
        .otherwise(rule(F.lit("Misc"), F.lit("misc"), F.lit("ask")))
    )


def single_person(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(file_id, person) where all faces of a file are one named person."""
    j = faces.join(persons.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    g = j.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.countDistinct(F.when(F.col("name").isNotNull(), F.col("person_id"))).alias("people"), F.min("name").alias("person"))
    return g.where("n = named AND people = 1").select("file_id", "person")


def plan(files: DataFrame, people: DataFrame) -> DataFrame:
    """(id, path, destination, category, confidence)."""
    j = files.join(people.withColumnRenamed("file_id", "id"), "id", "left")
    return j.select("id", "path", "folder", "stem", "extension", cascade().alias("x")).select("id", "path", "folder", "stem", "extension", "x.*")


def without_collisions(moves: DataFrame) -> DataFrame:
    """Final names: the second and later files of one destination and name get a number."""
    w = Window.partitionBy("destination", F.lower("stem"), F.lower("extension")).orderBy("id")
    n = F.row_number().over(w)
    name = F.concat("stem", F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit("."), "extension")
    return moves.select("id", F.concat("destination", F.lit("/"), name).alias("target"))


def without_anchors(moves: DataFrame, tiers: DataFrame, exempt: Column) -> DataFrame:
    """Moves out of anchor folders are dropped, but for exempt ones."""
    anchors = tiers.where("tier = 'anchor'").select("folder").withColumn("__anchor", F.lit(True))
    return moves.join(anchors, "folder", "left").where(F.col("__anchor").isNull() | exempt).drop("__anchor")


#: Words of file names that tell nothing: of cameras and scans, of English, and extensions within a name; and the weight that makes a habit.
FILE_WORDS = (
    "img", "image", "dsc", "dscn", "dscf", "photo", "pic", "picture", "screenshot", "screen", "shot", "untitled", "new", "copy", "final", "draft", "version", "scan", "document", "file", "video", "vid", "clip",
    "the", "and", "for", "with", "from", "was", "are", "this", "that", "your", "our", "his", "her", "its", "out", "all", "has",
    "jpg", "jpeg", "png", "gif", "bmp", "heic", "heif", "tiff", "webp", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "mov", "mp4", "avi", "mkv", "mp3", "wav", "zip", "rar", "lps",
)
HABIT = 3


def file_tokens(stem: Column) -> Column:
    """Words of a file's name, repeats kept: three characters or more, one of them a letter, and not of FILE_WORDS."""
    return F.filter(tokens(stem), lambda t: (F.length(t) >= 3) & t.rlike(r"\p{L}") & ~t.isin(*FILE_WORDS))


def recorded_moves(moves: DataFrame) -> DataFrame:
    """(token, folder, weight) of applied moves (id, stem, folder), a weight of one for each token of each."""
    each = moves.where("folder <> ''").select("folder", F.explode(file_tokens(F.col("stem"))).alias("token"))
    return each.groupBy("token", "folder").agg(F.count(F.lit(1)).alias("weight"))


def boosted(moves: DataFrame, weights: DataFrame, least: int = HABIT) -> DataFrame:
    """Moves (id, stem, folder, confidence, ...) in which a review becomes auto where files of such names went to that folder before.

    folder: the last name of the destination's path; weights: (token, folder, weight). A move that is asked about stays so.
    """
    t = moves.where("confidence = 'review' AND folder <> ''").select("id", "folder", F.explode(file_tokens(F.col("stem"))).alias("token"))
    known = t.join(weights, ["token", "folder"]).groupBy("id").agg(F.sum("weight").alias("__w")).where(F.col("__w") >= least).select("id", F.lit(True).alias("__habit"))
    return moves.join(known, "id", "left").withColumn("confidence", F.when(F.col("__habit"), "auto").otherwise(F.col("confidence"))).drop("__habit")


def group_names(files: DataFrame, most: int = 2) -> DataFrame:
    """(group, name): words that mark a group, in title case: those of its files that few files of all have.

    files: (group, id, tokens), of all files; tokens: an array of words. A word's score is the share of the group's files
    that have it, times ln(files / files that have it); words of every file score nothing, and a group without others has
    a null name. Files without words do not count.

    Words are counted where a file's row is, so a count for each word and task is shuffled and not a row for each word and
    file. Only the words of ids that have several rows are made distinct over rows.
    """
    repeated = staged(files.groupBy(F.col("id").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of"))
    again = not repeated.isEmpty()
    some = lambda how: files.join(repeated, F.col("id").eqNullSafe(F.col("of")), how) if again else files
    words = lambda how: some(how).select("group", "id", F.posexplode(F.array_distinct("tokens")).alias("at", "token"))
    n, ids = F.count(F.lit(1)).alias("n"), F.count("id")
    # a file counts where the first of its words stands
    counts = staged(words("left_anti").groupBy("group", "token").agg(n, ids.alias("df"), F.count(F.when(F.col("at") == 0, F.col("id"))).alias("files")))
    tf, df = counts.select("group", "token", "n"), counts.select("token", "df")
    size = counts.groupBy("group").agg(F.sum("files").alias("size"))
    total = counts.select(F.sum("files").alias("total"))
    if again:
        several = staged(words("left_semi").select("group", "id", "token").distinct())
        files_of = several.select("group", "id").distinct()
        tf = tf.union(several.groupBy("group", "token").agg(n)).groupBy("group", "token").agg(F.sum("n").alias("n"))
        df = df.union(several.select("id", "token").distinct().groupBy("token").agg(ids.alias("df")))
        size = size.union(files_of.groupBy("group").agg(ids.alias("size"))).groupBy("group").agg(F.sum("size").alias("size"))
        total = total.union(files_of.agg(F.countDistinct("id").alias("total"))).agg(F.sum("total").alias("total"))
    df = df.groupBy("token").agg(F.sum("df").alias("df"))
    score = F.round(F.col("n") / F.nullif("size", F.lit(0)) * F.log(F.col("total") / F.nullif("df", F.lit(0))), 9)
    scored = tf.join(df, "token").join(size, "group").join(F.broadcast(total), F.lit(True)).withColumn("s", score).where("s > 0")
    r = F.row_number().over(Window.partitionBy("group").orderBy(F.col("s").desc(), "token"))
    best = scored.withColumn("r", r).where(F.col("r") <= most).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("r", "token"))).alias("words"))
    return size.join(best, "group", "left").select("group", F.array_join(F.transform("words", lambda x: F.initcap(x["token"])), " ").alias("name"))


def majority(votes: DataFrame, by: str, least: int = 3) -> DataFrame:
    """(by, vote): the choice of more than half of at least `least` votes."""
    each = votes.groupBy(by, "vote").agg(F.count(F.lit(1)).alias("n"))
    g = each.groupBy(by).agg(F.sum("n").alias("total"), F.max(F.struct("n", "vote")).alias("x"))
    return g.where((F.col("total") >= least) & (2 * F.col("x.n") > F.col("total"))).select(by, F.col("x.vote").alias("vote"))


def semantic_plan(files: DataFrame, vectors: DataFrame, folders: DataFrame, least: float, margin: float, alike: float) -> DataFrame:
    """(id, destination, why) for files with vectors.

    A file goes to the folder whose prototype (the mean of its members) is nearest, if near enough and clear of
    the second; a file that already is there stays. Others that are alike form groups (components of cosine
    pairs), named by the words that mark them. folders: (id, folder); vectors: (id, v).
    """
    from cairnlake.operators.graph import components
    from cairnlake.operators.similarity import cosine_forest, two_nearest

    member = vectors.join(folders, "id")
    numbered = folders.select("folder").distinct().select("folder", F.xxhash64("folder").alias("key"))
    prototypes = centroids(member.join(numbered, "folder").select("id", "v", "key"), "key").where("n >= 3")
    best = two_nearest(vectors, prototypes, "key").where((F.col("score") >= least) & (F.coalesce("margin", F.lit(2.0)) >= margin))
    routed = best.join(numbered.withColumnRenamed("key", "center"), "center").join(folders.withColumnRenamed("folder", "here"), "id", "left")
    routed = routed.where(F.col("here").isNull() | (F.col("here") != F.col("folder"))).select("id", F.col("folder").alias("destination"), F.lit("prototype").alias("why"))
    rest = vectors.join(best.select("id"), "id", "left_anti")
    groups = components(cosine_forest(rest, alike)).select(F.col("node").alias("id"), F.col("component").alias("group"))
    tokens = files.select("id", F.regexp_extract_all(F.lower("stem"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    words = tokens.join(groups, "id", "left").select(F.coalesce("group", F.lit(-1)).alias("group"), "id", "tokens")
    named = groups.join(group_names(words, 2), "group", "left")
    return routed.unionByName(named.select("id", F.concat(F.lit("New/"), F.coalesce("name", F.lit("group"))).alias("destination"), F.lit("group").alias("why")))


def signatures(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, v): files as normalised multi-hot vectors over a vocabulary (token, i) of a few hundred words."""
    size = vocabulary.count()
    hot = tokens.join(F.broadcast(vocabulary), "token").groupBy("id").agg(F.collect_set("i").alias("on"))
    one = lambda i: F.when(F.array_contains("on", i), 1.0 / F.sqrt(F.size("on"))).otherwise(0.0)
    return hot.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one).alias("v"))


#: Extensions of roles, and words of folder names that ask for one.
RAW_EXTENSIONS = "arw cr2 cr3 crw nef nrw dng raf orf rw2 pef srw x3f 3fr iiq rwl erf mef mos srf sr2".split()
JPEG_EXTENSIONS = "jpg jpeg jpe heic heif png tif tiff webp".split()
ROLE_WORDS = {"raw": "raw raws".split(), "jpeg": "jpeg jpegs jpg jpgs".split(), "video": "video videos movies clips footage".split(), "photo": "photo photos pictures images stills".split()}
MONTHS = "January February March April May June July August September October November December".split()


def folder_role(name: Column) -> Column:
    """What a folder's name says it holds: raw, jpeg, video, photo, or null."""
    words = F.split(F.lower(name), r"[^\p{L}]+")
    out = None
    for role, of in ROLE_WORDS.items():
        out = (F if out is None else out).when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in of])), role)
    return out


def file_role(kind: Column, extension: Column) -> Column:
    """What a file is to such folders; a photo if nothing else."""
    e = F.lower(extension)
    return F.when(e.isin(RAW_EXTENSIONS), "raw").when(kind == "video", "video").when(e.isin(JPEG_EXTENSIONS), "jpeg").otherwise("photo")


def fits(file: Column, folder: Column) -> Column:
    """Whether a file belongs in a folder of a role; a folder without one takes all, one for photos all but videos."""
    return folder.isNull() | (folder == file) | ((folder == "photo") & (file != "video"))


#: Names of folders that files are taken out of, and first words that mark such a folder.
JUNK_NAMES = ("downloads", "downloaded", "desktop", "new folder", "untitled", "temp", "tmp", "misc", "other", "stuff", "things", "files", "unsorted", "inbox")
JUNK_WORDS = ("desktop", "downloads", "download", "downloaded", "temp", "tmp", "unsorted", "inbox", "misc")


def junk_prototype(name: Column) -> Column:
    """Folder names that cannot stand for a subject: dumps by name or first word, and numbers that are no year from 1900 to 2099."""
    low = F.lower(name)
    number = low.rlike(r"^[0-9]+$") & ~low.rlike(r"^(19|20)[0-9]{2}$")
    return low.isin(*JUNK_NAMES) | number | F.regexp_extract(low, r"^\P{IsAlphabetic}*(\p{IsAlphabetic}+)", 1).isin(*JUNK_WORDS)


def components(path: Column, root: str, last: bool = False) -> Column:
    """Names of the folders below root, outermost first; the last part is a file's name unless `last`."""
    parts = F.filter(F.split(F.substring(path, F.lit(len(root) + 1), F.length(path)), "/"), lambda x: x != "")
    own = parts if last else F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(path.startswith(root), own).otherwise(F.array().cast("array<string>"))


def respected(moves: DataFrame, root: str) -> DataFrame:
    """Of moves (path, destination, kind, extension) those that respect what is organised.

    A file below a folder of a telling name moves only to correct its format: to a sibling folder that fits its
    role where its own does not. Others move where the last folder fits their role, and every folder is one that
    they are in, has a usable name or a role, or is a month or year. destination: folders below root.
    """
    source, to = components(F.col("path"), root), components(F.concat(F.lit(root + "/"), F.col("destination")), root, last=True)
    role = file_role(F.col("kind"), F.col("extension"))
    end = lambda x: F.get(x, F.size(x) - 1)
    above = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
    organised = F.exists(source, lambda f: ~generic_folder(f))
    there = folder_role(end(to))
    corrects = (F.size(source) == F.size(to)) & (F.size(source) >= 2) & (above(source) == above(to)) & there.isNotNull() & ~fits(role, folder_role(end(source))) & fits(role, there)
    dated = lambda f: f.rlike(r"^[0-9]{4}$") | f.isin(MONTHS)
    known = F.forall(to, lambda f: F.array_contains(source, f) | usable_folder(f) | folder_role(f).isNotNull() | dated(f))
    return moves.where(F.when(organised, corrects).otherwise(fits(role, there) & known))


def folder_prototypes(files: DataFrame, vectors: DataFrame, least: int) -> DataFrame:
    """(folder, n, centroid, tokens): the mean direction of each folder's vectors, with the words of its name and of its files' names.

    files: (id, folder, stem); vectors: (id, v). Folders with fewer than `least` vectors have no prototype.
    """
    member = vectors.select("id", "v").join(files.select("id", "folder", "stem"), "id")
    centers = centroids(member, "folder").where(F.col("n") >= least)
    words = member.select("folder", F.explode(name_tokens(F.col("stem"))).alias("t")).union(member.select("folder", F.explode(name_tokens(base_name(F.col("folder"))))))
    tokens = words.groupBy("folder").agg(F.array_sort(F.collect_set("t")).alias("tokens"))
    return centers.join(tokens, "folder", "left").select("folder", "n", "centroid", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def reply_fields(reply: Column, schema: str) -> Column:
    """Fields of a JSON reply, taken between its first and last brace; null where it does not parse."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def store_plan(moves: DataFrame, path: str) -> None:
    """P10: write moves (id, source, destination, category, confidence) by confidence, in order of ids, for paging."""
    moves.repartitionByRange("confidence", "id").sortWithinPartitions("id").write.mode("overwrite").partitionBy("confidence").parquet(path)


def plan_page(plan: DataFrame, confidence: str, after: int, limit: int) -> DataFrame:
    """P10: the next page of a stored plan: one confidence's files alone are read, and of those the ids that follow."""
    return plan.where((F.col("confidence") == confidence) & (F.col("id") > after)).orderBy("id").limit(limit)


def checked_plan(plan: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """P10: (id, verdict) of a stored plan against the files as they are now: missing, moved (its path changed), noop, outside
    (of the root), taken (a file that does not move is there), clash (another move goes there), or ok."""
    now = files.select("id", F.col("path").alias("now"))
    j = plan.select("id", "source", "destination").join(now, "id", "left")
    staying = files.select("id", F.lower("path").alias("to")).join(plan.select("id"), "id", "left_anti").select("to").distinct().withColumn("there", F.lit(True))
    many = plan.groupBy(F.lower("destination").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    j = j.withColumn("to", F.lower("destination")).join(staying, "to", "left").join(many, "to")
    verdict = (
        F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("source"), "moved").when(F.lower("source") == F.col("to"), "noop")
        .when(~F.col("destination").startswith(root.rstrip("/") + "/") | F.col("destination").contains("/../"), "outside").when(F.col("there"), "taken").when(F.col("n") > 1, "clash").otherwise("ok")
    )
    return j.select("id", verdict.alias("verdict"))
