"""Counts, totals, breakdowns and listings of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.operators.filters import moment, taken
from cairnlake.session import staged


def totals(files: DataFrame) -> DataFrame:
    """How many files, how many bytes."""
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def counts_by(files: DataFrame, by: Column, name: str) -> DataFrame:
    """Files and bytes by a value."""
    return files.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def by_period(files: DataFrame, pattern: str) -> DataFrame:
    """Files and bytes by year or month of capture."""
    return counts_by(files, F.date_format(moment(taken()), pattern), "period")


def capture_range(files: DataFrame) -> DataFrame:
    """First and last capture day."""
    day = lambda x: F.date_format(moment(x), "yyyy-MM-dd")
    return files.agg(day(F.min(taken())).alias("first_day"), day(F.max(taken())).alias("last_day"))


def overview(files: DataFrame) -> DataFrame:
    """Q05: files, bytes, folders and kinds in one pass."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.countDistinct("folder").alias("folders"), F.countDistinct("kind").alias("kinds"))


def folder_totals(files: DataFrame) -> DataFrame:
    """Files and bytes by folder, with the shortest ending of two parts or more that names it alone."""
    by = counts_by(files, F.col("folder"), "folder")
    parts = by.select("folder", F.filter(F.split("folder", "/"), lambda x: x != "").alias("parts"))
    depth = F.explode(F.sequence(F.least(F.lit(2), F.size("parts")), F.least(F.lit(7), F.size("parts")))).alias("depth")
    labels = parts.select("folder", "parts", depth).select("folder", "depth", F.array_join(F.slice("parts", -F.col("depth"), F.col("depth")), "/").alias("label"))
    alone = labels.groupBy("depth", "label").agg(F.count(F.lit(1)).alias("n"), F.min("folder").alias("folder")).where("n = 1")
    best = alone.groupBy("folder").agg(F.min_by("label", "depth").alias("label"))
    return by.join(best, "folder", "left").select("folder", F.coalesce("label", "folder").alias("label"), "n", "bytes")


def listing(files: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of files, newest, oldest, largest or smallest first; unknown times last, ties by id."""
    by = {
        "newest": [taken().desc_nulls_last(), F.col("id").asc()], "oldest": [taken().asc_nulls_last(), F.col("id").asc()],
        "largest": [F.col("size_bytes").desc(), F.col("id").asc()], "smallest": [F.col("size_bytes").asc(), F.col("id").asc()],
    }[order]
    return files.orderBy(*by).offset(offset).limit(limit)


def keyset_page(files: DataFrame, after: int, limit: int) -> DataFrame:
    """The next page by id, without counting what came before."""
    return files.where(F.col("id") > after).orderBy("id").limit(limit)


#: Folder names that mark a folder as junk whatever it holds.
GENERIC_FOLDERS = ("downloads", "downloaded", "desktop", "unsorted", "inbox", "new folder", "untitled", "temp", "tmp", "misc", "other", "stuff", "things", "files")


def folder_tiers(moves: DataFrame, library_root: str | None = None) -> DataFrame:
    """Tiers of folders from (folder, category): junk by a generic name or with two moves or fewer, anchor where one category has 80 %, else mixed.

    The library's root is never an anchor; letter case does not matter to it.
    """
    each = moves.groupBy("folder", "category").agg(F.count(F.lit(1)).alias("n"))
    by = each.groupBy("folder").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    generic = F.lower(F.regexp_extract("folder", r"([^/\\]*)[/\\]*$", 1)).isin(*GENERIC_FOLDERS)
    root = F.lower("folder") == library_root.lower() if library_root is not None else F.lit(False)
    tier = F.when(generic | (F.col("n") <= 2), "junk").when(~root & (F.col("top") / F.col("n") >= 0.8), "anchor").otherwise("mixed")
    return by.select("folder", "n", tier.alias("tier"))


def rank_percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """The value at index round((n - 1) * p) of the sorted values; ranks by one window over counts of values, not over rows."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy(column)))
    n = counts.agg(F.sum("c").alias("n")).withColumn("one", F.lit(1))
    return upto.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").where(F.col("upto") > F.round((F.col("n") - 1) * p)).agg(F.min(column).alias("value"))


def pending_names(files: DataFrame, limit: int) -> DataFrame:
    """Files with a proposed name (id, path, proposed, analysed_at), newest analysed first."""
    return files.where("proposed IS NOT NULL AND proposed <> ''").orderBy(F.col("analysed_at").desc(), "id").limit(limit).select("id", "path", "proposed")


def timeline_tracks(coverage: DataFrame, passages: DataFrame, limit: int) -> DataFrame:
    """(file_id, track, start, end): examined spans and speech of files, `limit` of a track each, in order.

    coverage: file_id, id, status, start, end; passages: file_id, id, stale, start, end.
    """
    examined = coverage.where("status IN ('sampled', 'verified') AND NOT startswith(id, 'speech:')").select("file_id", F.lit("examined").alias("track"), "start", "end")
    speech = passages.where("NOT stale AND startswith(id, 'speech:') AND start IS NOT NULL").select("file_id", F.lit("speech").alias("track"), "start", F.coalesce("end", "start").alias("end"))
    r = F.row_number().over(Window.partitionBy("file_id", "track").orderBy("start", "end"))
    return examined.unionByName(speech).withColumn("r", r).where(F.col("r") <= limit).drop("r")


def active_faces(faces: DataFrame, files: DataFrame) -> DataFrame:
    """Faces that are not excluded, of active files."""
    return faces.where("excluded = 0").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def people_list(persons: DataFrame, faces: DataFrame, best: str) -> DataFrame:
    """(id, name, files, faces, anchor) of people with active faces.

    The anchor is the stored pick (persons.pick) while it is an active face of the person, else the face of best
    quality or of the lowest id (`best`: quality, lowest); ties go to the lowest id.
    """
    key = F.struct(F.coalesce("quality", F.lit(0.0)).alias("q"), (-F.col("face")).alias("back")) if best == "quality" else F.struct((-F.col("face")).alias("back"))
    f = faces.select(F.col("person_id").alias("id"), F.col("id").alias("face"), "file_id", "quality")
    each = f.groupBy("id").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("faces"), (-F.max(key)["back"]).alias("other"))
    pick = persons.select("id", F.col("pick").alias("face")).join(f.select("id", "face"), ["id", "face"], "left_semi").withColumnRenamed("face", "picked")
    return persons.join(each, "id").join(pick, "id", "left").select("id", "name", "files", "faces", F.coalesce("picked", "other").alias("anchor"))


def faces_of(person: int, faces: DataFrame, files: DataFrame, limit: int = 500) -> DataFrame:
    """(face, file_id, path) of a person, newest file first."""
    j = faces.where((F.col("person_id") == person) & (F.col("excluded") == 0)).select(F.col("id").alias("face"), "file_id").join(files.select(F.col("id").alias("file_id"), "path", "modified_at"), "file_id")
    return j.orderBy(F.col("modified_at").desc(), "face").limit(limit).select("face", "file_id", "path")


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with `rank` from 0 in an order, by range partitions and the numbers of rows before them: no task sorts all rows."""
    ranged = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sums = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    found = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    return found.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


#: Tags that tell nothing of a file's content.
SUPPRESSED_TAGS = ("image", "photo", "picture", "photography", "shot", "view", "object", "item", "background", "foreground", "indoor", "outdoor")


def display_tags(tags: DataFrame, most: int) -> DataFrame:
    """(file_id, tag, r): the first `most` tags to show of each file: those of users, then of descriptions, then of models, by score.

    tags: (file_id, tag, source, score). Only these three sources count; tags that tell nothing are left out, and those
    alike but for letter case count once.
    """
    tag = F.trim("tag")
    some = tags.where(F.col("source").isin("auto", "user", "vlm") & (tag != "") & ~F.lower(tag).isin(*SUPPRESSED_TAGS))
    pri = F.when(F.col("source") == "user", 0).when(F.col("source") == "vlm", 1).otherwise(2)
    order = [F.col("pri"), F.coalesce("score", F.lit(0.0)).desc(), F.col("tag")]
    ranked = some.select("file_id", tag.alias("tag"), pri.alias("pri"), "score")
    one = ranked.withColumn("k", F.row_number().over(Window.partitionBy("file_id", F.lower("tag")).orderBy(*order))).where("k = 1")
    return one.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)).cast("long")).where(F.col("r") <= most).select("file_id", "tag", "r")
