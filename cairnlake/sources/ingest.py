"""What changes when files are scanned again, as table-to-table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGES = {"tags": 1, "text": 2, "scan_text": 4}


def skip_set(files: DataFrame, found: DataFrame, vectors: DataFrame, gave_up: DataFrame, limit: int = 3) -> DataFrame:
    """Paths that need no new scan: unchanged size and time (to a microsecond), hash and vector present; or given up.

    files, found: (path, id | -, size_bytes, modified_at, ...); vectors: (id); gave_up: (path, attempts).
    """
    f = found.select("path", F.col("size_bytes").alias("__size"), F.col("modified_at").alias("__time"))
    same = files.join(f, "path").where((F.col("size_bytes") == F.col("__size")) & (F.abs(F.col("modified_at") - F.col("__time")) < 1e-6))
    done = same.where("content_hash IS NOT NULL").join(vectors.select("id"), "id", "left_semi").select("path")
    return done.union(gave_up.where(F.col("attempts") >= limit).select("path")).distinct()


def placeholders(files: DataFrame) -> DataFrame:
    """Recorded files whose bytes are not here."""
    return files.where(F.col("content_hash").isNull() & F.col("kind").isin("image", "video", "pdf"))


def moved(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_path): new files that are old ones under another path: same hash and size, the nearest time, one to one."""
    n = new.select(F.col("path").alias("new_path"), F.col("content_hash").alias("h"), F.col("size_bytes").alias("s"), F.col("modified_at").alias("t"))
    pairs = gone.join(n, (F.col("content_hash") == F.col("h")) & (F.col("size_bytes") == F.col("s")))
    order = [F.abs(F.col("modified_at") - F.col("t"))]
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order, "new_path"))).withColumn("q", F.row_number().over(Window.partitionBy("new_path").orderBy(*order, "id")))
    return first.where("r = 1 AND q = 1").select(F.col("id").alias("old_id"), "new_path")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old_when_null: list[str], stage_ran: Column | None = None, staged_columns: tuple[str, ...] = ()) -> DataFrame:
    """Old rows updated by new ones: listed columns keep the old value where the new is null; staged ones change only if the stage ran."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, key, "full_outer")
    out = [F.col(key)]
    ran = F.lit(True) if stage_ran is None else F.coalesce(stage_ran, F.lit(False))
    for c in old.columns:
        if c == key:
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        here = F.col("n.__here").isNotNull()
        value = F.coalesce(b, a) if c in keep_old_when_null else F.when(ran, b).otherwise(a) if c in staged_columns else b
        out.append(F.when(here, value).otherwise(a).alias(c))
    return both.select(*out)


def with_presence(new: DataFrame) -> DataFrame:
    return new.withColumn("__here", F.lit(True))


def twin_copy(files: DataFrame, donors: DataFrame) -> DataFrame:
    """(id, donor): for files without a description the best donor of equal content: one with a vector, then the lowest id."""
    d = donors.where("trim(coalesce(description, '')) <> ''").groupBy("content_hash").agg(F.max(F.struct("has_vector", (-F.col("id")).alias("back"))).alias("x"))
    need = files.where("trim(coalesce(description, '')) = ''").select("id", "content_hash")
    return need.join(d, "content_hash").select("id", (-F.col("x.back")).alias("donor"))


def soft_hide(files: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """(id): files under a scanned root that the scan did not see."""
    return files.where((F.col("path") >= f"{root}/") & (F.col("path") < f"{root}0")).join(seen.select("path"), "path", "left_anti").select("id")


def purge(files: DataFrame, now: float, days: float = 30.0) -> DataFrame:
    """(id): failed files older than the retention; times in the future are a wrong clock and stay."""
    age = F.lit(now) - F.col("modified_at")
    return files.where((F.col("failed") == 1) & (age > days * 86400) & (F.col("modified_at") <= now)).select("id")


def backlog(faces: DataFrame, current: int, limit: int) -> DataFrame:
    """The next ids whose processing is outdated."""
    return faces.where(F.col("version") < current).orderBy("id").limit(limit).select("id")


def seeded_backlog(backlog: DataFrame, outdated: DataFrame, model: str, processing: str) -> DataFrame:
    """The backlog (face_id, model, processing, state, attempts, reason) with the work that one model and processing owes.

    outdated: (face_id). New ones are pending; of rows that are there, those whose file was missing or offline or that
    failed are tried again, and done ones are opened again where they are outdated once more. Rows of others stay.
    """
    ours = (F.col("model") == model) & (F.col("processing") == processing)
    due = outdated.select("face_id").distinct()
    new = due.join(backlog.where(ours).select("face_id"), "face_id", "left_anti")
    new = new.select("face_id", F.lit(model).alias("model"), F.lit(processing).alias("processing"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("reason"))
    again = F.col("state").isin("missing", "offline", "failed") | ((F.col("state") == "done") & F.col("__due"))
    old = backlog.join(due.withColumn("__due", F.lit(True)), "face_id", "left").withColumn("state", F.when(ours & F.coalesce(again, F.lit(False)), "pending").otherwise(F.col("state"))).drop("__due")
    return old.select("face_id", "model", "processing", "state", "attempts", "reason").unionByName(new)


def snapshot(tables: dict[str, DataFrame], column: str, value: int) -> DataFrame:
    """(name, row): the rows of one file in every table, as JSON."""
    out = None
    for name, df in tables.items():
        one = df.where(F.col(column) == value).select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = one if out is None else out.union(one)
    return out


def restore(rows: DataFrame, name: str, into: DataFrame, keys: list[str]) -> DataFrame:
    """A table with snapshot rows that it lacks put back."""
    back = rows.where(F.col("name") == name).select(F.from_json("row", into.schema).alias("r")).select("r.*")
    return into.union(back.join(into, keys, "left_anti").select(*into.columns))


def owed(mask: Column, stage: str) -> Column:
    """Whether a file still owes a stage."""
    return mask.bitwiseAND(F.lit(STAGES[stage])) != 0


def zero_bytes(files: DataFrame) -> DataFrame:
    """Empty files, to be recorded as failed."""
    return files.where("size_bytes = 0").select("id", "path", F.lit(1).alias("failed"))
