"""The catalog's tables bound to the driver's input tables, as DataFrames and as DuckDB SQL.

Nothing is inferred: every binding is a projection of known columns. BASE_SQL defines the same tables for the
oracle, so a query and its SQL read the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions.text import visible_text
from cairnlake.session import table, written

#: File kinds by extension.
KINDS = {
    "image": "jpg jpeg png gif webp heic heif tif tiff bmp arw cr2 cr3 nef dng raf orf rw2".split(),
    "video": "mp4 mov m4v avi mkv webm".split(),
    "audio": "mp3 m4a wav flac aac ogg".split(),
    "pdf": ["pdf"],
    "doc": "txt md rtf doc docx odt pages html htm epub csv xlsx pptx".split(),
    "model": "obj stl gltf glb fbx".split(),
}


def kind_of(extension: Column) -> Column:
    """The kind of a file by its extension; 'other' for what is not listed."""
    out = None
    e = F.lower(extension)
    for kind, extensions in KINDS.items():
        out = (F if out is None else out).when(e.isin(extensions), kind)
    return out.otherwise("other")


def sign_hash(v: Column, dims: int = 64) -> Column:
    """64 bits, bit i set where a vector's value is above its next one (the last one's next is the first)."""
    powers = F.array(*[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint") for i in range(dims)])
    bit = lambda i: F.when(F.get(v, i) > F.get(v, (i + 1) % dims), F.get(powers, i)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(dims - 1)), F.lit(0).cast("bigint"), lambda h, i: h.bitwiseOR(bit(i)))


class Catalog:
    """Lazy DataFrames over one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def all_files(self) -> DataFrame:
        """Files without their text, failed ones too: derived once and written by kind, so filters reach the files and hashes are kept."""
        return written(self.spark, "files", self.documents_path, lambda: self._with_text(F.sha2("text", 256).alias("content_hash")).drop("text"), "kind")

    @cached_property
    def texts(self) -> DataFrame:
        """Active files with their text."""
        return self._with_text().where("failed = 0")

    @property
    def documents_path(self) -> str:
        return f"{self.sf_dir}/documents.parquet"

    def _with_text(self, *more: Column) -> DataFrame:
        i = F.col("doc_id")
        extension = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "JPG", "arw", "mp4", "mov", "pdf", "docx", "mp3", "txt", "xyz")]), (i % 10 + 1).cast("int"))
        stem = (
            F.when(i % 4 == 0, F.concat(F.lit("IMG_"), F.lpad((i % 500).cast("string"), 4, "0"))).when(i % 4 == 1, F.concat(F.lit("Trip Paris "), i.cast("string")))
            .when(i % 4 == 2, F.concat(F.lit("report-"), i.cast("string"))).otherwise(F.concat(F.col("lang"), F.lit("_notes"), i.cast("string")))
        )
        folder = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("lang"))
        return self.table("documents").select(
            i.alias("id"), folder.alias("folder"), stem.alias("stem"), extension.alias("extension"),
            F.concat(folder, F.lit("/"), stem, F.lit("."), extension).alias("path"), kind_of(extension).alias("kind"),
            F.col("n_chars").alias("size_bytes"), *more,
            F.when(i % 7 != 0, F.lit(1672531200.0) + (i * 7919 % 31536000).cast("double")).alias("created_at"),
            (F.lit(1704067200.0) + i.cast("double") * 60).alias("modified_at"),
            F.when(i % 8 != 0, (i * 37 % 101).cast("double") / 100).alias("quality"),
            F.when(i % 19 == 0, 1).otherwise(0).alias("failed"),
            F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 5 == 1, "").when(i % 5 == 2, "  ").otherwise(F.substring("text", 1, 80)).alias("description"),
            F.when(i % 6 == 0, "Canon EOS R5").when(i % 6 == 1, "Apple iPhone 13").when(i % 6 == 2, "NIKON Z 6").alias("camera"),
            F.when(i % 3 == 0, (i % 200).cast("double") - 95 + 0.3).alias("lat"), F.when(i % 3 == 0, (i * 3 % 400).cast("double") - 195 + 0.3).alias("lon"),
            F.col("lang"), F.col("source"), F.col("text"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """active files."""
        return self.all_files.where("failed = 0")

    @cached_property
    def tags(self) -> DataFrame:
        """(file_id, tag, source, score), unique by the first three."""
        e = self.table("events")
        source = F.when(F.col("event_id") % 3 == 0, "user").when(F.col("event_id") % 3 == 1, "vlm").otherwise("clip")
        return e.groupBy((F.col("event_id") % 1000).alias("file_id"), F.col("event_type").alias("tag"), source.alias("source")).agg(F.max("value").alias("score"))

    @cached_property
    def faces(self) -> DataFrame:
        e, i = self.table("embeddings"), F.col("vec_id")
        return e.select(
            i.alias("id"), (i % 200).alias("file_id"), F.when(i % 11 != 0, F.col("label").cast("bigint")).alias("person_id"),
            ((i * 13 % 97).cast("double") / 96).alias("quality"), F.when(i % 13 == 0, 1).otherwise(0).alias("excluded"), F.col("embedding").alias("v"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        n = self.table("nation")
        k = F.col("n_nationkey").cast("bigint")
        return n.where("n_nationkey < 10").select(k.alias("id"), F.when(k % 4 != 3, F.initcap("n_name")).alias("name"), F.when(k == 9, 1).otherwise(0).alias("is_unknown"))

    @cached_property
    def vectors(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), sign_hash(F.col("embedding")).alias("phash"))

    @cached_property
    def signals(self) -> DataFrame:
        """(id, user, seconds, value, kind): a timeline per user."""
        seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), seconds.alias("seconds"), "value", F.col("event_type").alias("kind"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages").select("page_id", "url", visible_text(F.col("html")).alias("text"))


_EXT = "CASE doc_id % 10 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'arw' WHEN 3 THEN 'mp4' WHEN 4 THEN 'mov' WHEN 5 THEN 'pdf' WHEN 6 THEN 'docx' WHEN 7 THEN 'mp3' WHEN 8 THEN 'txt' ELSE 'xyz' END"
_KIND = "CASE WHEN lower(extension) IN ('jpg', 'arw') THEN 'image' WHEN extension IN ('mp4', 'mov') THEN 'video' WHEN extension = 'mp3' THEN 'audio' WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('txt', 'docx') THEN 'doc' ELSE 'other' END"
BASE_SQL = f"""
WITH RECURSIVE files0 AS (
  SELECT doc_id AS id, '/lib/' || source || '/' || lang AS folder, {_EXT} AS extension,
    CASE doc_id % 4 WHEN 0 THEN 'IMG_' || lpad((doc_id % 500)::VARCHAR, 4, '0') WHEN 1 THEN 'Trip Paris ' || doc_id
      WHEN 2 THEN 'report-' || doc_id ELSE lang || '_notes' || doc_id END AS stem,
    n_chars AS size_bytes, sha256(text) AS content_hash,
    CASE WHEN doc_id % 7 <> 0 THEN 1672531200.0::DOUBLE + (doc_id * 7919 % 31536000)::DOUBLE END AS created_at,
    1704067200.0::DOUBLE + doc_id::DOUBLE * 60 AS modified_at,
    CASE WHEN doc_id % 8 <> 0 THEN (doc_id * 37 % 101)::DOUBLE / 100 END AS quality,
    CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS failed,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE substr(text, 1, 80) END AS description,
    CASE doc_id % 6 WHEN 0 THEN 'Canon EOS R5' WHEN 1 THEN 'Apple iPhone 13' WHEN 2 THEN 'NIKON Z 6' END AS camera,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id % 200)::DOUBLE - 95 + 0.3::DOUBLE END AS lat,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id * 3 % 400)::DOUBLE - 195 + 0.3::DOUBLE END AS lon, lang, source, text
  FROM documents
), all_files AS (
  SELECT *, folder || '/' || stem || '.' || extension AS path, {_KIND} AS kind FROM files0
), files AS (SELECT * FROM all_files WHERE failed = 0
), tags AS (
  SELECT event_id % 1000 AS file_id, event_type AS tag, CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'vlm' ELSE 'clip' END AS source, max(value) AS score
  FROM events GROUP BY 1, 2, 3
), faces AS (
  SELECT vec_id AS id, vec_id % 200 AS file_id, CASE WHEN vec_id % 11 <> 0 THEN label::BIGINT END AS person_id, (vec_id * 13 % 97)::DOUBLE / 96 AS quality,
    CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS excluded, embedding::DOUBLE[] AS v FROM embeddings
), persons AS (
  SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 4 <> 3 THEN array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS name,
    CASE WHEN n_nationkey = 9 THEN 1 ELSE 0 END AS is_unknown FROM nation WHERE n_nationkey < 10
), vectors0 AS (SELECT vec_id AS id, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings
), vectors AS (
  SELECT id, label, v, list_reduce(list_transform(range(64), lambda i: CASE WHEN v[i + 1] > v[(i + 1) % 64 + 1] THEN CASE WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << i::INTEGER) END ELSE 0::BIGINT END), lambda a, b: a + b) AS phash FROM vectors0
), signals AS (
  SELECT event_id AS id, user_id AS "user", epoch_us(ts)::DOUBLE / 1e6 AS seconds, value, event_type AS kind FROM events
), messages AS (SELECT conv_id AS conv, turn, role, text FROM conversations)
"""
