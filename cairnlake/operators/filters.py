"""Composable file filters, folded into one predicate with semi and anti joins for people."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANALYZABLE = ("image", "video", "pdf", "doc", "audio")


def taken() -> Column:
    """The capture time of a file: created, else modified."""
    return F.coalesce(F.col("created_at"), F.col("modified_at"))


def moment(seconds: Column) -> Column:
    """Epoch seconds as a UTC timestamp."""
    return F.timestamp_seconds(seconds)


def under(path: Column, root: str) -> Column:
    """half-open prefix range of a subtree, which Parquet statistics can prune: [root/, root0)."""
    return (path >= f"{root}/") & (path < f"{root}0")


@dataclass(frozen=True)
class Filter:
    """What a question asks of files. Empty fields ask nothing; byte bounds are exclusive; months are 1 to 12."""

    kinds: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    any_people: tuple[int, ...] = ()
    all_people: tuple[int, ...] = ()
    no_people: tuple[int, ...] = ()
    above_bytes: int | None = None
    below_bytes: int | None = None
    ids: tuple[int, ...] | None = None
    start: float | None = None
    end: float | None = None
    months: tuple[int, ...] = ()
    day: tuple[int, int] | None = None
    folder: str | None = None
    root: str | None = None
    undescribed: bool = False

    def predicate(self) -> Column:
        """The part that needs no other table."""
        kinds = self.kinds or (ANALYZABLE if self.undescribed else ())
        out = F.lit(True)
        if kinds:
            out &= F.col("kind").isin(*kinds)
        if self.extensions:
            out &= F.lower("extension").isin(*[x.lower() for x in self.extensions])
        if self.above_bytes is not None:
            out &= F.col("size_bytes") > self.above_bytes
        if self.below_bytes is not None:
            out &= F.col("size_bytes") < self.below_bytes
        if self.ids is not None:
            out &= F.col("id").isin(*self.ids) if self.ids else F.lit(False)
        if self.start is not None:
            out &= taken() >= self.start
        if self.end is not None:
            out &= taken() < self.end
        if self.months:
            out &= F.month(moment(taken())).isin(*self.months)
        if self.day:
            out &= (F.month(moment(taken())) == self.day[0]) & (F.dayofmonth(moment(taken())) == self.day[1])
        if self.folder:
            path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
            out &= F.lower(path).contains(f"/{self.folder.lower()}/") | path.startswith(self.folder)
        if self.root:
            out &= under(F.col("path"), self.root)
        if self.undescribed:
            out &= F.coalesce(F.trim("description"), F.lit("")) == ""
        return out

    def apply(self, files: DataFrame, faces: DataFrame | None = None) -> DataFrame:
        """Files that pass; people are matched by faces (file_id, person_id)."""
        out = files.where(self.predicate())
        seen = faces.where("person_id IS NOT NULL").select(F.col("file_id").alias("id"), "person_id") if faces is not None else None
        if seen is None and (self.any_people or self.all_people or self.no_people):
            raise ValueError("people need a table of faces")
        if self.any_people:
            out = out.join(seen.where(F.col("person_id").isin(*self.any_people)).select("id").distinct(), "id", "left_semi")
        if self.all_people:  # relational division: all of them in one grouped count
            wanted = seen.where(F.col("person_id").isin(*self.all_people)).groupBy("id").agg(F.countDistinct("person_id").alias("n"))
            out = out.join(wanted.where(F.col("n") == len(set(self.all_people))), "id", "left_semi")
        if self.no_people:
            out = out.join(seen.where(F.col("person_id").isin(*self.no_people)).select("id"), "id", "left_anti")
        return out


def owned_by_root(files: DataFrame, root: str, roots: list[str]) -> DataFrame:
    """a root's files without those of roots nested in it; the most specific root owns a file."""
    out = files.where(under(F.col("path"), root))
    for other in roots:
        if other != root and other.startswith(f"{root}/"):
            out = out.where(~under(F.col("path"), other))
    return out


def check_request(mode: str, limit: int, text: str | None, vector: list[float] | None, dims: int) -> None:
    """what a search request must look like."""
    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError("unknown mode")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    if mode != "vector" and not (text or "").strip():
        raise ValueError("text is needed")
    if mode != "keyword" and (vector is None or len(vector) != dims):
        raise ValueError(f"a vector of {dims} numbers is needed")
