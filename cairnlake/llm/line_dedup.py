"""Line dedup by winnowing: runs of lines that an earlier document, or the same one, already had are deleted.

Lines with a word are hashed. Of every `run` consecutive hashes the least (the rightmost of equals) is a
fingerprint, so any repeated run of that length shares one; only these window minima become rows, each with the
windows it stands for, up to run - 1 lines to either side. Fingerprints met once are dropped; around each shared
one the match is extended both ways: its windows are matched on all their lines, by two 64-bit hashes of
each line. A window that is not the first of its kind, by document and position, is a repeat; overlapping
repeats form maximal runs, which are deleted with the blank lines inside them. Everything is a Spark
expression. Every fingerprint and window is aggregated before a shuffle, and the rows of each meet its one
verdict in SALTS parts, so a line in a third of all documents is never one task's work.

Defined results: a null text counts as empty and stays null; texts with fewer than `run` lines with words
stay as they are, unless `words` is given: then a repeat of fewer lines that hold so many words counts too,
and so does a later copy of a whole text of fewer lines; documents are ordered by key, null last, then by text; rows equal in key and text are one
document and are treated alike; an empty table gives no rows; other columns are passed through, and names
that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.llm.common import WORD_SQL
from cairnlake.session import staged, table

#: Lines with words that a repeated run has at least.
RUN = 4
#: Parts into which the rows of one fingerprint or window are dealt where they meet its verdict.
SALTS = 8
#: Words that make a shorter repeat count, where dedup_lines is given them.
PASSAGE = 50


def _bind(x: Column, f) -> Column:
    """f(x), with x computed once a row."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _windows(text: Column, run: int, words: int | None = None) -> Column:
    """Array of (fp, ws): each fingerprint of a text and the windows it stands for, with their keys and first and last line.

    With `words` also shorter windows that hold so many words, and a text of fewer than `run` lines as a whole.
    """
    lines = F.split(text, "\n", -1)
    counted = lambda x: [F.regexp_count(x, F.lit(WORD_SQL)).alias("n")] if words else []
    named = F.filter(
        F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), i.alias("at"), *counted(x)))),
        lambda x: x.isNotNull(),
    )

    def of(named: Column) -> Column:
        def keyed(part: Column, *kind: Column) -> Column:
            return F.struct(
                F.xxhash64(*kind, F.transform(part, lambda x: x["h"])).alias("a"), F.xxhash64(F.lit(1), *kind, F.transform(part, lambda x: x["g"])).alias("b"),
                F.element_at(part, 1)["at"].alias("s"), F.element_at(part, -1)["at"].alias("e"),
            )

        def window(j: Column) -> Column:
            part = F.slice(named, j + 1, F.lit(run))
            # the least hash; of equals the last: positions count down
            least = F.array_min(F.transform(part, lambda x: F.struct(x["h"].alias("h"), (-x["at"]).alias("back"))))
            return F.struct(least.alias("fp"), keyed(part).alias("w"))

        def minima(w: Column) -> Column:
            # the windows of one minimum follow each other
            firsts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i)["fp"] != F.get(w, i - 1)["fp"]))
            its = lambda i: F.transform(F.filter(F.slice(w, i + 1, F.lit(run)), lambda x: x["fp"] == F.get(w, i)["fp"]), lambda x: x["w"])
            return F.transform(firsts, lambda i: F.struct(F.get(w, i)["fp"]["h"].alias("fp"), its(i).alias("ws")))

        def exact(part: Column, kind: str) -> Column:
            return _bind(keyed(part, F.lit(kind)), lambda w: F.struct(w["a"].alias("fp"), F.array(w).alias("ws")))

        def short(n: int) -> Column:
            # windows that a shorter one of the same first or last line does not hold: their unions are those of all
            def least(j: Column) -> Column:
                sizes = [F.get(named, j + i)["n"] for i in range(n)]
                total = sum(sizes[1:], sizes[0])
                return (total >= words) & ((total - sizes[0] < words) | (total - sizes[-1] < words))

            starts = F.filter(F.sequence(F.lit(0), F.size(named) - n), least)
            return F.when(F.size(named) >= n, F.transform(starts, lambda j: exact(F.slice(named, j + 1, F.lit(n)), "lines")))

        runs = F.when(F.size(named) >= run, _bind(F.transform(F.sequence(F.lit(0), F.size(named) - run), window), minima))
        if not words:
            return runs
        whole = F.when(F.size(named).between(1, run - 1), F.array(exact(named, "text")))
        return F.flatten(F.array_compact(F.array(runs, whole, *[short(n) for n in range(1, run)])))

    return _bind(named, of)


def _dealt(rows: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """rows with the verdict of their key, if there is one; the rows of a key are dealt to SALTS parts."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    every = verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every.hint("merge"), [*on, "__salt"]).drop("__salt")


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, words: int | None = None) -> DataFrame:
    """(__key, __hash, __runs): per document with repeats its runs [s, e] of lines to delete, in order."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.explode(_windows(F.col(f"`{text}`"), run, words)).alias("x"))
    prints = staged(d.select("key", "hash", "x.fp", "x.ws"))
    where = F.struct(F.col("key").isNull().alias("n"), "key", "hash", F.get(F.col("ws"), 0)["s"].alias("s"))
    shared = prints.groupBy("fp").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("fp")
    near = staged(_dealt(prints, shared, ["fp"]).select("key", "hash", F.explode("ws").alias("w")).select("key", "hash", "w.*"))
    where = F.struct(F.col("key").isNull().alias("n"), "key", "hash", "s")
    first = near.groupBy("a", "b").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last")
    later = _dealt(near, first, ["a", "b"]).where(where != F.col("first")).select("key", "hash", "s", "e").distinct()
    # overlapping repeats make one run; a document's windows are as many as its lines at most
    order = Window.partitionBy("key", "hash").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("s") > before, 1).when(before.isNull(), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(order)).groupBy("key", "hash", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy(F.col("key").alias("__key"), F.col("hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("__runs"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", run: int = RUN, n_chars: str | None = "n_chars", words: int | None = None) -> DataFrame:
    """docs with repeated runs deleted from the text, and __n_lines, __n_removed, __n_runs beside their columns."""
    runs = repeated_runs(docs, text, key, run, words)
    t = F.col(f"`{text}`")
    found = docs.withColumn("__h", F.xxhash64(t)).join(runs, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__hash")), "left")
    lines = F.split(t, "\n", -1)
    r = F.coalesce(F.col("__runs"), F.array().cast("array<struct<s:int,e:int>>"))
    # kept lines lie before the first run, between runs, and after the last
    cuts = F.transform(
        F.sequence(F.lit(0), F.size(r)),
        lambda i: F.struct(F.coalesce(F.get(r, i - 1)["e"] + 1, F.lit(0)).alias("a"), F.coalesce(F.get(r, i)["s"], F.size(lines)).alias("b")),
    )
    kept = F.array_join(F.flatten(F.transform(cuts, lambda c: F.slice(lines, c["a"] + 1, c["b"] - c["a"]))), "\n")
    found = found.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text], F.when(F.size(r) > 0, kept).otherwise(t).alias("__new"),
        F.coalesce(F.size(lines), F.lit(0)).alias("__n_lines"),
        F.aggregate(r, F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1).alias("__n_removed"), F.size(r).alias("__n_runs"),
    )
    new = F.col("__new")
    columns = [new.alias(c) if c == text else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns, "__n_lines", "__n_removed", "__n_runs")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its lines, those deleted, the runs they form, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return dedup_lines(docs).select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"),
        F.col("__n_runs").cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d
), nb AS (
  SELECT r, i, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT r, i AS s, lead(i, 3) OVER o AS e,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o || chr(10) || lead(line, 3) OVER o AS k
  FROM nb WINDOW o AS (PARTITION BY r ORDER BY i)
), rep AS (
  SELECT r, s, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, s) AS n FROM w WHERE e IS NOT NULL) WHERE n > 1
), steps AS (
  SELECT r, s, e, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p FROM rep
), runs AS (
  SELECT r, min(s) AS s, max(e) AS e FROM (
    SELECT r, s, e, sum(CASE WHEN s > p THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM steps
  ) GROUP BY r, g
), gone AS (
  SELECT DISTINCT l.r, l.i FROM l JOIN runs ON runs.r = l.r AND l.i BETWEEN runs.s AND runs.e
), kept AS (
  SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN gone ON gone.r = l.r AND gone.i = l.i
  WHERE gone.r IS NULL GROUP BY l.r
)
SELECT doc_id, len(ls)::BIGINT AS n_lines,
  coalesce((SELECT sum(e - s + 1) FROM runs WHERE runs.r = d.r), 0)::BIGINT AS n_removed,
  coalesce((SELECT count(*) FROM runs WHERE runs.r = d.r), 0)::BIGINT AS n_runs,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
