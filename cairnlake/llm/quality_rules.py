"""Quality rules of documents with verdicts per host.

Rules are counted per document, rule failures are aggregated per host (the column `source`), each host's
failure rate is shrunk towards the corpus by an empirical beta prior, and the host's verdict goes back to
its documents: documents of a blocked host are held to stricter limits.

Defined results: a null text counts as empty (no words, so it fails the base rules); a null host is a host
of its own; repeated rows count once each; an empty table gives no rows; other columns are passed through
by apply_rules and never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import WORD, bounded_batches, small_batches
from cairnlake.session import staged, table

SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: Blocked hosts up to which their verdicts are broadcast (some MB); beyond it they are joined by salted keys.
FEW_HOSTS = 100_000
SALTS = 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rules:
    """Limits: the base rules, the rules whose failures count against a host, and those of blocked hosts."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_symbols_per_100_words: int = 20
    max_dup_lines_pct: int = 50
    mean_word_chars: tuple[float, float] = (2.0, 20.0)
    #: A host is blocked where its shrunk failure rate is so many times the corpus rate or more, or reaches
    #: blocked_rate: its documents face limits cut by `strict`. Where hosts are alike none is blocked.
    blocked_times: float = 1.5
    blocked_rate: float = 0.5
    strict: int = 4


def count_rules(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            until = 0  # words before this position are counted
            for i, window in enumerate(windows):
                if seen[window] > 1:
                    repeats += i + WINDOW - max(i, until)
                    until = i + WINDOW
    return n, chars, len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeats, len(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = batch.column("__text")
        rows = [count_rules(x.as_py()) for x in texts]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        names = [f for f in batch.schema.names if f != "__text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in names] + [pa.array(c, pa.int64()) for c in columns],
            names=names + [f"__{c}" for c in COUNTS],
        )


def base_failed(r: Rules, at: str = "") -> Column:
    n, repeats = F.col(f"{at}n_words"), F.col(f"{at}n_repeat_words")
    return (n < r.min_words) | (100 * repeats > r.max_repeat_pct * n)


def soft_failed(r: Rules, at: str = "", strict: int = 1) -> Column:
    """Whether a document breaks a rule beyond the base; `strict` divides the limits."""
    col = lambda c: F.col(f"{at}{c}")
    low, high = r.mean_word_chars
    return (
        (100 * strict * col("n_symbols") > r.max_symbols_per_100_words * col("n_words"))
        | (100 * strict * col("n_dup_lines") > r.max_dup_lines_pct * col("n_lines"))
        | ((col("n_words") > 0) & ~(col("word_chars") / F.greatest(col("n_words"), F.lit(1))).between(low, high))
    )


def counted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` beside the counts (as __n_words and so on), one narrow pass over whole texts."""
    names = docs.columns if keep is None else keep
    wide = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    kept = [f for f in wide.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`__{c}` bigint" for c in COUNTS])
    return wide.mapInArrow(_counted, schema)


def host_rates(rows: DataFrame, host: Column, failed: Column) -> DataFrame:
    """(host, n, failed, rate, corpus_rate): failure rates shrunk to the corpus by a beta prior fitted by moments.

    The prior's mean is the corpus rate and its weight comes from the spread of hosts' rates beyond what
    chance explains; where hosts do not differ the weight is large and all hosts get the corpus rate.
    """
    hosts = rows.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
    corpus = hosts.agg(
        F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square"),
    )
    mean = F.col("all_bad") / F.col("all_n")
    # weighted variance between hosts, less the binomial part
    between = (F.col("square") - F.col("all_n") * mean * mean - (F.col("hosts") - 1) * mean * (1 - mean)) / F.greatest(F.col("all_n") - F.col("all_n") / F.col("hosts"), F.lit(1.0))
    weight = F.when(between > 0, F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    prior = corpus.select(mean.alias("prior_mean"), weight.alias("prior_weight"))
    rate = (F.col("bad") + F.col("prior_mean") * F.col("prior_weight")) / (F.col("n") + F.col("prior_weight"))
    # one row joins: a constant key, no product of rows
    return (
        hosts.withColumn("__one", F.lit(1)).join(F.broadcast(prior.withColumn("__one", F.lit(1))), "__one")
        .select("host", "n", F.col("bad").alias("failed"), rate.alias("rate"), F.col("prior_mean").alias("corpus_rate"))
    )


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with __counts, __base_failed, __host_rate and __kept.

    Hosts are aggregated with map-side partial sums, so a host with a third of all rows costs no more than
    others; verdicts of blocked hosts meet the documents without moving those of a large host to one task. Where the text is kept the counts are made twice, else written once.
    """
    names = docs.columns if keep is None else keep
    with_host = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__input"))
    rows = counted(with_host, "__input", [*names, "__host"])
    failed = base_failed(rules, "__") | soft_failed(rules, "__")
    if text in names:  # the host side reads only host and text, rather than writing whole texts
        for_hosts = counted(docs.select(F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__input")), "__input", ["__host"])
    else:
        rows = for_hosts = staged(rows)
    blocked = staged(host_rates(for_hosts, F.col("__host"), failed).where(F.col("rate") >= F.least(rules.blocked_times * F.col("corpus_rate"), F.lit(rules.blocked_rate))).where("failed > 0").select(F.col("host").alias("__blocked"), F.col("rate").alias("__host_rate")))
    if blocked.count() <= FEW_HOSTS:
        joined = rows.join(F.broadcast(blocked), F.col("__host").eqNullSafe(F.col("__blocked")), "left")
    else:  # a host may hold a third of all rows: its rows are dealt to SALTS parts, and verdicts go to each
        salted = rows.withColumn("__salt", (F.col("__n_words") + F.col("__word_chars") * 7) % SALTS)
        every = blocked.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(every, F.col("__host").eqNullSafe(F.col("__blocked")) & (F.col("__salt") == F.col("__part")), "left")
    base = base_failed(rules, "__")
    verdict = F.when(F.col("__host_rate").isNotNull(), ~soft_failed(rules, "__", rules.strict)).otherwise(~soft_failed(rules, "__"))
    return joined.select(
        *[F.col(f"`{c}`") for c in names], *[F.col(f"__{c}") for c in COUNTS],
        base.alias("__base_failed"), (~base & verdict).alias("__kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: its rule counts, whether the base rules fail, and the verdict."""
    bounded_batches(spark)
    out = apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS[:5]],
        F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i+4], ' ') AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1
), gaps AS (
  SELECT r, least(5, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000000)) AS k FROM rep
), reps AS (
  SELECT r, sum(k)::BIGINT AS n_repeat_words FROM gaps GROUP BY r
), c AS (
  SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN reps ON reps.r = w.r
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
      OR (n_words > 0 AND NOT (word_chars / n_words BETWEEN 2.0 AND 20.0))) AS soft,
    (400 * n_symbols > 20 * n_words OR 400 * n_dup_lines > 50 * n_lines
      OR (n_words > 0 AND NOT (word_chars / n_words BETWEEN 2.0 AND 20.0))) AS strict_soft
  FROM c
), h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft)::DOUBLE AS bad FROM f GROUP BY source
), p AS (
  SELECT sum(n) AS nn, sum(bad) / sum(n) AS m, count(*) AS k, sum(bad * bad / n) AS sq FROM h
), q AS (
  SELECT m, (sq - nn * m * m - (k - 1) * m * (1 - m)) / greatest(nn - nn / k, 1.0) AS b FROM p
), pr AS (
  SELECT m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, 1.0), 1e6) ELSE 1e6 END AS wt FROM q
), hb AS (
  SELECT source FROM h, pr WHERE (bad + m * wt) / (n + wt) >= least(1.5 * m, 0.5::DOUBLE) AND bad > 0
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT CASE WHEN EXISTS (SELECT 1 FROM hb WHERE hb.source IS NOT DISTINCT FROM f.source)
    THEN strict_soft ELSE soft END AS kept
FROM f
"""
