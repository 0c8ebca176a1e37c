"""Full-text match with BM25, rank fusion, hybrid search and evidence order."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import folded, spaced_tokens, word_forms
from cairnlake.session import written

K1, B = 1.2, 0.75
RRF = 60


#: Bytes of text whose postings are folded together, and of packed postings that are opened together, about.
FOLDED, OPENED = 8 << 20, 1 << 20
#: Parts of the terms, by hash: a row of the index is one part's postings in FOLDED bytes of text. Bytes of a column that are read or skipped as one.
PARTS, PAGE = 256, 64 << 10
PACKED_SQL = "part int, first bigint, tokens bigint, terms array<string>, firsts array<bigint>, docs array<int>, ids binary, lengths binary, tfs binary, ats binary"


@dataclass(frozen=True)
class TextIndex:
    """Postings by parts of the terms, and how many documents and tokens there are (n, total).

    A row packs the postings that some terms have in some MB of text: for each term `docs` documents of which `firsts` is
    the least id, and as varints the steps of ids, lengths, numbers of tokens, and steps of positions; `tokens` are all of
    the row's, and `first` is an id of them.
    """

    postings: DataFrame
    facts: DataFrame

    def of(self, terms: list[str], positions: bool = True) -> DataFrame:
        """(term, id, length, tf, at) of some terms: only pages that hold their parts are read."""
        columns = ["terms", "firsts", "docs", "ids", "lengths", "tfs", *["ats"] * positions]
        found = self.postings.where(F.col("part").isin(sorted({_part(t.encode()) for t in terms}))).select(*columns)
        return found.mapInArrow(_opened(terms), "term string, id bigint, length int, tf bigint" + ", at array<int>" * positions)


def _part(term: bytes) -> int:
    return zlib.crc32(term) % PARTS


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in seven bits a byte, the lowest first, a high bit on all but a number's last byte; and where each begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for shift in range(7, int(values.max(initial=0)).bit_length(), 7):
        size += (values >> np.uint64(shift)) > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(size.max(initial=0)):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)) | ((size[some] > k + 1) * np.uint64(128))
    return out, at


def numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that varints() packed."""
    last = np.flatnonzero(data < 128)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - start + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(size.max(initial=0)):
        some = np.flatnonzero(size > k)
        out[some] |= (data[start[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries end to end, and where each begins; nulls have none."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before, but values as they are where a group begins."""
    before = np.concatenate([[0], values[:-1]]).astype(values.dtype)
    before[first] = 0
    return values - before


def _sums(steps: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of a group's steps so far; groups begin at `first` and have n of them."""
    total = np.cumsum(steps, dtype=steps.dtype)
    return total - np.repeat(total[first] - steps[first], n)


def _characters(spark: SparkSession) -> np.ndarray:
    """What terms have for each code point: another one, a space where words end, or 0 for nothing; by Spark's own expressions.

    Only the capital sigma depends on what stands about it.
    """
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    of = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", spaced_tokens(folded(c)).alias("c"))
    rows = of.where("c <> ' '").select(F.col("id").cast("int").alias("id"), F.ascii("c").alias("to"), (F.char_length("c") > 1).alias("more")).toArrow()
    if pc.any(rows.column("more")).as_py():
        raise ValueError("a character stands for several in a term")
    out = np.full(0x110000, 32, np.uint32)
    out[rows.column("id").to_numpy()] = rows.column("to").to_numpy()
    return out


def _words(text: pa.Array, characters: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts one after the other, where each begins among their characters, and where each text does."""
    each = ["" if t is None else t.decode("utf-8", "replace") for t in text.cast(pa.binary()).to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in each])])
    code = characters[np.frombuffer(" ".join([*each, ""]).encode("utf-32-le", "replace"), np.uint32)]
    gone = np.flatnonzero(code == 0)
    if len(gone):
        code, at = np.delete(code, gone), at - np.searchsorted(gone, at)
    held = code != 32
    edges = np.concatenate([[False], held, [False]])
    turns = np.flatnonzero(edges[1:] != edges[:-1]).astype(np.int32)
    starts, code = turns[::2], code[held]
    ends = np.concatenate([[0], np.cumsum(turns[1::2] - starts)]).astype(np.int32)
    if code.max(initial=0) < 128:
        data = code.astype(np.uint8)
    else:
        data = code.tobytes().decode("utf-32-le").encode()
        ends = np.concatenate([[0], np.cumsum(np.searchsorted([0x80, 0x800, 0x10000], code, "right") + 1)]).astype(np.int32)[ends]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)), starts, at


def _folded(rows: pa.Table, characters: np.ndarray) -> pa.RecordBatch:
    rows = rows.take(pc.sort_indices(rows.column("id"))).combine_chunks()  # so ids rise within a term, nulls at the end
    ids = rows.column("id").chunk(0)
    words, starts, starts_of = _words(rows.column("text").chunk(0), characters)
    words = words.dictionary_encode()
    bounds = np.searchsorted(starts, starts_of)  # a document's words
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    at = np.arange(len(starts), dtype=np.int32) - np.repeat(bounds[:-1].astype(np.int32), lengths)
    part = np.array([_part(t) for t in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    by = np.argsort(part, kind="stable")  # terms in the order of their parts
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    # documents and positions rise within a term
    order = np.sort((place[words.indices.to_numpy()] << 32) | np.arange(len(starts)))
    term, order = order >> 32, order & 0xFFFFFFFF
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else term
    tf = np.diff(np.append(first, len(term)))
    of, owner = term[first], doc[first]
    none = ids.is_null().to_numpy(zero_copy_only=False)[owner]
    group = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (none[1:] != none[:-1])])) if len(of) else first
    number = ids.fill_null(0).to_numpy()[owner]
    step = _steps(number.view(np.uint64), group)
    step[group] = 0
    docs = np.diff(np.append(group, len(of)))
    parts = part[by][of[group]]
    row = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else group  # of groups
    groups = pa.array(np.append(row, len(group)).astype(np.int32))
    cuts = np.append(group, len(of))[np.append(row, len(group))]  # of documents
    positions = np.append(first, len(term))[cuts]

    def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        out, begins = varints(values)
        return pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(begins[cuts].astype(np.int32)), pa.py_buffer(out)])

    listed = lambda values: pa.ListArray.from_arrays(groups, values)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts[row].astype(np.int32)), pa.array(number[cuts[:-1]]), pa.array(np.diff(positions)),
            listed(words.dictionary.take(pa.array(by[of[group]]))), listed(pa.array(number[group], mask=none[group])), listed(pa.array(docs.astype(np.int32))),
            packed(step, cuts), packed(lengths[owner], cuts), packed(tf, cuts), packed(_steps(at, first), positions),
        ],
        names=[c.split()[0] for c in PACKED_SQL.split(", ")],
    )


def _parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes in a column."""
    part = _bytes(batch.column(column))[1][:-1] // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _postings(characters: np.ndarray):
    """Packed postings of documents (id, text): made in the task, without a shuffle of tokens."""
    small = zlib.compress(characters.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(small), np.uint32)
        held, size = [], 0
        for batch in batches:
            for some in _parts(batch, "text", FOLDED):
                held.append(some)
                size += len(_bytes(some.column("text"))[0])
                if size >= FOLDED:
                    yield _folded(pa.Table.from_batches(held), known)
                    held, size = [], 0
        if size:
            yield _folded(pa.Table.from_batches(held), known)

    return run


def _opened(terms: list[str]):
    """The postings of some terms, out of rows that hold others of their parts too."""
    wanted = pa.array(sorted(set(terms)), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = "ats" in batch.schema.names
            for some in _parts(batch, "ats" if positions else "ids", OPENED):
                if not some.num_rows:
                    continue
                term, first, n = (some.column(c).flatten() for c in ("terms", "firsts", "docs"))
                n = n.to_numpy()
                group, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                mine = pc.is_in(term.cast(pa.string()), wanted).to_numpy(zero_copy_only=False)[group]
                group = group[mine]
                ids, lengths, tfs = (numbers(_bytes(some.column(c))[0]) for c in ("ids", "lengths", "tfs"))
                ids = _sums(ids, begin, n)[mine] + first.fill_null(0).to_numpy().view(np.uint64)[group]
                none = first.is_null().to_numpy(zero_copy_only=False)[group]
                size = tfs.astype(np.int64)
                tf = size[mine]
                out = {"term": term.take(pa.array(group)), "id": pa.array(ids.view(np.int64), mask=none), "length": pa.array(lengths[mine].astype(np.int32)), "tf": pa.array(tf)}
                if positions:
                    at = numbers(_bytes(some.column("ats"))[0])[np.repeat(mine, size)]
                    offsets = np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)
                    at = _sums(at, offsets[:-1], tf)
                    out["at"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return run


def text_index(spark: SparkSession, source: str, docs: DataFrame, text: Column) -> TextIndex:
    """The index of docs (id, text), which derive from the files at `source`; written once.

    Terms are folded to lower case without accents; `at` are positions. Only packed postings are written, some bytes a
    token, and a row of them holds the terms of a part that FOLDED bytes of text have, so rows are few.
    """

    def postings() -> DataFrame:
        # what stands about a capital sigma decides what it becomes; all else goes character by character, in the task
        plain = F.when(F.contains(text, F.lit("Σ")), spaced_tokens(folded(text))).otherwise(text)
        return docs.select("id", plain.alias("text")).mapInArrow(_postings(_characters(spark)), PACKED_SQL)

    # rows of a task's text go by parts and pages hold few of them, so a search skips the other parts' pages and nothing is shuffled
    pages = {"parquet.page.size": str(PAGE), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
    found = written(spark, "postings", source, postings, version=5, options=pages)
    facts = written(spark, "postings-facts", source, lambda: docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(found.agg(F.sum("tokens").alias("total"))), version=5)  # one row
    return TextIndex(found, facts)


def bm25(index: TextIndex, terms: list[str]) -> DataFrame:
    """(id, score) of documents that hold all terms; idf is ln(1 + (N - n + 0.5) / (n + 0.5)). Only the terms' postings are read."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    own = index.of(wanted, positions=False)
    counts = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    found = own.groupBy("id", "length").agg(*counts)
    frequencies = own.agg(*[F.count_if(F.col("term") == w).alias(f"df{i}") for i, w in enumerate(wanted)])
    facts = index.facts.select("n", (F.col("total") / F.col("n")).alias("mean")).join(F.broadcast(frequencies), F.lit(True))
    hits = found.where(" AND ".join(f"tf{i} IS NOT NULL" for i in range(len(wanted)))).join(F.broadcast(facts), F.lit(True))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score += F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.select("id", score.alias("score"))


def phrases(raw: str) -> list[list[str]]:
    """The phrases of a request: each word between spaces is one, as its letters and digits in order; words without any are dropped."""
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))
    return [p for w in raw.split() if (p := "".join(c if c.isalnum() else " " for c in bare(w)).split())]


def phrase_hits(index: TextIndex, raw: str) -> DataFrame:
    """Ids of documents that hold every phrase of a request; a request without phrases finds nothing."""
    wanted = phrases(raw)
    terms = sorted({t for p in wanted for t in p})
    if not wanted:
        return index.of([], positions=False).select("id")
    at = {t: f"at{i}" for i, t in enumerate(terms)}
    found = index.of(terms).groupBy("id").agg(*[F.first(F.when(F.col("term") == t, F.col("at")), ignorenulls=True).alias(c) for t, c in at.items()])
    found = found.where(" AND ".join(f"{c} IS NOT NULL" for c in at.values()))
    for p in wanted:
        follow = list(enumerate(p[1:], 1))
        found = found.where(F.exists(at[p[0]], lambda x: reduce(Column.__and__, [F.array_contains(at[t], x + i) for i, t in follow], F.lit(True))))  # noqa: B023
    return found.select("id")


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """(id, rank): the best hits, score falling, ties by id; rank from 1."""
    top = hits.orderBy(F.round("score", 9).desc(), "id").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")).alias("rank"))


def fuse(lists: list[DataFrame], weights: list[float] | None = None, limit: int = 50) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: the sum of weight / (60 + rank); ties by first appearance, list by list."""
    each = [x.select("id", (F.lit(float(w)) / (RRF + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("list"), "rank").alias("at")) for i, (x, w) in enumerate(zip(lists, weights or [1.0] * len(lists), strict=True))]
    both = each[0]
    for x in each[1:]:
        both = both.unionByName(x)
    return both.groupBy("id").agg(F.sum("s").alias("score"), F.min("at").alias("at")).orderBy(F.round("score", 12).desc(), "at", "id").limit(limit).select("id", "score", "at")


def subject_ids(index: TextIndex, groups: list[list[str]]) -> DataFrame:
    """Ids with all words of any group; a word is met in any of its forms."""
    words = sorted({w for g in groups for w in g})
    spark = index.postings.sparkSession
    forms = {r.w: r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", word_forms(F.col("w")).alias("f")).collect()}
    own = index.of(sorted({f for x in forms.values() for f in x}), positions=False)
    met = own.groupBy("id").agg(*[F.max(F.col("term").isin(forms[w])).alias(f"w{i}") for i, w in enumerate(words)])
    match = reduce(Column.__or__, [reduce(Column.__and__, [F.col(f"w{words.index(w)}") for w in g]) for g in groups])
    return met.where(match).select("id")


def tag_hits(tags: DataFrame, query: str, limit: int = 100, shown: int = 8) -> DataFrame:
    """(file_id, words, text): files by how many words of a query begin a word of their tags, newest of the best first.

    tags: (file_id, tag, source, score); sources other than users, descriptions and models do not count. Words have three
    letters or more, the first six in order count, each with its singular forms; an underscore parts words of a tag. Of
    the first `limit` files by words, then newest, those of the best count are kept. text: the file's first tags.
    """
    words = sorted({w for w in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split() if len(w) >= 3})[:6]
    some = tags.where(F.col("source").isin("auto", "user", "vlm"))
    if not words:
        return some.select("file_id", F.lit(0).cast("bigint").alias("words"), F.lit("").alias("text")).limit(0)
    # tags are few beside their uses: words are matched against the distinct ones
    padded = F.concat(F.lit(" "), F.replace(F.lower("tag"), F.lit("_"), F.lit(" ")))
    forms = some.sparkSession.createDataFrame([(w,) for w in words], "word string").select("word", F.explode(word_forms(F.col("word"))).alias("form"))
    met = some.select("tag").distinct().join(F.broadcast(forms), F.contains(padded, F.concat(F.lit(" "), "form"))).select("tag", "word").distinct()
    hits = some.join(met, "tag").groupBy("file_id").agg(F.countDistinct("word").alias("words")).orderBy(F.col("words").desc(), F.col("file_id").desc()).limit(limit)
    best = hits.join(F.broadcast(hits.agg(F.max("words").alias("words"))), "words")
    pri = F.when(F.col("source") == "user", 0).when(F.col("source") == "vlm", 1).otherwise(2)
    own = some.join(best, "file_id").select("file_id", "words", F.replace(F.trim("tag"), F.lit("_"), F.lit(" ")).alias("tag"), F.struct(pri.alias("p"), (-F.coalesce("score", F.lit(0.0))).alias("s")).alias("o"))
    first = own.groupBy("file_id", "words", "tag").agg(F.min("o").alias("o")).withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("o", "tag"))).where(F.col("r") <= shown)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ", ")
    return first.groupBy("file_id", "words").agg(F.concat(F.lit("Tags: "), text).alias("text"))


def evidence_order(kind: Column) -> Column:
    """Chapters, then other evidence, then sampled frames."""
    return F.when(kind == "chapter", 0).when(kind == "frame", 2).otherwise(1)


def source_rank(tier: Column) -> Column:
    """Hits in a file's content, then in its recognised text, then in its name."""
    return F.when(tier == "content", 0).when(tier == "ocr", 1).otherwise(2)


def by_tier(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (id, tier, ordinal) by tier, place in their list, and id."""
    return hits.orderBy(source_rank(F.col("tier")), "ordinal", "id").limit(limit)


def snippet(text: Column, word: str, around: int = 40) -> Column:
    """The words about the first match, simplified: characters on either side."""
    at = F.locate(word.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word)))).otherwise(F.substring(text, 1, 2 * around))


def restrict(hits: DataFrame, files: DataFrame) -> DataFrame:
    """ranked hits that pass a filter, in their order."""
    return hits.join(files.select("id"), "id", "left_semi")


def fill(hits: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """hits (id, rank), then other ids by id, up to a limit."""
    rest = more.select("id").join(hits, "id", "left_anti").orderBy("id").limit(limit).select("id", F.lit(2**31 - 1).alias("rank"))
    return hits.select("id", F.col("rank").cast("int")).union(rest).orderBy("rank", "id").limit(limit)


#: Weights of likeness, words and people in a selection, and the cosines that count as nothing and as all.
WEIGHT_CLIP, WEIGHT_WORDS, WEIGHT_PEOPLE = 0.6, 0.3, 0.3
CLIP_FLOOR, CLIP_SPAN = 0.18, 0.17


def selection(candidates: DataFrame, terms: list[tuple[str, str]], people: list[int]) -> DataFrame:
    """Candidates (id, clip, stems, people) with score and matched, the words of the request found in their evidence.

    terms: (stem, word) of the request's content; people: persons it names. A part that the request or candidate lacks has
    no weight; the score has four digits, and is 0 where nothing has weight.
    """
    words = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in terms]) if terms else F.array().cast("array<struct<s:string,w:string>>")
    matched = F.transform(F.filter(words, lambda t: F.array_contains("stems", t["s"])), lambda t: t["w"])
    clip = F.least(F.greatest((F.col("clip") - CLIP_FLOOR) / CLIP_SPAN, F.lit(0.0)), F.lit(1.0))
    parts = [(F.when(F.col("clip").isNotNull(), clip), WEIGHT_CLIP)]
    if terms:
        parts.append((F.size("matched") / len(terms), WEIGHT_WORDS))
    if people:
        parts.append((F.size(F.array_intersect("people", F.array(*[F.lit(p).cast("bigint") for p in people]))) / len(set(people)), WEIGHT_PEOPLE))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    return candidates.withColumn("matched", matched).withColumn("score", F.when(weight > 0, F.round(total / weight, 4)).otherwise(0.0))
