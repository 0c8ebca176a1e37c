"""Text functions as Spark expressions, and the few that need Python."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from cairnlake.session import bounded_batches

#: English function words that carry no subject; written for this engine.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before", "but", "by", "can", "could", "did", "do", "does", "for", "from",
    "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "not", "of", "on", "one",
    "or", "other", "our", "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "up", "us", "was", "we", "were", "what", "when", "where", "which", "while", "who", "will", "with", "would", "you", "your",
)


def visible_text(html: Column) -> Column:
    """What a reader sees of a page: comments, scripts, styles and the head go, tags become spaces, six references are decoded."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "head"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = strip_tags(x, collapse=False)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return collapsed(x)


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))


def strip_tags(x: Column, collapse: bool = True) -> Column:
    """Tags to spaces."""
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    return collapsed(x) if collapse else x


#: Letters up to U+024F that decompose, and the letters they stand on.
_ACCENTED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")}


def folded(x: Column) -> Column:
    """Lower case without accents, as index terms are."""
    bare = F.translate(F.lower(x), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.regexp_replace(bare, r"\p{Mn}+", "")


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def spaced_tokens(x: Column) -> Column:
    """The same runs in one string, parted by spaces."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")


def word_forms(w: Column) -> Column:
    """A word and its likely singulars, for words of four letters or more."""
    long = (F.length(w) >= 4) & ~w.endswith("ss")
    ies = F.when(w.endswith("ies"), F.array(w, F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))))
    es = F.when(w.endswith("es"), F.array(w, F.substring(w, F.lit(1), F.length(w) - 2), F.substring(w, F.lit(1), F.length(w) - 1)))
    s = F.when(w.endswith("s"), F.array(w, F.substring(w, F.lit(1), F.length(w) - 1)))
    return F.when(long, F.coalesce(ies, es, s, F.array(w))).otherwise(F.array(w))


def light_stem(w: Column) -> Column:
    """Drops -ing of longer words and a plural -s."""
    return (
        F.when((F.length(w) > 5) & w.endswith("ing"), F.substring(w, F.lit(1), F.length(w) - 3))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    )


def name_tokens(stem: Column) -> Column:
    """Words of a file name: three characters or more, not only digits, not stop words, once each."""
    found = F.filter(tokens(stem), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\p{N}+$"))
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS])))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; null-free, 0 for two empty sets."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def title_of(x: Column, most: int = 88) -> Column:
    """The first piece between sentence marks and line feeds, without them, cut at a word within `most` characters, with an ellipsis if cut."""
    piece = F.regexp_extract(x, r"[^.!?\n]+", 0)
    first = F.regexp_replace(F.when(piece != "", piece).otherwise(x), r"^\s+|\s+$", "")
    short = F.substring(first, 1, most)
    cut = F.when(short.rlike(r"\s"), F.regexp_extract(short, r"(?s)^(.*)\s\S*$", 1)).otherwise(short)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(cut, F.lit("…")))


#: Camera families, in the order in which a model's name is searched for them.
CAMERAS = ("iPhone", "iPad", "Canon", "Nikon", "Sony", "Fuji", "Leica", "GoPro", "Samsung", "Pixel")


def plain_tags(created: Column, modified: Column, camera: Column) -> Column:
    """The year from 1991 to 2099 of a file's creation, else of its last change, and its camera's family, as tags."""
    when = F.when(created > 0, created).otherwise(modified)
    year = F.year(F.timestamp_seconds(F.when(when > 0, when)))
    family = F.coalesce(*[F.when(F.contains(F.lower(camera), F.lit(n.lower())), n) for n in CAMERAS])
    return F.array_compact(F.array(F.when((year > 1990) & (year < 2100), F.concat(F.lit("Year_"), year.cast("string"))), family))


def time_features(seconds: Column) -> Column:
    """Five features of a time: sine and cosine of the day of a year of 365 days and of the second of the day, and log years; zeros up to the epoch."""
    s = seconds.cast("bigint")
    day, second = 2 * F.pi() * (F.floor(s / 86_400) % 365) / 365, 2 * F.pi() * (s % 86_400) / 86_400
    years = F.log1p(F.least(F.greatest(seconds / (365.25 * 86_400), F.lit(0.0)), F.lit(100.0))) / F.log1p(F.lit(100.0))
    return F.when(seconds > 0, F.array(F.sin(day), F.cos(day), F.sin(second), F.cos(second), years)).otherwise(F.array(*[F.lit(0.0)] * 5))


def folder_of(path: Column) -> Column:
    """The folder of a path with either separator; empty if none."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


#: Names of folders that say nothing.
GENERIC_FOLDERS = (
    "downloads", "downloaded", "new folder", "untitled folder", "untitled", "temp", "tmp", "misc", "miscellaneous", "other", "others", "stuff", "things", "files",
    "unsorted", "desktop", "dump", "inbox", "to sort", "to-sort", "import", "imports", "camera uploads", "dcim", "export", "exports", "screenshots", "screen shots",
)


def generic_folder(name: Column) -> Column:
    """Folder names that say nothing: empty, dumps, numbered new folders, camera folders."""
    n = F.lower(F.trim(name))
    return (n == "") | n.isin(*GENERIC_FOLDERS) | n.rlike(r"^(new folder|untitled folder|untitled)( [0-9]+)?$") | n.rlike(r"^[0-9]{3}[a-z_]{3,5}$")


def usable_folder(name: Column) -> Column:
    """Folder names worth keeping: three characters, no underscore, no camera stem, no short prefix with a number."""
    n = F.lower(F.trim(name))
    camera = n.rlike(r"\b(dsc|dscf|dscn|img|imgp|pxl|mvi|gopr|gp|dji|p\d{3}|_mg|mg)[_-]?\d{3,}")
    return (F.length(n) >= 3) & ~n.contains("_") & ~camera & ~n.rlike(r"\b[a-z]{0,4}\d{4,}\b")


#: Tags of pictures that hold writing.
WRITING_TAGS = (
    "handwriting", "whiteboard", "blackboard", "chalkboard", "chalk", "sticky note", "notebook", "notepad", "note", "manuscript", "calligraphy", "signature", "journal",
    "diary", "letter", "envelope", "postcard", "greeting card", "document", "printed page", "paper", "receipt", "bill", "form", "contract", "certificate", "recipe",
    "list", "menu", "newspaper", "poster", "screenshot", "sign", "diagram", "calendar", "checkbook", "text", "presentation", "writing", "write",
)


def text_bearing(tags: Column) -> Column:
    """X11: whether any of a picture's tags says that it holds writing."""
    return F.exists(tags, lambda t: F.trim(F.replace(F.lower(t), F.lit("_"), F.lit(" "))).isin(*WRITING_TAGS))


def document_shape(width: Column, height: Column, has_camera: Column) -> Column:
    """X11: whether a picture without a camera has a scanned page's proportions: Letter or A4, either way up."""
    ratio = F.greatest(width, height) / F.least(width, height)
    page = (F.abs(ratio - 11.0 / 8.5) < 0.015) | (F.abs(ratio - 2.0**0.5) < 0.015)
    return F.when(has_camera | (F.least(width, height) <= 0), F.lit(False)).otherwise(page)


def safe_component(name: Column) -> Column:
    """A file-name part without separators, control or reserved characters, or dots and spaces at its ends."""
    x = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_")
    x = F.regexp_replace(x, r"^[. ]+|[. ]+$", "")
    return F.when(x == "", "untitled").when(F.lower(x).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"), F.concat(F.lit("_"), x)).otherwise(F.left(x, F.lit(200)))


def size_label(n: Column) -> Column:
    """A size in decimal units with one decimal, halves up; a label that would read 1000.0 takes the next unit."""
    out = F.when(n == 1, "1 byte").when(n < 1000, F.format_string("%d bytes", n))
    for unit, size in (("KB", 10**3), ("MB", 10**6), ("GB", 10**9), ("TB", 10**12)):
        tenths = F.floor(n * 10 / size + F.lit(0.5))
        out = out.when(tenths < 10_000, F.format_string(f"%.1f {unit}", tenths / 10))
    return out.otherwise(F.format_string("%.1f PB", F.floor(n * 10 / 10**15 + F.lit(0.5)) / 10))


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """F16: canonical composition, which Spark has no function for."""
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def _garbled(text: str) -> float:
    words = re.findall(r"\S+", text or "")
    if not words:
        return 0.0
    bad = 0
    for w in words:
        core = w.strip(".,;:!?\"'()[]")
        flips = sum(a.islower() and b.isupper() for a, b in zip(core, core[1:], strict=False))
        inner = len(re.findall(r"(?<=\w)[^\w\s'’-](?=\w)", core))
        bad += flips >= 2 or inner >= 1 or bool(re.search(r"[bcdfghjklmnpqrstvwxz]{5}", core.lower()))
    return bad / len(words)


@F.pandas_udf(DoubleType())
def garbled_share(x: pd.Series) -> pd.Series:
    """Share of words that look misread: case flips, symbols inside, five consonants in a row."""
    return x.map(_garbled)


def rake_phrases(text: str, most: int = 8) -> list[tuple[str, float]]:
    """Phrases between stop words and punctuation, scored by the degree over frequency of their words."""
    phrases: list[tuple[str, ...]] = []
    for chunk in re.split(r"[^\w\s'-]+", (text or "").lower()):
        run: list[str] = []
        for w in [*chunk.split(), ""]:
            if w and w not in STOP_WORDS and not w.isdigit():
                run.append(w)
            elif run:
                phrases.append(tuple(run))
                run = []
    frequency: dict[str, int] = defaultdict(int)
    degree: dict[str, int] = defaultdict(int)
    for p in phrases:
        for w in p:
            frequency[w] += 1
            degree[w] += len(p)
    scored = {" ".join(p): sum(degree[w] / frequency[w] for w in p) for p in phrases}
    return sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:most]


#: Characters of text whose phrases are held at a time, about.
HELD = 1 << 20


def _phrases_and_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """X06, X07 for (id, text): phrases, and a file name of three to five of their words, joined by hyphens; null if there are too few."""
    for batch in batches:
        held, size = [], 0
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            phrases = [p for p, _ in rake_phrases(text)]
            words = list(dict.fromkeys(w for p in phrases for w in p.split()))[:5]
            held.append((batch.column("id")[i].as_py(), phrases, "-".join(words) if len(words) >= 3 else None))
            size += len(text or "")
            if size >= HELD or i + 1 == batch.num_rows:
                kinds = (pa.int64(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["id", "phrases", "name"])
                held, size = [], 0


def phrases_and_names(texts: DataFrame) -> DataFrame:
    """(id, phrases, name) of (id, text); each text is read once for both, and few are held at a time."""
    bounded_batches(texts.sparkSession)
    return texts.select("id", "text").mapInArrow(_phrases_and_names, "id bigint, phrases array<string>, name string")


_STEP1 = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))


def porter_like(word: str) -> str:
    """Suffix stripping in the manner of the published Porter rules for plurals, -ed and -ing."""
    for a, b in _STEP1:
        if word.endswith(a):
            word = word[: len(word) - len(a)] + b
            break
    if word.endswith("eed"):
        word = word[:-1] if len(word) > 4 else word
    else:
        for a in ("ed", "ing"):
            if word.endswith(a) and len(word) > len(a) + 2 and re.search(r"[aeiouy]", word[: -len(a)]):
                word = word[: -len(a)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 2 and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                break
    return word[:-1] + "i" if len(word) > 2 and word.endswith("y") and re.search(r"[aeiou]", word[:-1]) else word


@F.pandas_udf(ArrayType(StringType()))
def stemmed_tokens(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    split = re.compile(r"[^\W_]+").findall
    for x in xs:
        yield x.map(lambda t: [porter_like(w) for w in split((t or "").lower())])
