"""Questions in words to filters, and their answers.

A small grammar of its own: what is asked (count, size, list, breakdown), of which kinds, when, how large, in
which folder, how many. Words it does not know are left as the subject.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import STOP_WORDS, base_name
from cairnlake.operators import facts
from cairnlake.operators.filters import Filter

KIND_WORDS = {
    "image": ("photo", "picture", "image", "pic", "shot"), "video": ("video", "movie", "clip", "film"), "audio": ("audio", "song", "recording", "music"),
    "pdf": ("pdf",), "doc": ("document", "doc", "note", "text file"), "model": ("3d model",),
}
UNITS = {"b": 1, "byte": 1, "bytes": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12}
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
SEASONS = {"spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11), "fall": (9, 10, 11), "winter": (12, 1, 2)}


@dataclass(frozen=True)
class Question:
    """measure: count, bytes, list, overview, folders, formats; breakdown: year or month."""

    measure: str = "list"
    order: str = "newest"
    limit: int = 50
    breakdown: str | None = None
    duplicates: bool = False
    filter: Filter = field(default_factory=Filter)
    subject: tuple[str, ...] = ()


def _epoch(d: dt.date) -> float:
    return dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp()


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + d.month // 12, d.month % 12 + 1, 1)


def date_window(text: str, today: dt.date) -> tuple[dt.date | None, dt.date | None, tuple[int, ...], str]:
    """(start, end, months, rest): the window that a date expression names, half-open, and the text without it."""
    day = dt.timedelta(days=1)
    monday = today - day * today.weekday()
    first = today.replace(day=1)
    before = (first - day).replace(day=1)
    named = {
        "today": (today, today + day), "yesterday": (today - day, today), "this week": (monday, monday + 7 * day), "last week": (monday - 7 * day, monday),
        "this month": (first, _next_month(first)), "last month": (before, first), "this year": (dt.date(today.year, 1, 1), dt.date(today.year + 1, 1, 1)),
        "last year": (dt.date(today.year - 1, 1, 1), dt.date(today.year, 1, 1)), "past week": (today - 7 * day, today + day), "past month": (today - 30 * day, today + day), "past year": (today - 365 * day, today + day),
    }
    month = "|".join(sorted(MONTHS, key=len, reverse=True))
    season = "|".join(SEASONS)
    one = rf"(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}} (?:{month}) \d{{4}}|(?:{month}) \d{{1,2}} \d{{4}}|(?:{month}|{season}) \d{{4}}|(?:19|20)\d{{2}}|{'|'.join(named)})"

    def span(x: str) -> tuple[dt.date, dt.date]:
        if x in named:
            return named[x]
        if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", x):
            d = dt.date(*map(int, m.groups()))
            return d, d + day
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", x):
            d = dt.date(int(m[3]), int(m[1]), int(m[2]))
            return d, d + day
        if m := re.fullmatch(r"(\d{1,2}) ([a-z]+) (\d{4})", x) or re.fullmatch(r"(?P<m>[a-z]+) (?P<d>\d{1,2}) (\d{4})", x):
            words = m.groupdict() or {"d": m[1], "m": m[2]}
            d = dt.date(int(m[3]), MONTHS[words["m"]], int(words["d"]))
            return d, d + day
        if (m := re.fullmatch(r"([a-z]+) (\d{4})", x)) and m[1] in SEASONS:
            d = dt.date(int(m[2]), SEASONS[m[1]][0], 1)
            return d, _next_month(_next_month(_next_month(d)))
        if m := re.fullmatch(r"([a-z]+) (\d{4})", x):
            d = dt.date(int(m[2]), MONTHS[m[1]], 1)
            return d, _next_month(d)
        return dt.date(int(x), 1, 1), dt.date(int(x) + 1, 1, 1)

    if m := re.search(rf"\b(?:between|from) {one} (?:and|to) {one}\b", text):
        return span(m[1])[0], span(m[2])[1], (), text.replace(m[0], " ")
    for word, pick in (("since", lambda s: (s[0], None)), ("after", lambda s: (s[1], None)), ("before", lambda s: (None, s[0])), ("until", lambda s: (None, s[1]))):
        if m := re.search(rf"\b{word} {one}\b", text):
            return *pick(span(m[1])), (), text.replace(m[0], " ")
    if m := re.search(rf"\b(?:in |from |on |of )?(?:the )?{one}\b", text):
        return *span(m[1]), (), text.replace(m[0], " ")
    kinds = "|".join(w for words in KIND_WORDS.values() for w in words)
    if m := re.search(rf"\b(?:in|from|during|of)(?: the)? ({season})\b", text) or re.search(rf"\b({season})(?= (?:{kinds})s?\b)", text):
        return None, None, SEASONS[m[1]], text.replace(m[0], " ")
    if m := re.search(rf"\b(?:in|from|during|of|on) ({month})\b(?! \d)", text):
        return None, None, (MONTHS[m[1]],), text.replace(m[0], " ")
    return None, None, (), text


def month_day(text: str) -> tuple[tuple[int, int] | None, str]:
    """A day of any year, and the text without it."""
    month = "|".join(sorted(MONTHS, key=len, reverse=True))
    if m := re.search(rf"\b(?:(?:from|on|in) )?(?:the )?(?:(?P<m>{month}) (?P<d>\d{{1,2}})(?:st|nd|rd|th)?|(?P<e>\d{{1,2}})(?:st|nd|rd|th)? (?:of )?(?P<n>{month}))\b(?! ?\d{{4}})", text):
        return (MONTHS[m["m"] or m["n"]], int(m["d"] or m["e"])), text.replace(m[0], " ")
    return None, text


def size_bounds(text: str) -> tuple[int | None, int | None, str]:
    """(above, below, rest): exclusive bounds in decimal units."""
    above = below = None
    number = r"(\d+(?:\.\d+)?) ?(%s)\b" % "|".join(sorted(UNITS, key=len, reverse=True))
    if m := re.search(rf"\b(?:(?:bigger|larger|more|over|above)(?: than)?|at least) {number}", text):
        above, text = int(float(m[1]) * UNITS[m[2]]), text.replace(m[0], " ")
    if m := re.search(rf"\b(?:(?:smaller|less|under|below)(?: than)?|at most) {number}", text):
        below, text = int(float(m[1]) * UNITS[m[2]]), text.replace(m[0], " ")
    return above, below, text


ORDERS = {"largest": "largest|biggest|heaviest", "smallest": "smallest|tiniest", "oldest": "oldest|earliest", "newest": "newest|latest|most recent"}
MEASURES = (
    ("overview", r"\b(?:what(?:'s| is) in my library|(?:summarize|summarise|describe) my library|library (?:overview|summary)|(?:how many )?of each (?:file )?(?:type|kind)|break ?down my files(?: by (?:type|kind))?|(?:what|which) (?:file )?(?:types|kinds)\b.*)"),
    ("formats", r"\b(?:what|which) (?:file )?(?:formats|extensions)\b.*"), ("folders", r"\b(?:which|what) folders?\b.*|\b(?:what are )?(?:my )?(?P<order>largest|biggest|top) folders?\b.*"),
    ("bytes", r"\b(?:how much (?:space|storage|disk|room)|total size|how big)\b|\bwhat(?:'s| is) (?:taking up|using)(?: the)? (?P<most>most) (?:space|storage)\b"), ("count", r"\b(?:how many|count|number of)\b"),
)
RAW = ("arw", "cr2", "cr3", "dng", "nef", "orf", "raf", "raw", "rw2")
FORMATS = ("avi", "docx", "gif", "heic", "jpeg", "jpg", "mkv", "mov", "mp3", "mp4", "png", "pptx", "txt", "wav", "webp", "xlsx")
COMMON_FOLDERS = ("desktop", "documents", "downloads", "movies", "music", "pictures")


def _ordered(q: Question, text: str) -> tuple[Question, str]:
    """Order and limit words; a number is a limit only beside an order, top or first."""
    for order, words in ORDERS.items():
        if m := re.search(rf"\b(?:(\d{{1,3}}) )?(?:{words})\b", text):
            q, text = replace(q, order=order, limit=_limit(m[1], q.limit)), text.replace(m[0], " ")
            break
    if m := re.search(r"\btop (\d{1,3})\b", text):
        q, text = replace(q, order="largest", limit=_limit(m[1], q.limit)), text.replace(m[0], " ")
    if m := re.search(r"\bfirst (\d{1,3})\b", text):
        q, text = replace(q, limit=_limit(m[1], q.limit)), text.replace(m[0], " ")
    if m := re.search(r"\b(?:sorted |ordered )?by (size|date)\b", text):
        q, text = replace(q, order="largest" if m[1] == "size" else "newest"), text.replace(m[0], " ")
    return q, text


def _limit(number: str | None, before: int) -> int:
    return max(1, min(int(number), 100)) if number else before


def parse(question: str, today: str | None = None) -> Question:
    """A question to what it asks."""
    now = dt.date.fromisoformat(today) if today else dt.datetime.now(dt.timezone.utc).date()
    text = re.sub(r"\s+", " ", re.sub(r"[?!,]", " ", question.lower())).strip()
    q, f = Question(), Filter()
    if m := re.search(r"\b(?:by|per|each) (year|month)\b|\b(year|month)ly\b", text):
        q, text = replace(q, breakdown=m[1] or m[2], measure="count"), text.replace(m[0], " ")
    for measure, pattern in MEASURES:
        if m := re.search(pattern, text):
            most = any(v for v in m.groupdict().values())
            q, text = replace(q, measure=measure, order="largest" if most else q.order), text.replace(m[0], " ")
            break
    if m := re.search(r"\bduplicates?\b|\bextra copies\b", text):
        q, text = replace(q, duplicates=True), text.replace(m[0], " ")
    if m := re.search(r"\b(?:without|no|missing) (?:a )?descriptions?\b|\b(?:not|un) ?described(?: yet)?\b", text):
        f, text = replace(f, undescribed=True), text.replace(m[0], " ")
    above, below, text = size_bounds(text)
    start, end, months, text = date_window(re.sub(r"\s+", " ", text), now)
    day, text = (None, text) if start or end or months else month_day(text)
    f = replace(f, above_bytes=above, below_bytes=below, start=_epoch(start) if start else None, end=_epoch(end) if end else None, months=months, day=day)
    if m := re.search(r"\b(?:in|from|inside|under) (?:the |my )?(?:folder )?[\"']?([\w.-]+)[\"']? folder\b|\bfolder [\"']?([\w.-]+)[\"']?|\bin (?:the |my )?(%s)\b" % "|".join(COMMON_FOLDERS), text):
        f, text = replace(f, folder=next(x for x in m.groups() if x)), text.replace(m[0], " ")
    q, text = _ordered(q, text)
    if m := re.search(r"\braws?\b", text):
        f, text = replace(f, extensions=RAW), text.replace(m[0], " ")
    elif m := re.search(r"\b(%s)s?\b" % "|".join(FORMATS), text):
        f, text = replace(f, extensions=(m[1],)), text.replace(m[0], " ")
    kinds = tuple(k for k, words in KIND_WORDS.items() if re.search(r"\b(?:%s)s?\b" % "|".join(words), text))
    for words in KIND_WORDS.values():
        text = re.sub(r"\b(?:%s)s?\b" % "|".join(words), " ", text)
    skip = {*STOP_WORDS, "files", "file", "show", "list", "find", "many", "much", "please", "get", "see", "only", "instead", "are", "there", "take", "taken", "use", "library", "totals", "may", "last"}
    return replace(q, filter=replace(f, kinds=kinds), subject=tuple(w for w in re.findall(r"[^\W_]+", text) if w not in skip))


def refine(before: Question, follow_up: str, today: str | None = None) -> Question:
    """Q03: a follow-up changes what it names and keeps the rest of the question before."""
    new = parse(follow_up, today)
    kept = {k: v for k, v in vars(new.filter).items() if v not in (None, (), False)}
    changed = {k: getattr(new, k) for k in ("order", "limit", "breakdown", "measure") if getattr(new, k) != getattr(Question(), k)}
    return replace(before, **changed, filter=replace(before.filter, **kept), subject=new.subject or before.subject)


def answer(q: Question, files: DataFrame, faces: DataFrame) -> DataFrame:
    """Q04: the rows that answer a question."""
    found = q.filter.apply(files, faces)
    if q.subject:
        name = F.lower(F.concat_ws(" ", "path", F.coalesce("description", F.lit(""))))
        for w in q.subject:
            found = found.where(name.contains(w))
    if q.duplicates:
        counts = found.groupBy("content_hash", "size_bytes").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        found = found.join(counts, ["content_hash", "size_bytes"], "left_semi")
    if q.breakdown:
        return facts.by_period(found, "yyyy" if q.breakdown == "year" else "yyyy-MM")
    if q.measure in ("count", "bytes"):
        return facts.totals(found)
    if q.measure == "overview":
        return facts.overview(found)
    if q.measure == "folders":
        return facts.folder_totals(found)
    if q.measure == "formats":
        return facts.counts_by(found, F.coalesce(F.lower("extension"), F.lit("none")), "format")
    return facts.listing(found, q.order, q.limit)


NEGATION = re.compile(r"\b(?:except|without|not|excluding)\b")
FILL = frozenset("please show me find files file of my the a an some see get can could you i want to search for only now just them those these and".split())
PRONOUNS = frozenset("he she it they him her his their there that this".split())


def search_plan(messages: list[str]) -> tuple[str, tuple[str, ...]]:
    """Q03: (query, kinds) of a conversation: each message keeps, narrows, extends or replaces what came before.

    A message of kinds alone changes the kinds; "all" drops the subject; "and" adds words; pronouns keep the kinds;
    anything else begins anew. A message with a negation is searched as it is.
    """
    query, kinds = "", ()
    for i, message in enumerate(messages):
        text = re.sub(r"[\"'“”‘’?!.,]", " ", message.lower()).strip()
        if NEGATION.search(text):
            query, kinds = " ".join(text.split()), ()
            continue
        found = tuple(k for k, words in KIND_WORDS.items() if re.search(r"\b(?:%s)s?\b" % "|".join(words), text))
        if "doc" in found and re.search(r"\bdocuments?\b", text):
            found = tuple(sorted({*found, "pdf"}))
        rest = text
        for words in KIND_WORDS.values():
            rest = re.sub(r"\b(?:%s)s?\b" % "|".join(words), " ", rest)
        every = bool(re.search(r"\ball\b", rest))
        said = [w for w in rest.split() if w not in FILL and w not in PRONOUNS and w not in ("all", "is", "are", "was", "does", "do")]
        if every and not said:
            query, kinds = "", found
        elif not i:
            query, kinds = " ".join(said), found
        elif not said:
            kinds = found or kinds
        elif re.match(r"and\b", text):
            query, kinds = f"{query} {' '.join(said)}".strip(), found or kinds
        elif PRONOUNS & set(text.split()):
            query, kinds = " ".join(said), found or kinds
        else:
            query, kinds = " ".join(said), found
    return query, kinds


def named(text: str, known: dict) -> list:
    """The ids of known people or events (id: names) that a request names, by whole words in order, longest names first."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = []
    taken: set[int] = set()
    names = sorted(((tuple(w for w in re.split(r"[\W_]+", n.lower()) if w), i) for i, each in known.items() for n in each), key=lambda x: (-len(x[0]), str(x)))
    for name, i in names:
        for at in range(len(words) - len(name) + 1):
            if name and tuple(words[at : at + len(name)]) == name and not taken & set(range(at, at + len(name))):
                taken |= set(range(at, at + len(name)))
                if i not in found:
                    found.append(i)
    return found


def content_terms(text: str, names: list[str] = ()) -> list[tuple[str, str]]:
    """(stem, word) of a request's words that say what to look for, once each: no stop words and no names."""
    skip = set(STOP_WORDS) | {w for n in names for w in re.split(r"[\W_]+", n.lower())}
    out: dict[str, str] = {}
    for w in re.split(r"[\W_]+", text.lower()):
        if w and w not in skip:
            stem = w[:-3] if len(w) > 5 and w.endswith("ing") else w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w
            out.setdefault(stem, w)
    return list(out.items())


def checks(text: str, most: int = 4) -> list[str]:
    """A request's parts between "and", "with" and commas, each to be checked by itself; `most` at most, the last takes the rest."""
    parts = [p.strip() for p in re.split(r"\s*,\s*(?:and\s+)?|\s+(?:and|with)\s+", text.strip(" ?.!")) if p.strip()]
    return parts if len(parts) <= most else [*parts[: most - 1], " and ".join(parts[most - 1 :])]


def flat(text: Column, most: int) -> Column:
    """A text on one line, cut."""
    return F.substring(F.array_join(F.filter(F.split(text, r"[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"), lambda x: x != ""), " "), 1, most)


def history_blocks(messages: DataFrame, turns: int, chars: int) -> DataFrame:
    """Q07: (conv, block): the last turns of conversations (conv, turn, role, text) as lines for a prompt; empty ones say nothing."""
    recent = messages.withColumn("r", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").desc()))).where(F.col("r") <= turns)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), flat(F.col("text"), chars))
    said = recent.where(F.trim(flat(F.coalesce("text", F.lit("")), chars)) != "").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return said.select("conv", F.concat(F.lit("Earlier in this conversation:\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")).alias("block"))


def evidence_lines(hits: DataFrame, limit: int, chars: int = 400) -> DataFrame:
    """Q07: (n, line): ranked hits (rank, path, kind, seconds, page, text) as numbered lines of evidence."""
    place = F.array_join(F.array_compact(F.array("kind", F.when(F.col("seconds").isNotNull(), F.format_string("at %.0f s", "seconds")), F.when(F.col("page").isNotNull(), F.format_string("page %d", "page")))), ", ")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), base_name(F.col("path")), F.lit(" ("), place, F.lit("): "), flat(F.coalesce("text", F.lit("")), chars))
    return hits.where(F.col("rank") <= limit).select(F.col("rank").alias("n"), line.alias("line"))
