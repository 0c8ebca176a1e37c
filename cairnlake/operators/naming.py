"""File names from evidence, and what past renames teach about them."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnlake.functions.text import stem_of, STOP_WORDS

FILLER = frozenset("photo photos picture pictures image images video clip screenshot file frame scene view shot shows showing".split())
RESERVED = frozenset(["con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10))])
WORDS = {"short": 3, "dateFirst": 3, "descriptive": 6}
SOURCES = {"descriptive": ("chapter", "description", "storedName", "tags"), "short": ("chapter", "storedName", "description", "tags"), "dateFirst": ("chapter", "storedName", "description", "tags")}
REASONS = {"storedName": "proposedName"}
LEAST_VOTES, LAST_SAMPLES = 3, 50


@dataclass(frozen=True)
class Learned:
    """What renames teach: how words are joined and cased, which are dropped, how many stay, and where and how dates stand."""

    separator: str = "-"
    case: str = "lower"
    dropped: tuple[str, ...] = ()
    words: int | None = None
    omit_people: bool = False
    leading_date: str = "start"
    trailing_date: str = "end"
    date_format: str = "iso"


def name_words(text: str, without: set[str]) -> list[str]:
    """Words that may name a file: no possessives, stop words, fillers, bare years, or names of people."""
    text = re.sub(r"['’]s\b", "", unicodedata.normalize("NFC", text.lower()))
    out = [w for w in re.findall(r"[^\W_]+", text) if w not in STOP_WORDS and w not in FILLER and w not in without and not re.fullmatch(r"(19|20)\d\d", w)]
    return list(dict.fromkeys(out))


def propose(c: dict, learned: Learned = Learned()) -> tuple[str | None, str]:
    """A name and its source, or None and why not.

    The first source with words counts. Words are taken while the budget lasts: the first word, people, the
    second word, the date, the event, then more words; what does not fit is left out.
    """
    style = c.get("style") or "short"
    people = {w for p in c.get("personNames") or () for w in re.findall(r"[^\W_]+", p.lower())}
    without = people | set(learned.dropped)
    words, reason = [], "noEvidence"
    for source in SOURCES[style]:
        value = c.get(source)
        if value is not None and (found := name_words(" ".join(value) if source == "tags" else value, without)):
            words, reason = found, REASONS.get(source, source)
            break
    event = name_words(c.get("event") or "", set()) if c.get("includeEvent") else []
    if not words and event:
        words, event, reason = event, [], "event"
    if not words:
        return None, "noEvidence"
    confirmed = sorted(p.lower() for p in c.get("people") or ())
    confirmed = confirmed if c.get("includePeople") and not learned.omit_people and 1 <= len(confirmed) <= 2 else []
    most = min(c.get("maxLength") or 255, 255)
    cap = min(WORDS[style], learned.words or WORDS[style])
    date = dated(c["date"], learned.date_format) if c.get("date") else ""
    place = learned.leading_date if style == "dateFirst" else learned.trailing_date if c.get("includeDate") else "none"
    front = f"{date} " if date and place == "start" else ""
    back = date if place == "end" else ""

    def built(take: int, who: list, when: str, what: list) -> str:
        parts = [*who, *what, *words[:take]]
        parts = [p.title() for p in parts] if learned.case == "title" else [p.upper() for p in parts] if learned.case == "upper" else parts
        return front + learned.separator.join(x for x in [*parts, when] if x)

    state: tuple = (1, [], "", [])
    if len(built(*state)) > most:
        return None, "budget"
    for change in (lambda s: (s[0], confirmed, s[2], s[3]), lambda s: (min(2, cap), *s[1:]), lambda s: (s[0], s[1], back, s[3]), lambda s: (*s[:3], event if not learned.words or s[0] + len(event) <= learned.words else []), *(lambda s, n=n: (n, *s[1:]) for n in range(3, cap + 1))):
        new = change(state)
        if new[0] <= max(len(words), 1) and new[0] - state[0] <= 1 and len(built(*new)) <= most:
            state = new
    name = built(*state)
    if name.lower() in RESERVED:
        return None, "reserved"
    plain = lambda x: re.sub(r"[\W_]+", "-", x.lower())
    if plain(name) == plain(c.get("original") or ""):
        return None, "unchanged"
    return name, reason


FORMATS = {"iso": r"\d{4}-\d\d-\d\d", "compact": r"\d{8}", "month": r"\d{4}-\d\d", "year": r"\d{4}"}


def dated(date: str, how: str) -> str:
    """An ISO date in one of FORMATS."""
    return {"iso": date, "compact": date.replace("-", ""), "month": date[:7], "year": date[:4]}[how]


def _parts(name: str) -> tuple[str, str, str, str]:
    """Where a name has its date (start, end, none), the date, its format, and the rest."""
    for how, pattern in FORMATS.items():
        if m := re.match(rf"({pattern})[ _-]+(?=\D)(.*)$", name):
            return "start", m[1], how, m[2]
        if m := re.match(rf"(.*\D)[ _-]({pattern})$", name):
            return "end", m[2], how, m[1].rstrip(" _-")
    return "none", "", "", name


def _won(votes: Counter, least: int = LEAST_VOTES):
    """The choice of more than half of at least `least` votes."""
    if not votes:
        return None
    choice, n = votes.most_common(1)[0]
    return choice if n >= least and 2 * n > sum(votes.values()) else None


def learn(samples: list[dict]) -> Learned:
    """What the last renames {base, applied, people} agree on; a name that was kept votes for things as they are."""
    votes: dict[str, Counter] = {k: Counter() for k in ("separator", "case", "lead", "trail", "format", "words", "people")}
    dropped: Counter = Counter()
    kept: Counter = Counter()
    for sample in samples[-LAST_SAMPLES:]:
        stem = re.sub(r"_\d{1,2}$", "", re.sub(r"\.[^.]+$", "", sample["applied"]))
        place, date, how, core = _parts(stem)
        was, before, _, base = _parts(sample["base"])
        if was != "none" and (place == "none" or dated(before, how) == date):  # a corrected date says nothing
            votes["lead" if was == "start" else "trail"][place] += 1
            if how:
                votes["format"][how] += 1
        if marks := re.findall(r"[-_ ]", core):
            votes["separator"][Counter(marks).most_common(1)[0][0]] += 1
        letters = re.findall(r"[^\W\d_]+", core)
        if letters:
            votes["case"]["upper" if all(w.isupper() for w in letters) else "title" if all(w[0].isupper() for w in letters) else "lower"] += 1
        old, new = ([w.lower() for w in re.findall(r"[^\W_]+", x)] for x in (base, core))
        people = [p.lower() for p in sample.get("people") or ()]
        if people and people[0] in old:
            votes["people"][people[0] not in new] += 1
        old, new = [w for w in old if w not in people], [w for w in new if w not in people]
        if len(new) < len(old) and old[: len(new)] == new and len(new) > 1:
            votes["words"][len(new)] += 1
        else:
            votes["words"][None] += len(old) > 2
            dropped.update(set(old) - set(new))
        kept.update(new)
    most = _won(votes["words"])
    return Learned(
        _won(votes["separator"]) or "-", _won(votes["case"]) or "lower", tuple(sorted(w for w, n in dropped.items() if n >= 2 and n > kept[w])), most, bool(_won(votes["people"])),
        _won(votes["lead"]) or "start", _won(votes["trail"]) or "end", _won(votes["format"]) or "iso",
    )


def propose_names(files: DataFrame, learned: Learned = Learned(), style: str = "short", most: int = 40) -> DataFrame:
    """(id, name, reason) for files (id, original, and any of chapter, storedName, description, tags, event, personNames, people, date)."""
    options = {"style": style, "maxLength": most, "includePeople": True, "includeEvent": True}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [propose({k: v for k, v in r.items() if v is not None} | options, learned) for r in f.to_dict("records")]
            yield pd.DataFrame({"id": f.id, "name": [g[0] for g in got], "reason": [g[1] for g in got]})

    return files.mapInPandas(run, "id bigint, name string, reason string")


def unique_names(proposals: DataFrame, taken: DataFrame, group: str | None = None) -> DataFrame:
    """(id, final): names unique in a folder: taken ones and later files get a number, companions share theirs.

    proposals: (id, folder, name, extension); taken: (folder, name). Files with equal `group` are companions.
    """
    unit = F.coalesce(F.col(group), F.col("id").cast("string")) if group else F.col("id").cast("string")
    p = proposals.withColumn("__unit", unit)
    units = p.groupBy("folder", F.lower("name").alias("__key"), "__unit").agg(F.min("id").alias("__first"))
    used = taken.groupBy("folder", F.lower("name").alias("__key")).agg(F.count(F.lit(1)).alias("__used"))
    n = F.row_number().over(Window.partitionBy("folder", "__key").orderBy("__first"))
    ranked = units.join(used, ["folder", "__key"], "left").withColumn("__n", n + F.coalesce("__used", F.lit(0)))
    j = p.withColumn("__key", F.lower("name")).join(ranked.select("folder", "__key", "__unit", "__n"), ["folder", "__key", "__unit"])
    return j.select("id", F.concat("name", F.when(F.col("__n") > 1, F.concat(F.lit("_"), F.col("__n").cast("string"))).otherwise(F.lit("")), F.lit("."), "extension").alias("final"))


def sequence_names(members: DataFrame, most: int = 60) -> DataFrame:
    """(id, final): names of a group's shots with their number in it.

    members: (id, group, position, path, name). Files of one stem are one shot, numbered by its first position, with a
    leading zero from ten shots on; a single shot keeps its name. A name is cut so that it has `most` characters with its number.
    """
    j = members.withColumn("__stem", F.lower(stem_of(F.col("path"))))
    shots = j.groupBy("group", "__stem").agg(F.min("position").alias("__first"))
    w = Window.partitionBy("group")
    shots = shots.withColumn("__n", F.row_number().over(w.orderBy("__first")).cast("string")).withColumn("__shots", F.count(F.lit(1)).over(w))
    number = F.when(F.col("__shots") >= 10, F.lpad("__n", 2, "0")).otherwise(F.col("__n"))
    number = F.when((F.col("__shots") >= 10) & (F.length("__n") > 2), F.col("__n")).otherwise(number)
    suffix = F.when(F.col("__shots") > 1, F.concat(F.lit(" "), number)).otherwise(F.lit(""))
    base = F.regexp_replace(F.substring(F.col("name"), F.lit(1), F.greatest(F.lit(most) - F.length("__suffix"), F.lit(1))), r"^[ _-]+|[ _-]+$", "")
    named = j.join(shots.withColumn("__suffix", suffix), ["group", "__stem"])
    return named.select("id", F.when(F.col("__suffix") == "", F.col("name")).otherwise(F.concat(base, "__suffix")).alias("final"))
