"""Names of groups by the words that mark them, counted without a row for each word and file."""

import math
import random

import pytest

from cairnlake.operators import organize as O


def plain(rows, most=2):
    files = {}
    for g, i, t in rows:
        files.setdefault((g, i), set()).update(t or [])
    files = {k: v for k, v in files.items() if v}
    out = {}
    for g in {k[0] for k in files}:
        own = [v for k, v in files.items() if k[0] == g]
        score = lambda w: round(sum(w in v for v in own) / len(own) * math.log(len({i for _, i in files}) / len({i for (_, i), v in files.items() if w in v})), 9)  # noqa: B023, E731
        best = sorted((-score(w), w) for w in set().union(*own) if score(w) > 0)[:most]
        out[g] = " ".join(w.capitalize() for _, w in best) if best else None
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_names_are_those_of_plain_counts(spark, monkeypatch, repeated):
    rng = random.Random(3)
    words = [f"word{c}" for c in "abcdefghijklmnop"]
    rows = [(f"g{rng.randint(0, 4)}", i, rng.choices(words[: 4 + i % 12], k=rng.randint(0, 6)) + ["each"] * (i % 2)) for i in range(300)]
    if repeated:  # ids of several rows, of one group and of several
        rows += [(f"g{rng.randint(0, 6)}", i, rng.choices(words, k=3)) for i in range(0, 300, 7)] + [("g1", 5, None), ("g6", 5, ["worda"])]
    asked = []
    staged = O.staged
    monkeypatch.setattr(O, "staged", lambda df: asked.append(staged(df)) or asked[-1])
    got = {r.group: r.name for r in O.group_names(spark.createDataFrame(rows, "group string, id long, tokens array<string>")).collect()}
    assert got == plain(rows)
    # what is written is a count for each group and word, and rows of words only for repeated ids
    assert asked[1].count() <= 7 * 17 and len(asked) == 2 + repeated
