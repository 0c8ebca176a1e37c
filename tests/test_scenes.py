"""Scenes of sampled frames against a frame-by-frame account."""

import numpy as np

from cairnlake.operators.sessions import SceneLimits, scenes

FRAMES = "video string, id long, seconds double, v array<double>"


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


def plain(frames, duration, p):
    """[(start, end, representative, frames)] of one video."""
    frames = sorted(frames, key=lambda f: (f[1], f[0]))
    parts, current, unlike = [], [frames[0]], 0
    for k, f in enumerate(frames[1:], 1):
        v, length = f[2], f[1] - current[0][1]
        if length >= p.most:
            parts.append(current)
            current, unlike = [f], 0
            continue
        alike = cos(v, sum(x[2] for x in current)) >= p.cut and cos(v, current[0][2]) >= p.drift
        unlike = 0 if alike or length < p.least else unlike + 1
        current.append(f)
        if unlike >= p.confirm:
            parts.append(current[: -p.confirm])
            current, unlike = frames[k + 1 - p.confirm : k + 1], 0
    parts.append(current)
    out = []
    for n, part in enumerate(parts):
        mean = sum(x[2] for x in part)
        best = max(range(len(part)), key=lambda i: (cos(part[i][2], mean), -i))
        out.append((0.0 if n == 0 else part[0][1], parts[n + 1][0][1] if n + 1 < len(parts) else duration, part[best][0], len(part)))
    return out


def test_scenes_are_those_of_the_account(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for video in range(6):
        looks = rng.normal(size=(8, 6))
        at, frames = 0, []
        for k in range(160):
            at = at if rng.random() > 0.07 else int(rng.integers(8))
            look = looks[int(rng.integers(8))] if rng.random() < 0.05 else looks[at]
            frames.append((video * 1000 + k, k * 0.5, look + (0.2 + 0.1 * video) * rng.normal(size=6)))
        rows += [(f"v{video}", i, t, v.tolist()) for i, t, v in frames]
        want[f"v{video}"] = plain(frames, 80.0, SceneLimits())
    df = spark.createDataFrame(rows, FRAMES).repartition(4)
    durations = spark.createDataFrame([(f"v{k}", 80.0 if k < 6 else 0.0) for k in range(7)], "video string, duration double")
    got = {}
    for r in scenes(df, durations, ["video"]).orderBy("video", "scene").collect():
        got.setdefault(r.video, []).append((r.start, r.end, r.representative, r.frames))
    assert got == want and all(len(x) > 3 for x in want.values())


def test_no_frames_and_no_duration(spark):
    none = spark.createDataFrame([], FRAMES)
    durations = spark.createDataFrame([("a", -1.0), ("b", 5.0)], "video string, duration double")
    assert scenes(none, durations, ["video"]).collect() == []
    one = spark.createDataFrame([("a", 1, 0.0, [1.0]), ("b", 2, 1.5, [0.0])], FRAMES)
    assert [tuple(r) for r in scenes(one, durations, ["video"]).collect()] == [("b", 0, 0.0, 5.0, 2, 1)]
