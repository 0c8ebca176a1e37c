"""Take proposals against a plain pass, sessions against a loop, and what a second run does again."""

import hashlib
import random

import numpy as np

from cairnlake.operators import proposals as P

FILES = "id long, kind string, path string, extension string, seconds double, camera string, content_hash string, size_bytes long, modified_at double, v array<double>"
SUBJECTS = "file_id long, person long"


def plain_sessions(files, gap, most):
    """[(media, rows)] of files that may be proposed."""
    seen, out = set(), []
    live = []
    for f in sorted(files):
        i, kind, _, _, t, _, h, n, _, v = f
        if kind not in ("image", "video") or t is None or np.isnan(t) or v is None:
            continue
        if h is not None and n is not None and 0 <= n <= 16 << 20:
            if (h, n) in seen:
                continue
            seen.add((h, n))
        live.append(f)
    for kind in ("image", "video"):
        rows = []
        for f in sorted((f for f in live if f[1] == kind), key=lambda f: (f[4], f[0])):
            if rows and (f[4] - rows[-1][4] > gap or len(rows) >= most):
                out.append((kind, rows))
                rows = []
            rows.append(f)
        if rows:
            out.append((kind, rows))
    return out


def plain(files, subjects, limits, gap, most):
    """{(key, relation, ids, evidence, similarity, captured_at)} of all sessions."""
    people = {}
    for f, p in subjects:
        people.setdefault(f, set()).add(p)
    out = set()
    for kind, rows in plain_sessions(files, gap, most):
        lim = limits[kind]
        groups, active = [], []
        for i, _, path, ext, t, camera, _, _, _, v in rows:
            v, own = np.array(v), people.get(i, set())
            if abs(v @ v - 1) > 0.02:
                continue
            v = v / np.sqrt(v @ v)
            active = [g for g in active if t - g["latest"] <= lim.gap and t - g["first"] <= lim.span]
            best = None
            for g in active:
                if len(g["rows"]) >= 100 or (own and g["known"] and not own & g["known"]):
                    continue
                s = float(v @ g["v"])
                if s >= (lim.with_subject if own & g["common"] else lim.alike) and (best is None or s > best[0]):
                    best = (s, g)
            stem = path.rsplit("/", 1)[1].rsplit(".", 1)[0].lower()
            row = (i, stem, ext.lower() in P.RAW, t, camera.strip() if camera and camera.strip() else None)
            if best:
                s, g = best
                g["rows"].append(row)
                g["latest"], g["low"] = t, min(g["low"], s)
                g["common"], g["known"] = g["common"] & own, g["known"] | own
            else:
                active = active[1:] if len(active) >= 32 else active
                g = {"v": v, "first": t, "latest": t, "rows": [row], "common": set(own), "known": set(own), "low": 1.0}
                active.append(g)
                groups.append(g)
        for g in groups:
            shots = {}
            for r in g["rows"]:
                shots.setdefault(r[1], []).append(r)
            if len(shots) < 2:
                continue
            firsts = sorted(((min(r[3] for r in rs), min(rs, key=lambda r: (r[2], r[0]))) for rs in shots.values()), key=lambda x: (x[0], x[1][0]))
            firsts = [r for _, r in firsts]
            pairs = [(a, b) for k, a in enumerate(firsts) for b in firsts[k + 1 :]]
            if any(a[4] and b[4] and a[4] != b[4] and abs(a[3] - b[3]) <= lim.at_once for a, b in pairs):
                relation = ("alternateViews", "simultaneousCameras")
            elif any(r[4] is None for r in firsts):
                relation = ("uncertain", "cameraDetailsMissing")
            else:
                relation = ("repeatedAttempts", "sameCamera") if len({r[4] for r in firsts}) == 1 else ("uncertain", "mixedCameras")
            ids = sorted(r[0] for r in g["rows"])
            evidence = ("captureSession", "visualSimilarity", *(["sharedSubject"] if g["common"] else []), relation[1])
            key = "takes-" + hashlib.sha256(",".join(map(str, ids)).encode()).digest()[:8].hex()
            out.add((key, relation[0], tuple(ids), evidence, round(max(0.0, min(1.0, g["low"])), 4), max(r[3] for r in g["rows"])))
    return out


def library(n=420, seed=3):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    scenes = rng.normal(size=(9, 12))
    files, t = [], 1e9
    for i in range(n):
        t += r.choice([1, 1, 5, 30, 110, 400] if i % 60 else [4000])
        v = scenes[r.randrange(9) if r.random() < 0.3 else i // 25 % 9] + 0.22 * rng.normal(size=12)
        v = v / np.linalg.norm(v)
        kind = r.choice(["image", "image", "image", "video", "doc"])
        ext = {"image": r.choice(["jpg", "ARW"]), "video": "mp4", "doc": "pdf"}[kind]
        files.append((
            i, kind, f"/p/{'IMG' if r.random() < 0.8 else 'img'}_{i - (r.random() < 0.15)}.{ext}", ext, None if i % 97 == 5 else float("nan") if i % 97 == 6 else t - (t if i % 211 == 7 else 0),
            r.choice(["A", "A", "A", " B ", "", None]), f"h{i - (i % 13 == 4)}" if i % 5 else None, 17 << 20 if i % 26 == 4 else 10, 1.0, None if i % 89 == 3 else (v * (3 if i % 83 == 1 else 1)).tolist(),
        ))
    return files, [(r.randrange(n), r.randrange(4)) for _ in range(n // 2)]


def test_proposals_and_sessions_are_those_of_a_plain_pass(spark):
    files, subjects = library()
    df, who = spark.createDataFrame(files, FILES).repartition(5), spark.createDataFrame(subjects, SUBJECTS)
    photos, videos = P.TakeLimits(120.0, 900.0, 0.90, 0.80, 2.0), P.TakeLimits(1200.0, 7200.0, 0.88, 0.84, 30.0)
    for gap, most in ((1800.0, 2000), (300.0, 7)):
        got, members = P.take_proposals(df, who, photos, videos, gap, most)
        want = plain(files, subjects, {"image": photos, "video": videos}, gap, most)
        rows = {(r.key, r.relation, tuple(r.file_ids), tuple(r.evidence), r.similarity, r.captured_at) for r in got.collect()}
        assert {x[:4] for x in rows} == {x[:4] for x in want} and len(want) > (8 if most > 7 else 1)
        of = {x[0]: x for x in want}
        assert all(abs(x[4] - of[x[0]][4]) <= 1e-4 and x[5] == of[x[0]][5] for x in rows)
        sessions = {}
        for r in members.collect():
            sessions.setdefault(r.session, set()).add(r.file_id)
        assert sorted(map(sorted, sessions.values())) == sorted(sorted(f[0] for f in rows) for _, rows in plain_sessions(files, gap, most))


def test_a_second_run_takes_changed_sessions_alone(spark):
    files, subjects = library(240)
    who = spark.createDataFrame(subjects, SUBJECTS)
    old, members = P.take_proposals(spark.createDataFrame(files, FILES), who)
    stored = members.cache()
    again, _ = P.take_proposals(spark.createDataFrame(files, FILES), who, stored=stored)
    assert again.count() == 0
    late = [f[:5] + ("Other", *f[6:]) if f[0] == 200 else f for f in files if f[0] != 30]
    new, now = P.take_proposals(spark.createDataFrame(late, FILES), who, stored=stored)
    whole, _ = P.take_proposals(spark.createDataFrame(late, FILES), who)
    touched = {r.session for r in new.collect()}
    key = lambda df: sorted((r.session, r.key, r.relation, r.similarity) for r in df.collect())
    assert key(P.refreshed(old, new, now, stored)) == key(whole) and len(touched) < len({r.session for r in whole.collect()})


def test_empty_library(spark):
    got, members = P.take_proposals(spark.createDataFrame([], FILES), spark.createDataFrame([], SUBJECTS))
    assert got.collect() == [] and members.collect() == []


def test_recommendations(spark):
    rows = [
        ("none", None, 1, False, False, 0.9, 0.9, 0.5), ("none", None, 2, False, False, 0.2, 0.9, 0.5), ("one", "g", 3, False, False, 0.9, 0.9, 0.5),
        ("liked", "g", 4, True, False, None, None, None), ("liked", "g", 5, True, True, 0.9, 0.9, 0.5), ("both", "g", 6, True, False, 0.9, 0.9, 0.5), ("both", "g", 7, True, False, 0.9, 0.9, 0.5),
        ("stale", "g", 8, False, True, 0.9, 0.9, 0.5), ("stale", "g", 9, False, False, 0.9, 0.9, 0.5), ("weak", "g", 10, False, False, 0.4, 0.9, 0.5), ("weak", "g", 11, False, False, 0.3, 0.65, 0.5),
        ("clear", "g", 12, False, False, 0.9, 0.9, None), ("clear", "g", 13, False, False, 0.8, 0.65, 0.5), ("sharp", "g", 14, False, False, 0.9, 0.9, 0.5), ("sharp", "g", 15, False, False, 0.88, 0.9, 0.7),
        ("even", "g", 16, False, False, 0.9, 0.9, 0.5), ("even", "g", 17, False, False, 0.88, 0.9, 0.55), ("unknown", "g", 18, False, False, 0.9, 0.9, 0.5), ("unknown", "g", 19, False, False, 0.9, 0.9, None),
    ]
    df = spark.createDataFrame(rows, "event string, goal string, file_id long, preferred boolean, stale boolean, outcome double, confidence double, quality double")
    got = {r.event: (r.status, r.file_ids) for r in P.recommendations(df).collect()}
    assert got == {
        "none": ("insufficient", []), "one": ("insufficient", []), "liked": ("preferred", [4]), "both": ("tie", [6, 7]), "stale": ("insufficient", []), "weak": ("insufficient", []),
        "clear": ("ranked", [12]), "sharp": ("ranked", [15]), "even": ("tie", [16, 17]), "unknown": ("tie", [18, 19]),
    }


def test_discovered_takes(spark):
    from test_operators import plain_bursts

    from cairnlake.operators import sessions as T

    r, rng = random.Random(8), np.random.default_rng(8)
    looks, files, t = rng.normal(size=(12, 6)), [], 1.7e9
    for i in range(1, 221):
        t += r.choice([0.5, 1, 2, 3, 60, 40_000]) if i % 25 else 9e5
        v = looks[i // 9 % 12] + 0.12 * rng.normal(size=6)
        kind = "video" if i % 50 > 40 else "image"
        files.append((i, kind, f"/p/s{i - (i % 6 == 5)}.{'mp4' if kind == 'video' else 'arw' if i % 2 else 'jpg'}", "arw" if i % 2 else "jpg", None if i % 71 == 9 else t, None, None if i % 43 == 7 else v.tolist(), f"h{i - (i % 11 == 3)}" if i % 4 else None, 17 << 20 if i % 22 == 3 else 9))
    names = "id long, kind string, path string, extension string, seconds double, phash long, v array<double>, content_hash string, size_bytes long"
    groups = {}
    for kind, limits in (("image", T.TAKES), ("video", T.CLIPS)):
        own = [f for f in files if f[1] == kind and f[4] is not None]
        rows = [(0, f[0], f[2], f[4], f[5], f[6]) for f in own]
        times = {}  # of two files of a stem that look alike the later has the earlier one's time
        for f in own:
            stem = f[2].rsplit("/")[-1].rsplit(".")[0]
            same = [o for o in own if o[2].rsplit("/")[-1].rsplit(".")[0] == stem and o[6] and f[6] and np.dot(o[6], f[6]) / np.linalg.norm(o[6]) / np.linalg.norm(f[6]) >= 0.9]
            times[f[0]] = min([f[4], *(o[4] for o in same)])
        bursts = {}
        for i, b in plain_bursts(rows, limits).items():
            bursts.setdefault(b, []).append(i)
        by = {f[0]: f for f in own}
        for ids in bursts.values():
            seen, kept = set(), []
            for i in sorted(ids):
                c = (by[i][7], by[i][8]) if by[i][7] and by[i][8] <= 16 << 20 else i
                if c not in seen:
                    seen.add(c)
                    kept.append(i)
            shots = {}
            for i in kept:
                shots.setdefault(by[i][2].rsplit("/")[-1].rsplit(".")[0], []).append(i)
            if len(shots) < 2:
                continue
            first = sorted((min(times[i] for i in s), min(s, key=lambda i: (by[i][3] in P.RAW, i))) for s in shots.values())
            vs = [np.array(by[i][6]) for _, i in first if by[i][6]]
            low = min([1.0, *(a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(vs, vs[1:], strict=False))])
            key = "takes-" + hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest()[:16]
            groups[key] = ("photos" if kind == "image" else "videos", kept, len(shots), max(times[i] for i in kept), low)
    some = sorted(groups, key=lambda k: groups[k][1])
    decisions = [("keepAll", [*groups[some[0]][1], 999]), ("skip", groups[some[1]][1]), ("keepAll", groups[some[2]][1][:-1])]
    shown = {k: g for k, g in groups.items() if k != some[0]}
    newest = max(g[3] for g in shown.values())
    value = lambda k: 0.6 * min(shown[k][2], 12) / 12 + 0.4 * 0.5 ** ((newest - shown[k][3]) / 86400 / 14)
    want = sorted(shown, key=lambda k: (k == some[1], -value(k), -shown[k][3], k))
    got = P.discovered_takes(spark.createDataFrame(files, names).repartition(4), spark.createDataFrame(decisions, "decision string, file_ids array<long>")).orderBy("rank").collect()
    assert [r.key for r in got] == want and len(want) > 8 and [r.rank for r in got] == list(range(1, len(want) + 1))
    assert all((r.media, list(r.file_ids), r.shots, r.captured_at) == shown[r.key][:4] and abs(r.similarity - shown[r.key][4]) < 1e-4 and (r.status == "skipped") == (r.key == some[1]) for r in got)
