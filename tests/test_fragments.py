"""Fragment recovery against a plain pass over all clusters."""

import numpy as np
import pytest

from cairnlake.operators.fragments import Limits, recovered_fragments

FACES = "id long, v array<double>, cluster long, file_id long, content_hash string, quality double"


def plain(faces, blocked=(), owners=(), barred=(), p=Limits()):  # noqa: B008
    """{cluster: into}: the pass as it is told, over lists of faces."""
    unit = {f[0]: np.array(f[1]) / np.linalg.norm(f[1]) for f in faces}
    of = {}
    for f in faces:
        of.setdefault(f[2], []).append(f)
    pairs = {frozenset(x) for x in blocked}
    now = {c: {"faces": list(fs), "members": [c], "barred": c in barred} for c, fs in of.items()}
    total = lambda c: sum(unit[f[0]] for f in now[c]["faces"])
    coheres = lambda c: np.linalg.norm(total(c)) / len(now[c]["faces"]) >= p.cohesion

    def seen(fs):
        keys, vectors, out = set(), [], []
        for f in sorted(fs, key=lambda f: (-f[5], f[0])):
            if f[4] is None or f[4] in keys:
                continue
            keys.add(f[4])
            if not any((unit[f[0]] == x).all() for x in vectors):
                vectors.append(unit[f[0]])
                out.append(f)
        return out[: p.witnesses]

    kinds = {}
    for c, fs in of.items():
        n, captures = len(fs), len({f[4] or f"file{f[3]}" for f in fs})
        if c not in owners and coheres(c):
            if 2 <= n <= p.most_small and captures == n:
                kinds[c] = False
            elif max(p.least_large, p.most_small + 1) <= n <= p.most_large and captures / n >= p.large_captures:
                kinds[c] = True
    targets = {c for c in of if len(of[c]) > p.most_small and coheres(c)}
    root = {c: c for c in of}

    def best(c):
        large, hits = kinds[c], []
        for t in {root[t] for t in targets} - {c}:
            fs = now[t]["faces"]
            shared = {f[3] for f in now[c]["faces"]} & {f[3] for f in fs}
            if now[t]["barred"] or shared or not coheres(t) or any(frozenset((x, y)) in pairs for x in now[c]["members"] for y in now[t]["members"]) or (large and len(fs) < p.large_ratio * len(now[c]["faces"])):
                continue
            a, b = total(c), total(t)
            s = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            if s >= (max(p.centroid, p.large_centroid) if large else p.centroid):
                hits.append((-s, min(now[t]["members"]), t))
        hits.sort()
        return hits[0][2] if hits and (len(hits) == 1 or hits[1][0] - hits[0][0] >= p.margin) else None

    def votes(c, target_seen):
        mine = seen(of[c])
        if len(mine) < (p.least_large if kinds[c] else 2) or len(target_seen) < 3:
            return False
        yes = sum(sum(unit[f[0]] @ unit[g[0]] >= p.member for g in target_seen) >= 3 for f in mine)
        return yes >= max(np.ceil(np.float32(len(mine)) * np.float32(0.8)), p.least_large) if kinds[c] else yes == len(mine)

    witnesses = {c: seen(fs) for c, fs in of.items()}
    wishes = [(-len(of[c]), c, t) for c in kinds if (t := best(c)) is not None and votes(c, witnesses[t])]
    out = {}
    for _, c, t in sorted(wishes):
        t = root[t]
        if root[c] != c or best(c) != t or not votes(c, witnesses[t]):
            continue
        if np.linalg.norm(total(c) + total(t)) / (len(now[c]["faces"]) + len(now[t]["faces"])) < p.cohesion:
            continue
        witnesses[t] = seen(witnesses[t] + witnesses[c])
        now[t]["faces"] += now[c]["faces"]
        now[t]["members"] += now[c]["members"]
        now[t]["barred"] |= now[c]["barred"]
        for m in now[c]["members"]:
            root[m] = t
        out[c] = None
    return {c: root[c] for c in out}


def planted(seed, spread=0.28, dims=24):
    """Five people with fragments of many sizes, some near two people, sharing files, without hashes or with copies."""
    rng = np.random.default_rng(seed)
    people = rng.normal(size=(5, dims))
    people /= np.linalg.norm(people, axis=1, keepdims=True)
    people[4] = people[3] + 0.35 * rng.normal(size=dims) / np.sqrt(dims)
    faces, cluster = [], 0

    def add(at, n, wide, fresh=True):
        nonlocal cluster
        cluster += 1
        for k in range(n):
            i = len(faces)
            v = at + wide * rng.normal(size=dims) / np.sqrt(dims)
            h = None if rng.random() < 0.05 else f"h{i if fresh or k % 4 == 0 else i - 1}"
            faces.append((i, v.tolist(), cluster, int(rng.integers(0, 30)) if rng.random() < 0.02 else 1000 + i, h, float(rng.integers(0, 5))))

    for i, n in enumerate((400, 340, 60, 30, 25)):
        add(people[i], n, spread)
    for k in range(40):
        i = int(rng.integers(5))
        add(people[i], int(rng.integers(2, 14)), spread * rng.choice([0.8, 1.0, 2.2]), fresh=k % 5 > 0)
    for i in (0, 0, 1, 2):
        add(people[i], int(rng.integers(16, 24)), spread, fresh=i != 2)
    return faces


@pytest.mark.parametrize("seed", [1, 2])
def test_recovery_is_the_plain_pass(spark, seed):
    faces = planted(seed)
    blocked, owners, barred = [(1, 7), (9, 2), (3, 4)], [10, 12], [3] if seed == 2 else []
    frame = lambda rows, names: spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], names)
    got = recovered_fragments(frame(faces, FACES), frame(blocked, "a long, b long"), frame(owners, "cluster long"), frame(barred, "cluster long"))
    got = {r.cluster: r["into"] for r in got.collect()}
    assert got == plain(faces, blocked, owners, barred)
    sizes = {c: sum(f[2] == c for f in faces) for c in got}
    assert len(got) >= 3 and any(n <= 12 for n in sizes.values()) and (seed > 1 or any(n > 12 for n in sizes.values()))


def test_nothing_to_recover(spark):
    assert recovered_fragments(spark.createDataFrame([], FACES)).collect() == []
    alone = [(i, [1.0, 0.0], 1, i, f"h{i}", 1.0) for i in range(3)] + [(9, [0.0, 0.0], 2, 9, None, None), (10, [1.0, 0.0], None, 10, "x", 1.0)]
    assert recovered_fragments(spark.createDataFrame(alone, FACES)).collect() == []
