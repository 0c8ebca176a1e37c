"""Operators against plain computations, and their behaviour on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import text as X
from cairnlake.operators import ann, ask, facts, filters, identity, organize
from cairnlake.operators import retrieval as R
from cairnlake.operators import sessions as T
from cairnlake.operators import similarity as S
from cairnlake.operators.graph import components, survivors
from cairnlake.sources import ingest as I


def test_hamming_join_is_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = [b ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(10))}) for b in base for _ in range(4)] + [0, 0, base[0], base[0]]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, phash long")
    for radius in (0, 3, 8, 16):
        got = sorted((r.a, r.b, r.distance) for r in S.hamming_pairs(df, radius).collect())
        want = [(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if hashes[i] and hashes[j]]
        assert got == sorted(x for x in want if x[2] <= radius)
    with pytest.raises(ValueError):
        S.hamming_pairs(df, 17)


def test_components_and_survivors(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.where("false")).collect() == []
    nodes = spark.createDataFrame([(100, False, 9), (101, True, 1)], "id long, named boolean, files long")
    assert {r.id: r.survivor for r in survivors(edges.where("src = 100"), nodes).collect()} == {100: 101, 101: 101}


def test_cosine_join_and_neighbours_in_blocks(spark):
    rng = random.Random(2)
    v = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos(v[i], v[j]) >= 0.5}
    assert {(r.a, r.b) for r in S.cosine_pairs(df, 0.5, block=16).collect()} == want
    near = {}
    for r in S.nearest(df, 4, block=16).collect():
        near.setdefault(r.id, []).append((r["rank"], r.other))
    assert all([o for _, o in sorted(near[i])] == sorted((j for j in range(60) if j != i), key=lambda j: (-round(cos(v[i], v[j]), 9), j))[:4] for i in range(60))


def test_two_identities_separate_and_copies_join(spark):
    rng = random.Random(3)
    make = lambda axis: [(1.0 if i == axis else 0.0) + rng.gauss(0, 0.05) for i in range(8)]
    rows = [(i, make(0 if i < 15 else 3)) for i in range(30)] + [(50, [0.0] * 7 + [1.0])]
    got = {r.id: r.cluster for r in identity.cluster(spark.createDataFrame(rows, "id long, v array<double>")).collect()}
    assert {got[i] for i in range(15)} == {0} and {got[i] for i in range(15, 30)} == {15} and got[50] == 50


def test_large_groups_split_as_small_ones_do(spark):
    rng = random.Random(4)
    make = lambda axis: [(1.0 if i == axis else 0.0) + rng.gauss(0, 0.3) for i in range(8)]
    df = spark.createDataFrame([(i, make(i % 3)) for i in range(120)], "id long, v array<double>")
    run = lambda most: {r.id: r.cluster for r in identity.cluster(df, core=0.2, assign=0.2, margin=0.0, k=20, mean=0.8, variance=0.02, most=most).collect()}
    assert run(5000) == run(15) and len(set(run(5000).values())) > 3


def test_two_people_in_one_large_cluster_part(spark):
    rng = random.Random(6)
    make = lambda axis: [(1.0 if i == axis else 0.0) + rng.gauss(0, 0.1) for i in range(6)]
    rows = [(i, make(0 if i % 3 else 2), 0) for i in range(90)] + [(100 + i, make(1), 100) for i in range(60)] + [(200 + i, make(i % 2), 200) for i in range(20)]
    got = {r.id: r.cluster for r in identity.bimodal_parts(spark.createDataFrame(rows, "id long, v array<double>, cluster long"), least=50, least_group=20).collect()}
    assert {got[i] for i in range(90) if i % 3} == {1} and {got[i] for i in range(0, 90, 3)} == {0}
    assert {got[100 + i] for i in range(60)} == {100} and {got[200 + i] for i in range(20)} == {200}
    people = spark.createDataFrame([(p, i, v) for i, v, p in rows], "person_id long, id long, v array<double>")
    assert sorted((r.person_id, r.size_a + r.size_b) for r in identity.split_suggestions(people).collect()) == [(0, 90), (200, 20)]


def test_probed_lists_reach_the_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = df.where("id % 50 = 0")
    true = {(r.id, r.other) for r in S.best_matches(asked, df, 11).where("id <> other AND rank <= 11").collect()}
    got = {(r.query, r.id) for r in ann.ann_top_k(df, asked, 10).collect()}
    assert len(got & true) >= 0.9 * len(true)


def test_masks():
    assert len(S.bit_masks(21, 2)) == 232 and S.hamming_blocks(8) == ([(0, 21), (21, 21), (42, 22)], 2)


def test_admission_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1000, 50, 1), (500, 3, 2), (400, 2, 3), (10, 2, 4)], "size_bytes long, n long, first_id long")
    assert sorted(r.first_id for r in identity.admitted(df, 6, 10_000).collect()) == [2, 3]


def plain_bursts(rows, limits):
    """The greedy pass over all shots of a group, in one list."""
    stem = lambda r: r[2].rsplit("/")[-1].rsplit(".")[0]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        time = {}
        for r in own:
            twins = [o[3] for o in own if stem(o) == stem(r) and o[3] is not None and r[3] is not None and o[3] < r[3] and o[5] and r[5] and cos(o[5], r[5]) >= 0.9]
            time[r[1]] = min([*twins, r[3]]) if r[3] is not None else None
        open_ = []
        for r in sorted(own, key=lambda r: (time[r[1]] is None, time[r[1]] or 0, stem(r), r[2], r[1])):
            t = time[r[1]]
            fits = bool(open_) and t is not None and len(open_) < limits.most and t - time[open_[-1][1]] <= limits.gap and t - time[open_[0][1]] <= limits.span
            if fits and not any(stem(o) == stem(r) and o[2] != r[2] for o in open_):
                first, last = open_[0], open_[-1]
                bits = bin((r[4] ^ last[4]) & (2**64 - 1)).count("1") <= limits.bits if r[4] and last[4] else False
                if not (r[5] and first[5] and last[5]):
                    fits = limits.by_hash_alone and bits
                else:
                    to_last = cos(r[5], last[5])
                    fits = cos(r[5], first[5]) >= limits.to_first and (to_last >= limits.to_last or (bits and to_last >= limits.to_first))
            open_ = [*open_, r] if fits else [r]
            out[r[1]] = open_[0][1]
    return out


def test_activity_chapters_and_stills(spark):
    frames = spark.createDataFrame([(1, i * 0.5, 0.03 if 4 <= i <= 20 else 0.0) for i in range(60)] + [(2, 0.0, 0.0), (2, 30.0, 0.5), (3, 0.0, 0.0), (3, 1.0, 0.0)], "f long, seconds double, change double")
    files = spark.createDataFrame([(1, 30.0), (2, 40.0), (3, 5.0)], "f long, duration double")
    w = T.activity_windows(frames, files, ["f"])
    got = sorted((r.f, r.start, r.end, r.times) for r in w.collect())
    assert [g[:3] for g in got if g[0] == 1] == [(1, 1.0 + i * 9.5 / 4, 1.0 + (i + 1) * 9.5 / 4) for i in range(4)]
    assert all(2 <= len(g[3]) <= 6 for g in got) and [g[1:3] for g in got if g[0] == 2][0] == (0.0, 30.0)
    still = sorted((r.f, r["from"], r.to) for r in T.still_spans(w.where("f <> 2"), files, ["f"]).collect())
    assert still == [(1, 0.0, 1.0), (1, 10.5, 30.0), (2, 0.0, 40.0), (3, 0.0, 5.0)]
    said = [(1, 1, 0.0, "red boat harbor"), (1, 2, 1.0, "red boat harbor"), (1, 3, 2.0, "green hills sheep"), (1, 4, 3.0, "green hills sheep"), (1, 5, 4.0, "lonely"), (2, 1, 0.0, "red"), (2, 2, 1.0, "blue"), (3, 1, 0.0, " "), (3, 2, 1.0, "x1 x2"), (3, 3, 2.0, "y1"), (3, 4, 3.0, "y2")]
    c = spark.createDataFrame(said, "f long, id long, seconds double, text string")
    assert sorted((r.f, r.start, r.end) for r in T.chapter_starts(c, ["f"]).collect()) == [(1, 0.0, 1.999), (1, 2.0, None)]


def test_take_groups_and_suggestions(spark):
    row = lambda i, t, x, h, stem: (0, i, f"/f/{stem}.jpg", t, None, [1.0, x], h, 5)
    rows = [row(1, 0.0, 0.0, "a", "s1"), row(2, 1.0, 0.1, "b", "s2"), row(3, 2.0, 0.2, "b", "s3"), row(4, 3.0, 0.1, None, "s1x"), row(5, 900.0, 0.0, "e", "s9"), row(6, 901.0, 9.0, "f", "s8")]
    df = spark.createDataFrame(rows, "g long, id long, path string, seconds double, phash long, v array<double>, content_hash string, size_bytes long")
    got = T.take_groups(df, ["g"]).collect()
    assert [(r.burst, r.shots, r.captured_at, r.similarity) for r in got] == [(1, 3, 3.0, 0.995)]
    found = T.suggested_groups(df, [1, 2, 3, 5, 6]).collect()
    assert [(r.first_id, list(r.members)) for r in found] == [(1, [1, 2, 5])]
    for bad in ([1], [0, 1], list(range(1, 10_002))):
        with pytest.raises(ValueError):
            T.suggested_groups(df, bad)


def test_plans_are_stored_in_pages_and_checked(spark, tmp_path):
    plan = spark.createDataFrame([(1, "/l/a", "/l/x/a", "c", "auto"), (2, "/l/b", "/l/x/A", "c", "auto"), (3, "/l/c", "/m/c", "c", "auto"), (4, "/l/d", "/l/D", "c", "ask"), (5, "/l/e", "/l/x/t", "c", "auto"), (6, "/l/f", "/l/x/f", "c", "auto"), (7, "/l/g", "/l/x/g", "c", "auto"), (8, "/l/h", "/l/x/h", "c", "auto")], "id long, source string, destination string, category string, confidence string")
    organize.store_plan(plan, str(tmp_path / "plan"))
    stored = spark.read.parquet(str(tmp_path / "plan"))
    assert [r.id for r in organize.plan_page(stored, "auto", 1, 2).collect()] == [2, 3]
    files = spark.createDataFrame([(1, "/l/a"), (2, "/l/b"), (3, "/l/c"), (4, "/l/d"), (5, "/l/e"), (7, "/l/g2"), (8, "/l/h"), (9, "/l/x/T")], "id long, path string")
    got = {r.id: r.verdict for r in organize.checked_plan(stored, files, "/l").collect()}
    assert got == {1: "clash", 2: "clash", 3: "outside", 4: "noop", 5: "taken", 6: "missing", 7: "moved", 8: "ok"}


def test_names_terms_and_checks():
    known = {1: ["Ana Maria"], 2: ["Ana"], 3: ["Bo"]}
    assert ask.named("photos of Ana Maria and bo's dog", known) == [1, 3] and ask.named("ana", known) == [2] and ask.named("", known) == []
    assert ask.content_terms("the running dogs of Bo", ["Bo"]) == [("runn", "running"), ("dog", "dogs")]
    assert ask.checks("a dog with a ball, and snow and two people, smiling") == ["a dog", "a ball", "snow", "two people and smiling"]


def test_folder_tiers(spark):
    rows = [("/lib/Downloads", "photo")] * 9 + [("/LIB", "photo")] * 9 + [("/lib/trip", "photo")] * 9 + [("/lib/few", "photo")] * 2 + [("/lib/both", k) for k in ("photo", "video") * 3]
    got = {r.folder: r.tier for r in facts.folder_tiers(spark.createDataFrame(rows, "folder string, category string"), "/lib").collect()}
    assert got == {"/lib/Downloads": "junk", "/LIB": "mixed", "/lib/trip": "anchor", "/lib/few": "junk", "/lib/both": "mixed"}


def test_bursts_windows_and_passages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        v = None if rng.random() < 0.1 else [rng.choice((1.0, 0.9)), rng.random() * 0.6]
        rows.append((i % 2, i, f"/f/{rng.randrange(150)}.{rng.choice(('arw', 'jpg'))}", None if rng.random() < 0.02 else rng.randrange(2000) / 4.0, rng.choice((0, None, 7, -8, 1 << 40)), v))
    df = spark.createDataFrame(rows, "g long, id long, path string, seconds double, phash long, v array<double>")
    for limits in (T.NEAR_DUPLICATES, T.TAKES, T.BurstLimits(3.0, 9.0, 0.99, 0.9, 3, 4, True)):
        assert {r.id: r.burst for r in T.group_bursts(df, ["g"], limits).collect()} == plain_bursts(rows, limits)
    words = [(1, 0, i, float(i), 0.5, "x" * 100, 1.0) for i in range(4)] + [(1, 0, 9, 30.0, 0.5, "late", 1.0)]
    said = spark.createDataFrame(words, "f long, chunk long, id long, timestamp double, duration double, text string, confidence double")
    length = spark.createDataFrame([(1, 60.0)], "f long, length double")
    assert [len(r.text) for r in sorted(T.passages(said, length, ["f"]).collect(), key=lambda r: r.start)] == [201, 201, 4]


def test_fusion_prefers_agreement_then_first_appearance(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    b = spark.createDataFrame([(3, 1), (4, 2)], "id long, rank int")
    assert [r.id for r in R.fuse([a, b]).collect()] == [3, 1, 2, 4]


def test_requests_are_checked():
    filters.check_request("hybrid", 10, "x", [1.0], 1)
    for bad in (("other", 1, "x", None, 1), ("keyword", 0, "x", None, 1), ("keyword", 5, " ", None, 1), ("vector", 5, None, [1.0], 2)):
        with pytest.raises(ValueError):
            filters.check_request(*bad)


def test_questions():
    q = ask.parse("How many photos bigger than 2 MB since 2023-05-01?", today="2024-06-15")
    assert (q.measure, q.filter.kinds, q.filter.above_bytes, q.filter.start, q.filter.end, q.subject) == ("count", ("image",), 2_000_000, 1682899200.0, None, ())
    q = ask.parse("the 7 oldest videos in folder holiday about paris", today="2024-06-15")
    assert (q.order, q.limit, q.filter.folder, q.subject) == ("oldest", 7, "holiday", ("paris",))
    assert ask.parse("pictures from last month", today="2024-03-15").filter.start == 1706745600.0
    assert ask.parse("clips between 2021 and 2022").filter.end == 1672531200.0
    assert ask.parse("photos in summer").filter.months == (6, 7, 8)
    more = ask.refine(q, "only the largest", today="2024-06-15")
    assert more.order == "largest" and more.filter.folder == "holiday" and more.subject == ("paris",)


def test_text_functions(spark):
    assert X.rake_phrases("The quick brown fox. The quick dog and the fox")[0][0] == "quick brown fox"
    assert [X.porter_like(w) for w in ("caresses", "ponies", "hopping", "agreed", "happy")] == ["caress", "poni", "hop", "agree", "happi"]
    row = spark.createDataFrame([("e\u0301", "C:\\a\\b.tar.gz", "con", 1_250_000)], "t string, p string, n string, s long").select(
        X.nfc("t").alias("t"), X.folder_of(X.F.col("p")).alias("f"), X.stem_of(X.F.col("p")).alias("stem"), X.safe_component(X.F.col("n")).alias("n"), X.size_label(X.F.col("s")).alias("s")
    ).first()
    assert tuple(row) == ("é", "C:\\a", "b.tar", "_con", "1.3 MB")


def test_ingest_moves_are_one_to_one(spark):
    gone = spark.createDataFrame([(1, "h", 5, 10.0), (2, "h", 5, 20.0)], "id long, content_hash string, size_bytes long, modified_at double")
    new = spark.createDataFrame([("/a", "h", 5, 11.0)], "path string, content_hash string, size_bytes long, modified_at double")
    assert [tuple(r) for r in I.moved(gone, new).collect()] == [(1, "/a")]


def test_inverted_lists_find_nearly_all_and_exactly_all_when_probed_wholly(spark):
    rng = random.Random(8)
    v = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(400)]
    v += [v[0], v[1]]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    asked = df.where("id % 50 = 0")
    exact = {}
    for r in S.nearest(df, 5).where("id % 50 = 0").collect():
        exact.setdefault(r.id, set()).add(r.other)
    for probes, least in ((8, 0.9), (10_000, 1.0)):
        got = {}
        for r in ann.ann_top_k(df, asked, 5, probes).collect():
            got.setdefault(r.query, set()).add(r.id)
        assert sum(len(got[q] & exact[q]) for q in exact) >= least * sum(map(len, exact.values()))
    assert ann.ann_top_k(df.where("false"), asked, 5).collect() == []
