"""Cannot-links are all pairs of a file's faces."""

from cairnlake.operators.constrained import cannot_links
from cairnlake.plans.registry import ORACLE_SQL, QUERIES


def test_all_pairs(spark):
    faces = [(i, i % 3) for i in range(40)] + [(50, None), (51, None), (7, 1)]
    got = sorted((r.a, r.b) for r in cannot_links(spark.createDataFrame(faces, "id long, file_id long")).collect())
    assert got == sorted((a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3)


def test_query_gives_pairs(spark):
    assert QUERIES["people_cannot_link"](spark, "/root/testdata/sf0.001").columns == ["a", "b"]
    assert "x.id < y.id" in ORACLE_SQL["people_cannot_link"]
