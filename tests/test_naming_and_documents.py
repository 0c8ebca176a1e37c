"""Names, identities under rulings, conversations, and text from document bytes."""

import io
import zipfile

import pytest

from cairnlake.operators import ask, identity
from cairnlake.operators import naming as N
from cairnlake.sources import documents as D


def test_budget_takes_people_before_more_words():
    case = {"style": "short", "storedName": "kim-red-kite-flying", "personNames": ["Kim"], "people": ["Kim"], "includePeople": True, "original": "IMG_1"}
    assert N.propose(case | {"maxLength": 40}) == ("kim-red-kite-flying", "proposedName")
    assert N.propose(case | {"maxLength": 8}) == ("kim-red", "proposedName")
    assert N.propose(case | {"maxLength": 2}) == (None, "budget")
    assert N.propose({"original": "x"}) == (None, "noEvidence")
    assert N.propose({"original": "Red_Kite", "storedName": "red kite"}) == (None, "unchanged")


def test_renames_teach_after_three_votes():
    two = [{"base": "red-kite", "applied": "Red_Kite.jpg"}, {"base": "old-barn", "applied": "Old_Barn.jpg"}]
    assert N.learn(two) == N.Learned()
    assert N.learn([*two, {"base": "big-dog", "applied": "Big_Dog.png"}]) == N.Learned("_", "title")


def test_unique_names(spark):
    p = spark.createDataFrame([(1, "/a", "Cat", "jpg", "x"), (2, "/a", "Cat", "arw", "x"), (3, "/a", "cat", "jpg", None), (4, "/b", "Cat", "jpg", None)], "id long, folder string, name string, extension string, pair string")
    taken = spark.createDataFrame([("/b", "cat")], "folder string, name string")
    assert {r.id: r.final for r in N.unique_names(p, taken, "pair").collect()} == {1: "Cat.jpg", 2: "Cat.arw", 3: "cat_2.jpg", 4: "Cat_2.jpg"}


def test_rulings_hold(spark):
    faces = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "face long, cluster long")
    owners = spark.createDataFrame([(1, 8), (3, 9), (4, 8)], "face long, person long")
    none = spark.createDataFrame([], "a long, b long")
    parts = {}
    for r in identity.protected_partition(faces, owners, none).collect():
        parts.setdefault(r.part, set()).add(r.face)
    assert sorted(map(sorted, parts.values())) == [[1, 4, 5], [2], [3]]


def test_identities_are_inherited_one_to_one(spark):
    priors = spark.createDataFrame([(10, f) for f in (1, 2, 3, 4)] + [(20, f) for f in (5, 6)], "id long, face long")
    clusters = spark.createDataFrame([(0, f, 1) for f in (1, 2)] + [(1, f, 3) for f in (3, 4, 5, 6)], "cluster long, face long, representative long")
    none = spark.createDataFrame([], "cluster long, id long")
    assert {r.cluster: r.id for r in identity.inherited_ids(priors, clusters, none, none.select("id")).collect()} == {0: 10, 1: 20}
    with pytest.raises(ValueError, match="two clusters"):
        identity.inherited_ids(priors, clusters.union(spark.createDataFrame([(2, 1, 1)], clusters.schema)), none, none.select("id"))


def test_conversations():
    assert ask.search_plan(["find lake videos", "now photos"]) == ("lake", ("image",))
    assert ask.search_plan(["lake videos", "and boats", "show them"]) == ("lake boats", ("video",))
    assert ask.search_plan(["lake videos", "mountains"]) == ("mountains", ())


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_text_of_documents(spark, tmp_path):
    docx = zipped({"word/document.xml": '<w:d xmlns:w="u"><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:d>'})
    assert D.extract_text(docx, "DOCX") == "One two\nthree"
    assert D.extract_text(zipped({"a.xhtml": "<p>x &amp; y</p>", "b.css": "p{}"}), "epub") == "x & y"
    assert D.extract_text("é".encode() * 10, "txt", 5) == "éé" and D.extract_text(b"no zip", "docx") is None and D.extract_text(b"?", "bin") is None
    (tmp_path / "a.html").write_bytes(b"<head><title>t</title></head><p>seen</p><script>not</script>")
    row = D.with_text(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert row.text == "seen" and row.identity == D.content_identity((tmp_path / "a.html").read_bytes())
    big = bytes(D.WHOLE + 5)
    assert D.content_identity(big) != D.content_identity(big + b"x")


def test_intents_are_parsed_and_questions_are_not():
    from cairnlake.operators.intents import intent

    assert intent("Please stop the scan.") == {"kind": "stopJob", "job": "scan"}
    assert intent("trash the duplicates")["kind"] == "moveDuplicatesToTrash" and intent("trash my songs") == {"kind": "refuse"}
    assert intent("merge Ann into Anna") == {"kind": "mergePeople", "people": ["Anna", "Ann"]}
    assert intent("call them uncle bob") == {"kind": "namePerson", "name": "Uncle Bob"}
    assert intent("how many songs are there?") is None and intent("this is nice") is None
