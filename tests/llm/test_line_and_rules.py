"""Line dedup and quality rules on odd inputs."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cairnlake.llm import quality_rules
from cairnlake.llm.line_dedup import dedup_lines
from cairnlake.llm.quality_rules import apply_rules, count_rules


def test_runs_are_deleted_where_they_come_later(spark):
    run = "a a\nb\nc\n\nd"
    docs = [
        (2, f"x\n{run}\ny", 1), (1, f"p\n{run}", 1), (3, f"{run}\n{run}", 1), (None, run, 1), (4, None, 1), (5, "", 1),
        (6, "a a\nb\nc", 1), (7, "\n\n\n\n\n", 1), (7, "\n\n\n\n\n", 1), (8, "z\n" * 10, 1),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").withColumnRenamed("n_chars", "s")
    got = sorted(((str(r.doc_id), r.text) for r in dedup_lines(df).collect()), key=str)
    want = [
        ("1", f"p\n{run}"), ("2", "x\ny"), ("3", ""), ("4", None), ("5", ""), ("6", "a a\nb\nc"), ("7", "\n\n\n\n\n"), ("7", "\n\n\n\n\n"),
        ("8", "z\n"), ("None", ""),
    ]
    assert got == sorted(want, key=str)
    assert dedup_lines(df.where("false")).collect() == []


def test_a_long_document_and_a_line_in_every_document(spark):
    body = [f"line {i}" for i in range(3000)]
    docs = [(0, "\n".join(body))] + [(i, "\n".join([f"own {i}", *body[:4], f"end {i}"])) for i in range(1, 200)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 200))


def test_rule_counts():
    assert count_rules(None) == count_rules("") == (0, 0, 0, 0, 0, 0)
    assert count_rules("a b c d e a b c d e") == (10, 10, 0, 0, 10, 1)
    assert count_rules("a a a a a a") == (6, 6, 0, 0, 6, 1)
    assert count_rules("é# x\n\né# x\n y|") == (5, 8, 3, 1, 0, 3)


def test_verdicts(spark, monkeypatch):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, words, "good", 0.5) for i in range(50)] + [(100, "short", "good", 0.5), (101, None, None, 0.5), (102, words, None, 0.5)]
    rows += [(200 + i, "### " * 30 + words, "bad", 0.5) for i in range(40)] + [(300, words, "bad", 0.5), (301, "# " * 12 + words, "bad", 0.5), (302, "# " * 12 + words, "good", 0.5)]
    out = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")).collect()}
    kept = {i for i, r in out.items() if r["__kept"]}
    assert kept == {*range(50), 102, 300, 302} and out[101]["__base_failed"]
    monkeypatch.setattr(quality_rules, "FEW_HOSTS", 0)  # the salted join
    out = apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string, rate double")).collect()
    assert {r.doc_id for r in out if r["__kept"]} == kept and len(out) == len(rows)
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_a_bad_host_against_sql(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, words if i % 9 else f"{words} ### ### ### ### ### ###", f"host{i % 12}") for i in range(600)]
    rows += [(1000 + i, f"{words} " + "### " * (i % 3 * 5), "bad") for i in range(60)] + [(2000, "# # # # " + words, "bad"), (2001, "# # # # " + words, "host1"), (2002, None, None)]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "documents.parquet")
    got = sorted(tuple(r) for r in quality_rules.op4_quality_rules(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert got == sorted(con.execute(quality_rules.OP4_SQL).fetchall())
    kept = {r[0]: r[-1] for r in got}
    assert not kept[2000] and kept[2001]  # the host's verdict acts


def test_very_long_texts_and_repeated_rows(spark):
    long = "word " * 300_000
    rows = [(1, long, "a"), (2, "some words " * 3, "a"), (2, "some words " * 3, "a")]
    out = apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r["__n_words"]) for r in out) == [(1, 300_000), (2, 6), (2, 6)]
