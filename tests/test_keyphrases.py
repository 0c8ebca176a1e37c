"""Key phrases of whole tables, in small batches."""

from cairnlake.functions import text as X


def test_phrases_are_those_of_each_text_and_few_texts_are_held(spark, monkeypatch):
    texts = [None, "", "the of", *(f"green house {i} and the red mountain view, old stone bridge. " * (1 + i % 5) for i in range(200))]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    got = X.phrases_and_names(spark.createDataFrame(rows, "id long, text string")).collect()
    want = [(i, [p for p, _ in X.rake_phrases(t)]) for i, t in rows]
    assert sorted([(r.id, r.phrases) for r in got], key=repr) == sorted(want, key=repr)
    named = {r.id: r.name for r in got if r.id is not None}
    assert named[1] is None and named[2] is None and named[3].count("-") == 4
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    # a batch gives its phrases in parts, so those of all its texts are never held
    import pyarrow as pa

    monkeypatch.setattr(X, "HELD", 500)
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": texts[3:53]})
    parts = list(X._phrases_and_names(iter([batch])))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 50
