"""The pipeline's line stage on repeats of fewer than four lines, against plain sets of windows."""

import corpus_pipeline as P

from cairnlake.llm.common import words_of

SF = "/root/testdata/sf0.001"


def brute(docs):
    """{doc_id: text} without repeats of four lines, of one to three lines of 50 words, and of short whole texts."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if words_of(x)]
        gone = set()
        for n in range(1, 5):
            for j in range(len(at) - n + 1):
                part = tuple(lines[k] for k in at[j : j + n])
                keys = [part] if n == 4 or sum(len(words_of(x)) for x in part) >= 50 else []
                keys += [("whole", *part)] if n == len(at) < 4 else []
                for key in keys:
                    if key in seen:
                        gone |= set(range(at[j], at[j + n - 1] + 1))
                    seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def stage(spark, docs):
    return {r.doc_id: r.text for r in dict(P.STAGES)["line dedup"](spark, docs, SF).collect()}


def test_planted_passages_and_short_copies(spark):
    long = " ".join(f"w{i}" for i in range(50))
    half = " ".join(f"h{i}" for i in range(26))
    docs = [
        (1, f"a\n{long}\nb"), (2, f"c\n\n{long}\nd"), (3, "short copy\nof two"), (4, "short copy\nof two"), (5, "short copy"), (6, f"x\n{half}\n\n{half} y\nz"),
        (7, f"p\n{half}\n\n{half} y\nq"), (8, f"{half}\nalone"), (9, f"{long}\nb\nend"), (10, f"{long} more\nb"),
    ]
    got = stage(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute(docs)
    assert got[2] == "c\n\nd" and got[4] == "" and got[5] == "short copy" and got[7] == "p\nq" and got[9] == "end" and got[10] == docs[9][1]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage(spark, docs) == brute([(d.doc_id, d.text or "") for d in docs.collect()])
