"""Stage tables and when they go."""

import os

from cairnlake.session import drop_staged, kept_tables, shared_dir, staged


def stages(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("stage-")}


def test_only_kept_tables_stay(spark):
    before = stages(spark)
    with kept_tables(spark) as outer:
        with kept_tables(spark) as keep:
            first = staged(spark.range(3))
            kept = keep(first.selectExpr("id + 1 AS id"))
        assert len(stages(spark) - before) == 1 and sorted(r.id for r in kept.collect()) == [1, 2, 3]
        last = outer(kept.where("id > 1"))
    assert len(stages(spark) - before) == 1 and last.count() == 2
    drop_staged(last)
    assert stages(spark) == before
