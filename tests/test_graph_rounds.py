"""What a round of the components costs a driver: its aggregates, and that what is done with is let go of."""

import random

from cairnlake.operators import graph as G


def test_a_round_has_four_grouped_steps_and_frees_what_went_before(spark, monkeypatch):
    random.seed(3)
    edges = [(i, random.choice([0, i - 1, i // 2])) for i in range(1, 400)] + [(1000, 1001), (5, 5), (None, 7), (1000, 1001)]
    grouped, freed, write, free = [], [], G.staged, G.released

    def staged(df):
        grouped.append(df._jdf.queryExecution().sparkPlan().toString().count("HashAggregate(keys"))
        return write(df)

    monkeypatch.setattr(G, "staged", staged)
    monkeypatch.setattr(G, "released", lambda s: (freed.append(len(grouped)), free(s)))
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(400)} | {1000: 1000, 1001: 1000}
    # large star yields a row for each edge as it is, so a round groups for low, twice for least and for the new edges
    assert len(grouped) > 2 and max(grouped) <= 8
    assert freed == list(range(2, len(freed) + 2)) and len(freed) >= len(grouped) - 2


def test_a_small_graph_is_joined_without_rounds(spark, monkeypatch):
    random.seed(9)
    edges = [(i, random.choice([0, i - 1, i // 2]) - 2**62) for i in range(-50, 300)] + [(-(2**63), 2**63 - 1), (5, 5), (None, 7), (1000, 1001), (1001, 1000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    rounds = {(r.node, r.component) for r in G.components(df).collect()}
    written, write = [], G.staged
    monkeypatch.setattr(G, "staged", lambda x: (written.append(1), write(x))[1])
    assert {(r.node, r.component) for r in G.components(df, in_task=len(edges)).collect()} == rounds and len(written) == 2
    assert G.components(df.where("false"), in_task=5).collect() == []
    # one edge more than a task may hold, and there are rounds
    assert {(r.node, r.component) for r in G.components(df, in_task=3).collect()} == rounds and len(written) > 4
