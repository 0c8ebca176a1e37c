"""Large parts are merged band by band, and give the groups of the pass."""

import random

import pytest
from test_constrained import plain, run

from cairnlake.operators import constrained


@pytest.mark.parametrize("most", [0, 45])
def test_bands_give_the_groups_of_the_pass(spark, monkeypatch, most):
    monkeypatch.setattr(constrained, "BAND", 40)
    called = []
    bands = constrained._in_bands
    monkeypatch.setattr(constrained, "_in_bands", lambda *a: called.append(1) or bands(*a))
    r, n = random.Random(9), 60
    edges = [(r.randrange(n), r.randrange(n), r.choice([0.5, 0.6, r.random()])) for _ in range(110)]
    keys = [(r.randrange(n), f"k{r.randrange(25)}") for _ in range(40)]
    owners = [(x, r.randrange(3)) for x in r.sample(range(n), 8)]
    assert run(spark, edges, keys, owners, most) == plain(edges, keys, owners) and called
