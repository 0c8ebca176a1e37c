"""Work that suffix sorting does not have to do: levels of recursion, and hashes that names do not need."""

import numpy as np

from cairnlake.llm import suffix_array as S


def test_plain_text_is_named_at_once_and_repeats_are_not(monkeypatch):
    calls, sort = [], S.suffix_array
    monkeypatch.setattr(S, "suffix_array", lambda s: (calls.append(len(s)), sort(s))[1])
    text = np.random.default_rng(1).integers(97, 122, 3000)
    order = lambda s: sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert S.suffix_array(text).tolist() == order(text) and len(calls) == 1
    twice = np.concatenate([text[:300], [255], text[:300], [254], text[5:305]])
    assert S.suffix_array(twice).tolist() == order(twice) and len(calls) > 2
    wide = np.random.default_rng(2).integers(1, 1 << 22, 100)
    assert S.suffix_array(np.concatenate([wide, wide])).tolist() == order(np.concatenate([wide, wide]))


def test_names_come_without_the_hashes_of_parcels():
    data = np.frombuffer(b"".join(b"%d some words of a text, " % i for i in range(40_000)) + b"\n", np.uint8)
    bounds = np.array([0, len(data)])
    assert not len(S.patches(data, bounds, whole=False)[5])
    for a, b in zip(S.patches(data, bounds)[:5], S.patches(data, bounds, whole=False)[:5], strict=True):
        assert np.array_equal(a, b)
