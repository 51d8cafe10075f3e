"""Word hashing in slices."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sessionrank.llm import common
from tests.llm import brute


@pytest.mark.parametrize("size", [8, 64, 1 << 20])
def test_slices_change_no_hash(size, monkeypatch):
    """Texts shorter and longer than a slice, words longer than one, empty and null texts: words and hashes are those of one slice."""
    pick = random.Random(size)
    texts = [None, "", " ", "x" * 300, "one two"] + [
        "".join(pick.choice(["a", "Bc", "déf", "word", " ", "\n", "  ", "y" * 40]) for _ in range(pick.choice([0, 3, 20, 120]))) for _ in range(200)
    ]
    body, offsets = common.raw_bytes(pa.array(texts, pa.string()))
    whole, ends = common._slice_hashes(body, offsets)
    monkeypatch.setattr(common, "SLICE", size)
    monkeypatch.setattr(common, "_TABLES", {})
    got, bounds = common.word_hashes(body, offsets)
    assert np.array_equal(got, whole) and np.array_equal(bounds, ends)
    assert [int(n) for n in np.diff(bounds)] == [len(brute.words(t)) for t in texts]
    named = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        for w, h in zip(brute.words(t), got[a:b]):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
