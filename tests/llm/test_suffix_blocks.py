"""Texts of a block are hashed together."""

import numpy as np
import pytest

from orbtable.llm import suffix_dedup as sd
from orbtable.llm.exchange import squeeze, squeeze_ints


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    return [bytes(rng.integers(97, 100, int(k), np.uint8)) for k in rng.choice([0, 1, 49, 50, 51, 80, 130, 400], n)]


def row_of(raws):
    return {"block": 0, "doc_ids": [str(i) for i in range(len(raws))], "lengths": squeeze_ints(np.array([len(r) for r in raws])), "body": squeeze(b"".join(raws))}


@pytest.mark.parametrize("part", [1 << 18, 1000, 100])
def test_runs_do_not_depend_on_neighbours(monkeypatch, part):
    monkeypatch.setattr(sd, "SLICE", part)
    raws = texts(300)
    got = [c.tolist() for c in sd.runs_of(memoryview(b"".join(raws)), np.array([len(r) for r in raws]), 50)]
    want = [[], [], [], []]
    for i, raw in enumerate(raws):
        _, *rest = (c.tolist() for c in sd.runs_of(memoryview(raw), np.array([len(raw)]), 50))
        for k, column in enumerate([[i] * len(rest[0]), *rest]):
            want[k] += column
    assert got == want
    assert sum(got[2]) == sum(max(0, len(r) - 49) for r in raws)


def test_short_texts_and_regions_are_hashed_together(monkeypatch):
    calls, plain = [], sd.buckets_of
    monkeypatch.setattr(sd, "buckets_of", lambda *a: calls.append(a) or plain(*a))
    row = row_of(texts(500))
    runs = sd.Runs(row, 50)
    assert len(calls) == 1 and len(runs.core) > 500
    row["answer"] = [squeeze_ints(np.zeros(len(runs.asked()[0]), np.uint64))]
    regions = sd.Regions(sd.survivors(row, 50), 50)
    assert len(calls) == 3 and len(regions.windows) > 200
    assert len(regions.window) == regions.windows.sum() == regions.number.sum()
