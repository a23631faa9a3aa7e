"""Batches are worked on in pieces, so what is made of a text does not lie in memory for a whole batch."""

import pandas as pd

from cuewright.llm import jaccard_join
from cuewright.llm.common import SLICE_ROWS, slices


def test_slices_are_small_and_whole():
    batches = [pd.DataFrame({"n": range(2 * SLICE_ROWS + 5)}), pd.DataFrame({"n": []}), pd.DataFrame({"n": [7]})]
    found = list(slices(iter(batches)))
    assert [len(s) for s in found] == [SLICE_ROWS, SLICE_ROWS, 5, 1]
    assert [n for s in found for n in s["n"]] == [*range(2 * SLICE_ROWS + 5), 7]


def test_sets_are_made_slice_by_slice(spark, monkeypatch):
    """A batch of texts never has more sets at once than a slice has rows."""
    seen = []

    class Batch(list):
        def mapInPandas(self, run, schema):
            seen.extend(len(f) for f in run(iter(self)))

    n = SLICE_ROWS + 10
    jaccard_join._named(Batch([pd.DataFrame({"doc_id": range(n), "text": [f"a b c d e {i}" for i in range(n)]})]), 5)
    assert seen == [SLICE_ROWS, 10]
