"""Python workers outlive a step: what its tasks took must not stand beside the next step's needs."""

from unittest.mock import MagicMock

import numpy as np
import pandas as pd

from skyledger.llm import common, jaccard_join


def test_freed_memory_is_given_back_after_each_batch_and_at_the_end(corpus_spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    docs = MagicMock()
    table = corpus_spark.sparkContext.broadcast((np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)))
    jaccard_join._postings(docs, 3, 90, 100, table)
    part = docs.where.return_value.select.return_value.mapInPandas.call_args[0][0]
    batches = [pd.DataFrame({"text": [f"a b c d {k} f g h {k} j", None]}) for k in range(3)]
    out = list(part(iter(batches)))
    assert len(out) == 3 and all(len(x) for x in out) and len(calls) == 4


def test_a_part_that_is_left_early_gives_back_too(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    rows = common.released(lambda batches: (x for x in batches))(iter([1, 2, 3]))
    assert next(rows) == 1
    rows.close()
    assert calls == [1]


def test_give_back_runs_without_the_c_librarys_trim(monkeypatch):
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: object())
    common.give_back()
