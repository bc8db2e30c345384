"""A failed fit ends a query of models; it isn't a row without metrics."""

import pytest

from gaugewright.operators import fits
from gaugewright.plans import catalogues


def _fails(spark, monkeypatch, name):
    query = next(c.queries[name] for c in catalogues() if name in c.queries)

    def broken(*_):
        raise MemoryError("no room for it")

    monkeypatch.setattr(fits, "plan", broken)
    with pytest.raises(RuntimeError, match=r"failed in repetition \d, fold \d: MemoryError: no room for it"):
        query(spark, "/root/testdata/sf0.001").collect()


def test_forest(spark, monkeypatch):
    _fails(spark, monkeypatch, "model_cv_forest")


def test_boosted(spark, monkeypatch):
    _fails(spark, monkeypatch, "model_cv_gbt_ovr")


def test_tree(spark, monkeypatch):
    _fails(spark, monkeypatch, "model_cv_tree")
    _fails(spark, monkeypatch, "out_of_fold_coverage")
