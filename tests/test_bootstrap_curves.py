"""Curves of a resample that is drawn in the units' tasks against those of resampled rows; F20."""

import numpy as np
import pytest
from test_unit_tasks import SIZES, unit_rows

from curvefx.operators import inference, quantiles


@pytest.mark.parametrize("bound", [None, 20])
def test_bootstrap_curves_equal_those_of_resampled_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(quantiles, "BUCKETS", 3)
    df = unit_rows(spark, SIZES, False)
    got = {r["u"]: r for r in inference.bootstrap_curves(df, "u", "y", "w", ["i"], 5, [0.1, 0.4, 0.8], bound).collect()}
    curves = lambda part: {r["u"]: r["q"] for r in quantiles.unit_curves(part, "u", "y", "w", [0.1, 0.4, 0.8], spread=True).collect()}
    a, b = curves(df.where("u IS NOT NULL")), curves(inference.bootstrap_rows(df.where("u IS NOT NULL"), "u", ["y", "w", "i"], 5))
    assert set(got) == set(a) & set(b) and len(got) == len(SIZES) - 1
    assert all(np.allclose(r["q"], a[u], rtol=1e-9) and np.allclose(r["again"], b[u], rtol=1e-9) for u, r in got.items())
