"""Solvers on coordinates of a span give what they give on arrays of n rows."""

import numpy as np
import pytest

from lociform.plans import blockwise, catalog, kernels, models, span

from .test_queries import FOLDER, duck, test_query as against_sql  # noqa: F401


@pytest.mark.parametrize("name", ["pcg_preconditioned", "reml_decomposition_probes", "soft_grad_balance"])
def test_rows_that_stay_a_table(spark, duck, name, monkeypatch):  # noqa: F811
    """No n rows go to the driver, and the SQL holds."""
    monkeypatch.setattr(span, "BEYOND", 10)
    monkeypatch.setattr(models.Data, "vector", None)
    monkeypatch.setattr(catalog, "_signs", None)
    against_sql(spark, duck, name)


def test_fits_are_those_of_dense_matrices(spark, monkeypatch):
    want = catalog.QUERIES["reml_multi"](spark, FOLDER).toPandas()
    monkeypatch.setattr(span, "BEYOND", 10)
    got = catalog.QUERIES["reml_multi"](spark, FOLDER).toPandas()
    assert np.allclose(got[["theta", "h2", "loglik"]], want[["theta", "h2", "loglik"]], rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("name", ["kernel_admixed", "kernel_sources", "kernel_bed_components", "kernel_w_groups", "kernel_w_rank", "kernel_w_trace", "kernel_soft", "source_effects", "snp_effects", "w_effects"])
def test_products_of_blocks_stay_rows(spark, duck, name, monkeypatch):  # noqa: F811
    """The same over slices of samples: no right-hand side is an array, no product reaches the driver."""
    monkeypatch.setattr(span, "BEYOND", 10)
    monkeypatch.setattr(kernels, "SLICE", 64)
    for module in (catalog, blockwise):
        monkeypatch.setattr(module, "_signs", None)
    monkeypatch.setattr(kernels.SparkKernel, "_sum", None)
    against_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["reml_decomposition", "reml_stationary", "reml_stationary_probes", "low_rank_range"])
def test_solvers_hold_their_sql_beyond_arrays(spark, duck, name, monkeypatch):  # noqa: F811
    test_rows_that_stay_a_table(spark, duck, name, monkeypatch)


@pytest.mark.parametrize("name", ["reml_fit", "reml_effects", "sparse_reml", "relax_groups"])
def test_fits_of_rows_are_those_of_arrays(spark, name, monkeypatch):
    """No n rows go to the driver, and fits are what dense matrices give (soft grouping with a probe for each sample)."""
    monkeypatch.setattr(models, "rademacher", lambda n, probes, seed: np.sqrt(n) * np.eye(n))
    want = catalog.QUERIES[name](spark, FOLDER).toPandas()
    monkeypatch.setattr(span, "BEYOND", 10)
    for gone in ("vector", "columns", "kernel"):
        monkeypatch.setattr(models.Data, gone, None)
    keys = [c for c in want.columns if c.endswith("_idx")]
    want, got = (df.sort_values(keys).reset_index(drop=True) for df in (want, catalog.QUERIES[name](spark, FOLDER).toPandas()))
    assert len(want) and (got[keys] == want[keys]).all(axis=None)
    rest = [c for c in want.columns if c not in keys]
    assert np.allclose(got[rest].astype(float), want[rest].astype(float), rtol=1e-5, atol=1e-7)
