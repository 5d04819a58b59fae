"""Marginal association scan: one row per variant, the covariates projected out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import t_two_sided_many
from .geno import gathered

X_VAR_FLOOR = 1e-8
#: The columns of an association table, in order.
COLUMNS = ("component_index", "component_name", "variant_index_global", "variant_index_local", "chrom", "variant_id", "cm", "bp", "a1", "a2", "af", "n_obs", "beta", "se", "beta_std", "se_std", "t", "p")


def basis(gram: np.ndarray) -> np.ndarray:
    """A matrix R such that ``x R`` has orthonormal columns, from the Gram matrix of ``x``: p x rank, whatever the sample count."""
    width = len(gram)
    chosen: list[int] = []
    for _ in range(width):  # pivoted Cholesky: columns join while they add something new
        rest = [gram[k, k] - (gram[k, chosen] @ np.linalg.solve(gram[np.ix_(chosen, chosen)], gram[chosen, k]) if chosen else 0) if k not in chosen else 0 for k in range(width)]
        k = int(np.argmax(rest))
        if rest[k] <= 1e-10 * max(gram[k, k], 1e-300):
            break
        chosen.append(k)
    out = np.zeros((width, len(chosen)))
    out[chosen] = np.linalg.inv(np.linalg.cholesky(gram[np.ix_(chosen, chosen)])).T
    return out


def project(rows: DataFrame, width: int) -> tuple[DataFrame, int, int]:
    """``sample_idx``, ``v``: the residual of the response and then the basis, side by side; the sample count and the rank.

    One pass gives the count, the Gram matrix of ``x`` and its products with the response.
    """
    x = [F.col("x")[k] for k in range(width)]
    each = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i + 1)]
    row = rows.agg(F.count("*").alias("n"), *each, *(F.sum(x[k] * F.col("y")).alias(f"y{k}") for k in range(width))).first()
    gram = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] for j in range(width)] for i in range(width)], float)
    r = basis(gram)
    fitted = r @ (r.T @ np.array([row[f"y{k}"] for k in range(width)], float))
    q = [sum((x[i] * float(r[i, k]) for i in range(width) if r[i, k]), F.lit(0.0)) for k in range(r.shape[1])]
    resid = F.col("y") - sum((x[i] * float(fitted[i]) for i in range(width) if fitted[i]), F.lit(0.0))
    return rows.select("sample_idx", F.array(resid, *q).alias("v")), row["n"], r.shape[1]


def scan(geno: DataFrame, stats: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Scan results for ``samples(sample_idx, y, x)``; ``stats`` are of these samples.

    Invalid variants keep NaN in all estimates; a zero residual keeps NaN in
    beta, se, t and p only.
    """
    wide, n, rank = project(samples, width)
    dof = n - rank - 1
    if dof <= 0:
        raise ValueError("too few samples for the covariates")
    zq = sum((F.col("v")[k] * F.col("v")[k] for k in range(1, rank + 1)), F.lit(0.0))
    sums = gathered(geno, stats, wide, rank + 1, n * (rank + 1)).select("variant_idx", F.col("v")[0].alias("zy"), zq.alias("zq"))
    square = wide.agg(F.sum(F.col("v")[0] * F.col("v")[0]).alias("square"))
    rows = stats.select("variant_idx", "cnt", "mean", "inv_sd").join(sums, "variant_idx", "left").crossJoin(F.broadcast(square))  # one row
    x_var = F.col("cnt") - F.coalesce("zq", F.lit(0.0))
    valid = (F.col("inv_sd") > 0) & (x_var > X_VAR_FLOOR)
    nan = F.lit(float("nan"))
    rows = rows.withColumn("x_var", x_var).withColumn("valid", valid).withColumn("beta_std", F.when(F.col("valid"), F.col("zy") / F.col("x_var")).otherwise(nan))
    rss = F.greatest(F.col("square") - F.col("beta_std") * F.col("zy"), F.lit(0.0))
    rows = rows.withColumn("se_std", F.when(F.col("valid"), F.sqrt(rss / dof / F.col("x_var"))).otherwise(nan))
    firm = F.col("valid") & (F.col("se_std") > 0)
    rows = rows.select(
        "variant_idx",
        (F.col("mean") / 2).alias("af"),
        F.col("cnt").alias("n_obs"),
        F.when(firm, F.col("beta_std") * F.col("inv_sd")).otherwise(nan).alias("beta"),
        F.when(firm, F.col("se_std") * F.col("inv_sd")).otherwise(nan).alias("se"),
        "beta_std",
        "se_std",
        F.when(firm, F.col("beta_std") / F.col("se_std")).otherwise(nan).alias("t"),
    )
    return with_p(rows, dof)


def with_p(rows: DataFrame, dof: int) -> DataFrame:
    """Adds ``p``, the two-sided tail of Student's t, for Arrow batches of rows; the JVM has no such function."""

    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(t_two_sided_many(t.to_numpy(float), dof))

    return rows.withColumn("p", F.coalesce(F.pandas_udf(tail, "double")("t"), F.lit(float("nan"))))  # Arrow takes NaN for null


def table(results: DataFrame, cmap: DataFrame, names: DataFrame, variants: DataFrame) -> DataFrame:
    """The association table: results with components and variant metadata, in ``COLUMNS``; raises on a variant without metadata."""
    out = results.join(cmap, "variant_idx").join(names, "component_idx").join(variants, "variant_idx", "left")
    checked = F.when(F.col("variant_id").isNull(), F.raise_error(F.concat(F.lit("no metadata for variant "), F.col("variant_idx").cast("string")))).otherwise(F.col("variant_id"))
    renamed = {"component_index": F.col("component_idx"), "variant_index_global": F.col("variant_idx"), "variant_index_local": F.col("local_idx"), "variant_id": checked}
    return out.select(*(renamed.get(c, F.col(c)).alias(c) for c in COLUMNS))
