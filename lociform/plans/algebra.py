"""Registered queries of solvers' parts whose results SQL can state: quadratures, low-rank bases, designs, streamed sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import independent_columns, nnls, spd_solve
from ..operators import geno
from ..sources import files
from ..streaming import additive
from . import krylov
from .catalog import _KV, G, _kernel, _rounded, query
from .fixtures import Tables


@query("""SELECT variant_idx, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (g IS NULL) AS BIGINT) AS miss, CAST(count(*) FILTER (g = 1) AS BIGINT) AS het, CAST(count(*) FILTER (g = 2) AS BIGINT) AS hom,
    coalesce(CAST(sum(g) AS DOUBLE), 0) AS s1, coalesce(CAST(sum(g * g) AS DOUBLE), 0) AS s2 FROM cells WHERE g IS NULL OR g <> 0 GROUP BY 1""")
def stream_sums(t: Tables) -> DataFrame:
    """Cells that arrive as a stream of files, one in each micro-batch, and their sums."""
    base = files.scratch(t.spark, "stream")
    cells = t.geno()
    cells.repartition(3).write.parquet(f"{base}/cells")
    stream = t.spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/cells")
    additive.maintain(stream, f"{base}/sums", f"{base}/progress").awaitTermination()
    return additive.totals(t.spark, f"{base}/sums")


@query("SELECT CAST(CASE WHEN variant_idx < 4 THEN 0 WHEN variant_idx < 11 THEN 1 ELSE 2 END AS INTEGER) AS component_idx, CAST(variant_idx - CASE WHEN variant_idx < 4 THEN 0 WHEN variant_idx < 11 THEN 4 ELSE 11 END AS BIGINT) AS local_idx, variant_idx FROM variants")
def block_components(t: Tables) -> DataFrame:
    """Contiguous components from their sizes, the last taking the rest."""
    variants = t.variants()
    m = variants.count()
    place = F.lit(None).cast("int")
    for k, first, end in geno.block_ranges([4, 7, m - 11], m):
        place = F.when((F.col("variant_idx") >= first) & (F.col("variant_idx") < end), F.lit(k)).otherwise(place)
    return geno.component_map(variants.select(place.alias("component_idx"), "variant_idx"))


@query(_KV)
def kv_identity_w(t: Tables) -> DataFrame:
    """Block weights that are the identity give the standard kernel."""
    g = G(t)
    m = g.stats.filter("inv_sd > 0").count()
    return _rounded(geno.block_w_kv(g.geno, g.stats, geno.identity_w(g.stats), t.v(), g.samples, 1 / m), "value")


@query(""", kvs AS (SELECT sample_idx, col, sum(z * score) / (SELECT m_eff FROM meff) AS kv FROM z JOIN zv USING (variant_idx) GROUP BY 1, 2)
    SELECT col, CAST(p AS INTEGER) AS p, round(CASE p WHEN 0 THEN 1 WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END, 4) + 0.0 AS moment FROM
    (SELECT col, sum(v * kv) / sum(v * v) AS k1, sum(kv * kv) / sum(v * v) AS k2 FROM kvs JOIN v USING (sample_idx, col) GROUP BY 1)
    JOIN (SELECT col, sum(s * s) / (SELECT m_eff FROM meff) / (SELECT n FROM cnt) AS k3 FROM (SELECT variant_idx, col, sum(z * kv) AS s FROM z JOIN kvs USING (sample_idx) GROUP BY 1, 2) GROUP BY 1) USING (col), (VALUES (0), (1), (2), (3)) AS powers(p)""")
def lanczos_moments(t: Tables) -> DataFrame:
    """Three steps' quadratures integrate powers up to the fifth exactly: v'K^p v / v'v."""
    g = G(t)
    with _kernel(g, None) as (kernel, start, _):
        found = krylov.lanczos(lambda v: kernel.stacked(v)[0], start, 3)
    rows = [(c, p, float(weights @ values**p)) for c, (values, weights) in enumerate(found) for p in range(4)]
    return t.spark.createDataFrame(rows, "col int, p int, moment double").withColumn("moment", F.round("moment", 4) + 0.0)


@query(_KV)
def low_rank_range(t: Tables) -> DataFrame:
    """A basis as wide as the kernel's rank spans its range, so products stay what they are under its projection."""
    g = G(t)
    with _kernel(g, None) as (kernel, v, rows):
        product = lambda w: kernel.stacked(w)[0]
        u = krylov.low_rank(product, len(v), g.stats.filter("inv_sd > 0").count())
        return _rounded(rows(u @ (u.T @ product(v))).withColumnRenamed("v", "value"), "value")


@query("SELECT CAST(k AS INTEGER) AS k FROM (SELECT stddev_pop(x0) AS a, stddev_pop(x1) AS b, stddev_pop(x3) AS d FROM covar JOIN samples USING (iid)), (VALUES (0), (1), (2)) AS c(k) WHERE CASE k WHEN 0 THEN a WHEN 1 THEN d ELSE b END > 0")
def design_columns(t: Tables) -> DataFrame:
    """Columns that can join the intercept: the constant one cannot."""
    rows = t.samples().join(t.covar(), "iid").select("sample_idx", "cov").orderBy("sample_idx").toPandas()  # n rows, as every design
    cov = np.array(rows["cov"].tolist())
    kept = independent_columns(np.ones((len(cov), 1)), cov[:, [0, 3, 1]])
    return t.spark.createDataFrame([(int(k),) for k in kept], "k int")


@query("""SELECT b0 + 0.0 AS b0, b1 + 0.0 AS b1 FROM (SELECT round(regr_intercept(pheno, x0), 4) AS b0, round(regr_slope(pheno, x0), 4) AS b1 FROM samples JOIN pheno USING (iid) JOIN covar USING (iid))""")
def least_squares(t: Tables) -> DataFrame:
    """Normal equations by the solver of symmetric systems."""
    rows = t.samples().join(t.pheno(), "iid").join(t.covar(), "iid").select(F.col("pheno").alias("y"), F.col("cov")[0].alias("x"))
    s = rows.agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy")).first()
    b = spd_solve(np.array([[s["n"], s["x"]], [s["x"], s["xx"]]], float), np.array([s["y"], s["xy"]], float))
    return t.spark.createDataFrame([(round(float(b[0]), 4) + 0.0, round(float(b[1]), 4) + 0.0)], "b0 double, b1 double")


@query("""SELECT greatest(round(slope, 4), 0) + 0.0 AS up, greatest(round(-slope, 4), 0) + 0.0 AS down FROM (SELECT regr_slope(pheno, x0) AS slope FROM samples JOIN pheno USING (iid) JOIN covar USING (iid))""")
def bounded_slope(t: Tables) -> DataFrame:
    """A slope and its opposite with bounds at zero: one of them is the slope, the other stays at its bound."""
    rows = t.samples().join(t.pheno(), "iid").join(t.covar(), "iid")
    s = rows.agg(F.var_pop(F.col("cov")[0]).alias("v"), F.covar_pop(F.col("cov")[0], "pheno").alias("c")).first()
    up, down = (float(nnls(np.array([[s["v"]]]), np.array([sign * s["c"]]), np.zeros(1))[0]) for sign in (1, -1))
    return t.spark.createDataFrame([(round(up, 4) + 0.0, round(down, 4) + 0.0)], "up double, down double")
