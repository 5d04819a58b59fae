"""Registered queries of kernels over packed blocks: BED bytes to products, weight files, several sources, effects."""

from __future__ import annotations

import io
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, geno, screen
from ..sources import bed, files, specs
from . import span
from .catalog import _KV, _KV_W, G, _alpha, _products, _rounded, _signs, _wide, query
from .fixtures import Tables
from .kernels import AdmixedKernel, SparkKernel, WeightKernel, admixed_rows

WIDTH = 8


def _bed(t: Tables, g: G) -> str:
    """Path of the fixture's genotypes as a BED file, which tasks write side by side."""
    path = urlparse(files.scratch(t.spark, "bed")).path
    bed.write_packed(geno.pack_2bit(g.geno, g.samples, g.variants), path, g.n, g.variants.count())
    return path


@query("""SELECT variant_idx, CAST(count(g) AS BIGINT) AS cnt, CAST(count(*) FILTER (g = 1) AS BIGINT) AS het, CAST(count(*) FILTER (g = 2) AS BIGINT) AS hom, CAST(count(*) FILTER (g IS NULL) AS BIGINT) AS miss, round(avg(g), 6) + 0.0 AS mean,
    round(CASE WHEN count(g) > 0 AND avg(g * g) - avg(g) * avg(g) > 0 THEN 1 / sqrt(greatest(avg(g * g) - avg(g) * avg(g), 1e-6)) ELSE 0 END, 6) + 0.0 AS inv_sd FROM cells WHERE sample_idx % 3 <> 1 GROUP BY 1""")
def bed_block_stats(t: Tables) -> DataFrame:
    """Counts and statistics over kept samples from packed blocks: no cell becomes a row."""
    g = G(t)
    keep = np.arange(g.n) % 3 != 1
    rows = bed.variant_rows(bed.read_blocks(t.spark, _bed(t, g), g.n, keep, WIDTH, 16))
    return _rounded(rows.select("variant_idx", "cnt", "het", "hom", "miss", "mean", "inv_sd"), "mean", "inv_sd")


@query("SELECT variant_idx, sample_idx, CAST(g AS TINYINT) AS dosage FROM cells WHERE (g IS NULL OR g <> 0) AND variant_idx >= 5 AND variant_idx < 17 AND sample_idx IN (3, 4, 50, 77)")
def bed_pushdown(t: Tables) -> DataFrame:
    """A range of variants and some samples: both filters reach the reader, which decodes nothing else."""
    g = G(t)
    return bed.read_bed(t.spark, _bed(t, g), g.n, block=4).filter("variant_idx >= 5 AND variant_idx < 17 AND sample_idx IN (3, 4, 50, 77)")


@query(_KV.replace("SELECT sample_idx", "SELECT CAST(0 AS INTEGER) AS component_idx, sample_idx", 1).replace("GROUP BY 1, 2", "GROUP BY sample_idx, col"))
def kernel_bed(t: Tables) -> DataFrame:
    """A kernel from a BED path, without a shuffle of cells."""
    g = G(t)
    return _products(t, SparkKernel.of_bed(t.spark, _bed(t, g), g.n, width=WIDTH))


@query("SELECT component_idx, sample_idx, col, round(sum(z * score) / any_value(m_eff), 6) + 0.0 AS value FROM z JOIN zv USING (variant_idx) JOIN components USING (variant_idx) JOIN cmeff USING (component_idx) GROUP BY 1, 2, 3")
def kernel_bed_components(t: Tables) -> DataFrame:
    """Scattered components of a BED file: blocks are split where they lie."""
    g = G(t)
    return _products(t, SparkKernel.of_bed(t.spark, _bed(t, g), g.n, g.cmap, width=WIDTH))


@query("SELECT iid, CAST(row_number() OVER (ORDER BY sample_idx) - 1 AS BIGINT) AS rank, sample_idx FROM samples WHERE iid % 7 <> 3")
def keep_order(t: Tables) -> DataFrame:
    """Positions of kept samples, which must follow the file's order."""
    samples = t.samples()
    kept = align.ordered(samples.filter("iid % 7 <> 3"), "sample_idx").select("iid", F.col("number").alias("rank"))
    return align.subsequence(samples, kept).select("iid", "rank", "sample_idx")


def _weight_files(t: Tables) -> list[str]:
    """The fixture's weight blocks as files, as a user would hand them in."""
    dense: dict[int, np.ndarray] = {}
    for r in t.block_w().collect():  # 25 variants
        dense.setdefault(r["block_idx"], np.zeros((5, 5)))[r["i"] % 5, r["j"] % 5] = r["w"]
    base, paths = files.scratch(t.spark, "weights"), []
    for k in sorted(dense):
        out = io.BytesIO()
        np.save(out, dense[k])
        paths.append(f"{base}.{k}.npy")
        files.put(paths[-1], out.getvalue())
    return paths


def _weights(t: Tables, g: G) -> WeightKernel:
    table = specs.weight_blocks(t.spark, [_weight_files(t)], g.variants.count())
    return WeightKernel.of_files(bed.read_blocks(t.spark, _bed(t, g), g.n, width=WIDTH), table, g.n, WIDTH)


@query(_KV_W.format("CAST(0 AS INTEGER)"))
def kernel_w_files(t: Tables) -> DataFrame:
    """Weight files that tasks read, beside blocks of a BED file; blocks of five and of eight variants overlap."""
    return _products(t, _weights(t, G(t)))


@query("""SELECT CAST(0 AS INTEGER) AS component_idx, CAST(variant_idx AS BIGINT) AS local_idx, variant_idx, round(0.5 * b / trace, 6) + 0.0 AS beta FROM (SELECT i AS variant_idx, sum(w * score) AS b FROM bw JOIN zv ON j = variant_idx WHERE col = 0 GROUP BY 1) JOIN stats USING (variant_idx),
    (SELECT sum(w * zi.z * zj.z) / (SELECT n FROM cnt) AS trace FROM bw JOIN z zi ON i = zi.variant_idx JOIN z zj ON j = zj.variant_idx AND zi.sample_idx = zj.sample_idx) WHERE inv_sd > 0""")
def w_effects(t: Tables) -> DataFrame:
    """Effects of variants under block weights, theta W Z' alpha / c, for a given alpha."""
    g = G(t)
    out = _weights(t, g).effects(_alpha(t, g.n), np.array([0.5]))
    return _rounded(out, "beta")


@query("""SELECT sample_idx, round(sum(z * beta), 5) + 0.0 AS value FROM z JOIN (SELECT i AS variant_idx, 0.5 * sum(w * score) / any_value(trace) AS beta FROM bw JOIN zv ON j = variant_idx,
    (SELECT sum(w * zi.z * zj.z) / (SELECT n FROM cnt) AS trace FROM bw JOIN z zi ON i = zi.variant_idx JOIN z zj ON j = zj.variant_idx AND zi.sample_idx = zj.sample_idx) WHERE col = 0 GROUP BY 1) USING (variant_idx) GROUP BY 1""")
def w_prediction(t: Tables) -> DataFrame:
    """Random effects of samples from the effects of variants under block weights."""
    g = G(t)
    b = _weights(t, g).effects(_alpha(t, g.n), np.array([0.5])).select("variant_idx", F.lit(0).alias("col"), F.col("beta").alias("b"))
    return geno.zb(g.geno, g.stats, b, g.samples).select("sample_idx", (F.round("value", 5) + 0.0).alias("value"))


@query("""SELECT ancestry AS component_idx, sample_idx, col, round(sqrt(adm.q) * sum(z * s) / (SELECT m_eff FROM meff), 6) + 0.0 AS value FROM z JOIN
    (SELECT variant_idx, ancestry, col, sum(z * v * sqrt(q)) AS s FROM z JOIN v USING (sample_idx) JOIN adm USING (sample_idx) GROUP BY 1, 2, 3) USING (variant_idx) JOIN adm USING (sample_idx, ancestry) GROUP BY ancestry, sample_idx, col, adm.q""")
def kernel_admixed(t: Tables) -> DataFrame:
    """Ancestry components as a kernel that can be fitted, three columns to a product."""
    g = G(t)
    if g.n > span.BEYOND:
        base = SparkKernel.of_bed(t.spark, _bed(t, g), g.n, width=WIDTH)
        return _rounded(admixed_rows(base, t.admixture(), _wide(t), 2, 3), "value")
    shares = t.admixture().toPandas()  # n x ancestries, as the kernel holds them
    q = np.zeros((g.n, int(shares["ancestry"].max()) + 1))
    q[shares["sample_idx"], shares["ancestry"]] = shares["q"]
    base = SparkKernel.of_bed(t.spark, _bed(t, g), g.n, width=WIDTH)
    out = AdmixedKernel(base, q, 3).stacked(_signs(g.n))
    base.close()
    at = np.argwhere(np.repeat(q.T[:, :, None] > 0, 2, 2))  # shares of 0 are absent rows
    rows = [(int(a), int(s), int(c), float(out[a, s, c])) for a, s, c in at]
    return _rounded(t.spark.createDataFrame(rows, "component_idx int, sample_idx long, col int, value double"), "value")


# --- several sources ---------------------------------------------------------

_SOURCES = """, raw AS (SELECT 0 AS src, variant_idx, sample_idx, g FROM cells
        UNION ALL SELECT 1, k, sample_idx, coalesce(c, 0) FROM samples CROSS JOIN range(25) r(k) LEFT JOIN
            (SELECT o_custkey AS iid, s_nationkey AS k, least(count(*), 2) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) USING (iid, k)
        UNION ALL SELECT 2, k, sample_idx, coalesce(c, 0) FROM samples CROSS JOIN range(1, 6) r(k) LEFT JOIN
            (SELECT o_custkey AS iid, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS k, least(count(*), 2) AS c FROM orders GROUP BY 1, 2) USING (iid, k)),
    num AS (SELECT src, variant_idx - CASE src WHEN 2 THEN 1 ELSE 0 END AS variant_idx, sample_idx, g FROM raw),
    sst AS (SELECT src, variant_idx, avg(g) AS mean, avg(g * g) - avg(g) * avg(g) AS var FROM num GROUP BY 1, 2),
    sz AS (SELECT src, variant_idx, sample_idx, CASE WHEN g IS NULL THEN 0 ELSE (g - mean) / sqrt(greatest(var, 1e-6)) END AS z FROM num JOIN sst USING (src, variant_idx) WHERE var > 0),
    sm AS (SELECT src, count(*) AS m_eff FROM sst WHERE var > 0 GROUP BY 1),
    szv AS (SELECT src, variant_idx, col, sum(z * v) AS score FROM sz JOIN v USING (sample_idx) GROUP BY 1, 2, 3)"""


def _sources(t: Tables) -> tuple[SparkKernel, list[int]]:
    """Brands of parts from a BED file, suppliers' nations and priorities of orders from cells, as one kernel."""
    g = G(t)
    orders = t.read("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").cast("long").alias("iid"), (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("priority"))
    line = t.read("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).join(orders, "o").join(t.read("supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").cast("long").alias("nation")), "s")
    parts, widths = [SparkKernel.of_bed(t.spark, _bed(t, g), g.n, width=WIDTH)], [g.variants.count()]
    for rows, k, m in ((line, "nation", 25), (orders, "priority", 5)):
        cells = rows.join(g.samples, "iid").groupBy("sample_idx", F.col(k).alias("variant_idx")).agg(F.least(F.count("*"), F.lit(2)).cast("byte").alias("dosage"))
        variants = t.spark.range(m).select(F.col("id").alias("variant_idx"))
        stats = geno.variant_stats(cells, variants, g.n)
        parts.append(SparkKernel.build(cells, stats, geno.component_map(variants.select(F.lit(0).alias("component_idx"), "variant_idx")), g.n, WIDTH))
        widths.append(m)
    return SparkKernel.joined(parts, widths), widths


@query(f"{_SOURCES} SELECT CAST(src AS INTEGER) AS component_idx, sample_idx, col, round(sum(z * score) / any_value(m_eff), 6) + 0.0 AS value FROM sz JOIN szv USING (src, variant_idx) JOIN sm USING (src) GROUP BY 1, 2, 3")
def kernel_sources(t: Tables) -> DataFrame:
    """Three sources of the same samples, a component each, in one job for a product."""
    return _products(t, _sources(t)[0])


@query(f"{_SOURCES} SELECT CAST(src AS INTEGER) AS grm_idx, CAST(variant_idx AS BIGINT) AS local_idx, round((src + 1) * score / m_eff, 6) + 0.0 AS beta FROM szv JOIN sm USING (src) WHERE col = 0")
def source_effects(t: Tables) -> DataFrame:
    """Effects of the variants of every source for a given alpha, under each source's own numbers."""
    kernel, widths = _sources(t)
    table = t.spark.createDataFrame([(k, sum(widths[:k]), w) for k, w in enumerate(widths)], "grm_idx int, first long, m long")
    out = kernel.effects(_alpha(t, kernel.n), np.array([1.0, 2.0, 3.0])).select(F.col("variant_idx").alias("global_idx"), "beta")
    rows = screen.global_to_local(out.select("global_idx"), table).join(out, "global_idx")
    return _rounded(rows.select("grm_idx", "local_idx", "beta"), "beta")
