"""Writers of result tables: Spark's own writers for tables that grow, single files for summaries; all by Hadoop path."""

from __future__ import annotations

import datetime
import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gwas import COLUMNS
from ..operators.screen import lookup
from . import files

#: The columns of the tables of selected variants and of merging rounds, in order.
SELECTED = ("snp_index", "source_snp_index", "grm", "chr", "snp_id", "cm", "bp", "a1", "a2", "beta_lasso", "beta_gls_reml")
TRACE = (
    ("round", "int"), ("stage", "string"), ("merge_mode", "string"), ("n_components", "int"), ("h2", "double"), ("sum_theta_g", "double"), ("theta_e", "double"),
    ("n_weak_z", "int"), ("n_reject_z", "int"), ("n_merged_groups", "int"), ("next_n_components", "int"), ("z_cutoff", "double"), ("z_min", "double"),
    ("z_median", "double"), ("z_max", "double"), ("se_median", "double"), ("component_spec", "string"), ("theta_npy", "string"), ("ai_npy", "string"),
)


def _tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nanValue", "nan").csv(path)


def write_json(path: str, data: dict) -> None:
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    files.put(path, json.dumps(data | {"written": now}, indent=1, default=lambda x: x.tolist() if isinstance(x, np.ndarray) else float(x)).encode())


def _array(path: str, values: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, values)
    files.put(path, out.getvalue())


def text8(df: DataFrame) -> DataFrame:
    """Doubles as text of eight significant digits."""
    return df.select(*(F.format_string("%.8g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def write_gwas(results: DataFrame, prefix: str, meta: dict) -> None:
    out = results.select(*COLUMNS)
    _tsv(out.orderBy("component_index", "variant_index_local"), f"{prefix}.gwas.tsv")
    write_json(f"{prefix}.gwas_metadata.json", meta | {"columns": list(COLUMNS)})


def effect_rows(snps: DataFrame, names: DataFrame | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """Effects of variants (``component_idx``, ``local_idx``, ``variant_idx``, ``beta``) in one of the three layouts.

    By the number in the source file; with ``offsets(component_idx, first)`` by a
    number over all components, for sources without a common file; without
    ``variant_idx`` by the number in the component alone.  ``names(component_idx,
    component_name)`` adds names.
    """
    rows = snps if names is None else snps.join(F.broadcast(names), "component_idx")  # a name for each component
    columns = [F.col("component_idx").alias("component_index")] + ([] if names is None else [F.col("component_name")])
    local = F.col("local_idx").alias("component_local_snp_index")
    if offsets is not None:
        rows = rows.join(F.broadcast(offsets), "component_idx")  # a number for each component
        columns += [local, (F.col("first") + F.col("local_idx")).alias("global_snp_index")]
    elif "variant_idx" in snps.columns:
        columns += [local, F.col("variant_idx").alias("source_snp_index")]
    else:
        columns += [F.col("local_idx").alias("snp_index")]
    return rows.select(*columns, "beta")


def write_effects(prefix: str, fixed: DataFrame, random: DataFrame, per_component: DataFrame, snps: DataFrame, meta: dict) -> None:
    _tsv(fixed, f"{prefix}.fixed_effects.tsv")
    _tsv(random.orderBy("sample_index"), f"{prefix}.random_effect.tsv")
    _tsv(per_component.orderBy("sample_index"), f"{prefix}.random_effect_components.tsv")
    snps.write.mode("overwrite").partitionBy("component_index").option("sep", "\t").option("header", True).csv(f"{prefix}.snp_effects")
    write_json(f"{prefix}.effect_metadata.json", meta)


def write_prediction(predicted: DataFrame, prefix: str, meta: dict) -> None:
    _tsv(predicted.orderBy("sample_index"), f"{prefix}.prediction.tsv")
    write_json(f"{prefix}.prediction_metadata.json", meta)


def write_fit(prefix: str, fit) -> None:
    """Variance components, information and gradient, with their statistics."""
    _array(f"{prefix}.theta.npy", fit.theta)
    _array(f"{prefix}.ai.npy", fit.ai)
    _array(f"{prefix}.grad.npy", fit.score)
    write_json(f"{prefix}.ai_stats.json", {"loglik": fit.loglik, "h2": fit.h2, "converged": fit.converged, "iterations": len(fit.history)})


def selected_rows(support: DataFrame, variants: DataFrame, components: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Selected variants (``variant_idx``, ``beta_lasso``, ``beta_gls_reml``) with metadata, in ``SELECTED``.

    A variant of no component has -1 for it, a missing effect is 0, and variants
    that ``source(variant_idx, source_idx)`` does not name keep their number.
    """
    out = lookup(support.select("variant_idx"), variants).join(support, "variant_idx").join(components.select("variant_idx", "component_idx"), "variant_idx", "left")
    own = F.col("variant_idx")
    if source is not None:
        out, own = out.join(source, "variant_idx", "left"), F.coalesce("source_idx", "variant_idx")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    meta = [F.col("chrom").alias("chr"), F.col("variant_id").alias("snp_id"), "cm", "bp", "a1", "a2"]
    return out.select(F.col("variant_idx").alias("snp_index"), own.alias("source_snp_index"), F.coalesce("component_idx", F.lit(-1)).alias("grm"), *meta, zero("beta_lasso"), zero("beta_gls_reml"))


def write_selected(support: DataFrame, prefix: str, summary: dict, history: list[dict]) -> None:
    _tsv(support.select(*SELECTED).orderBy("snp_index"), f"{prefix}.selected_snps.tsv")
    write_json(f"{prefix}.summary.json", summary)
    write_json(f"{prefix}.history.json", {"history": history})


def append_trace(rows: list[dict], path: str) -> None:
    """Adds rounds of merging to a table of ``TRACE`` columns; what a row does not give stays empty."""
    schema = ", ".join(f"{c} {kind}" for c, kind in TRACE)
    out = SparkSession.active().createDataFrame([tuple(r.get(c) for c, _ in TRACE) for r in rows], schema)
    out.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_keep(samples: DataFrame, path: str) -> None:
    """Two equal columns of ids, without a header."""
    samples.orderBy("sample_idx").select("iid", F.col("iid").alias("iid2")).write.mode("overwrite").option("sep", "\t").csv(path)


def write_relaxation(prefix: str, theta: DataFrame, fit, history: list[dict]) -> None:
    theta.write.mode("overwrite").parquet(f"{prefix}.theta")
    _array(f"{prefix}.var_components.npy", fit.theta)
    write_json(f"{prefix}.history.json", {"history": history})
    write_json(f"{prefix}.meta.json", {"loglik": fit.loglik, "h2": fit.h2})
