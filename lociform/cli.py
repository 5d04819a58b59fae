"""Entry points for spark-submit: ``python -m lociform.cli ANALYSIS [options]``.

Analyses: reml, sparse, gwas, merge, relax.  Inputs are BED prefixes with their
FAM and BIM files, and white-space separated phenotypes and covariates.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import align, geno, gwas, screen
from .plans import models
from .plans.kernels import AdmixedKernel, Kernel, SparkKernel, WeightKernel
from .plans.lasso import LassoOptions
from .plans.reml import Options, Problem, replicates
from .sources import bed, files, sinks, specs, text


#: Options that go with some analyses only.
ONLY = {
    "weights": ("reml",), "weight_scale": ("reml",), "ancestry": ("reml",), "more_genotypes": ("reml",), "effects": ("reml",), "replicates": ("reml",),
    "predict_genotypes": ("reml",), "predict_covariates": ("reml",),
    "weak_below": ("merge",), "effective_samples": ("merge",),
    "rounds": ("sparse", "relax"), "screen": ("sparse",), "candidates": ("sparse",), "active": ("sparse",), "still_rounds": ("sparse",), "path_ratio": ("sparse",), "path_length": ("sparse",), "ebic_gamma": ("sparse",),
    "groups": ("relax",), "rate": ("relax",), "trials": ("relax",), "start_weights": ("relax",),
    "method": ("reml", "merge", "sparse", "relax"), "optimizer": ("reml", "merge", "sparse", "relax"), "probes": ("reml", "merge", "sparse", "relax"), "basis": ("reml", "merge", "sparse", "relax"),
}


def parser() -> argparse.ArgumentParser:
    o, so = Options(), models.SparseOptions()
    p = argparse.ArgumentParser(prog="lociform", description=__doc__)
    p.add_argument("analysis", choices=("reml", "sparse", "gwas", "merge", "relax"))
    p.add_argument("--genotypes", required=True, help="path of the BED, BIM and FAM files without their endings")
    p.add_argument("--phenotypes", required=True)
    p.add_argument("--covariates")
    p.add_argument("--keep", help="individuals that stay, a line each")
    p.add_argument("--components", help="a file that lists the variants of each component")
    p.add_argument("--component-sizes", help="comma list of component sizes along the variant axis")
    p.add_argument("--weights", action="append", help="comma list of files with the weights of consecutive blocks; once for each group")
    p.add_argument("--weight-scale", choices=("trace", "rank"), default="trace", help="divide by the trace, or by the effective ranks next to the files")
    p.add_argument("--ancestry", help="shares of each individual of the FAM file, one column for each ancestry")
    p.add_argument("--more-genotypes", action="append", help="further variants of the same individuals, a component of their own; once for each source")
    p.add_argument("--out", required=True, help="where results go: endings are added")
    p.add_argument("--seed", type=int, default=o.seed)
    p.add_argument("--probes", type=int, default=o.probes, help="random vectors behind traces")
    p.add_argument("--quadrature-probes", type=int, default=o.slq_probes)
    p.add_argument("--quadrature-steps", type=int, default=o.slq_steps)
    p.add_argument("--iterations", type=int, default=o.iterations)
    p.add_argument("--solver-iterations", type=int, default=o.pcg_iterations)
    p.add_argument("--tolerances", default=",".join(map(str, o.tolerances)), help="of the solves, iteration by iteration; the last one stays")
    p.add_argument("--start-share", type=float, default=o.h2, help="genetic share of the variance to begin with")
    p.add_argument("--basis", type=int, default=o.rank, help="columns of the preconditioner; 0 for none")
    p.add_argument("--refresh", type=float, default=o.refresh, help="share of the genetic variance that may move before it is built anew")
    p.add_argument("--first-order", type=float, default=o.first_order, help="share of the variance that may move before scoring takes the log determinant anew")
    p.add_argument("--method", choices=("auto", "exact", "stochastic"), default=o.method)
    p.add_argument("--optimizer", choices=("strict", "scoring"), default=o.optimizer)
    p.add_argument("--replicates", type=int, default=1, help="fits with other probes, for the error that probes bring")
    p.add_argument("--effects", action="store_true")
    p.add_argument("--predict-genotypes", help="path without endings of those to predict for")
    p.add_argument("--predict-covariates")
    p.add_argument("--weak-below", type=float, default=screen.WEAK_Z, help="z-score under which components are merged")
    p.add_argument("--effective-samples", type=float, help="sample count behind z-scores, if not all")
    p.add_argument("--rounds", type=int, help="outer rounds of a selection or of soft grouping")
    p.add_argument("--screen", type=int, default=so.screen)
    p.add_argument("--candidates", type=int, default=so.candidates)
    p.add_argument("--active", type=int, default=so.active)
    p.add_argument("--still-rounds", type=int, default=so.still_rounds)
    p.add_argument("--path-ratio", type=float, default=so.lasso.ratio)
    p.add_argument("--path-length", type=int, default=so.lasso.count)
    p.add_argument("--ebic-gamma", type=float, default=so.lasso.gamma)
    p.add_argument("--groups", type=int, default=2)
    p.add_argument("--rate", type=float, default=1e-3)
    p.add_argument("--trials", type=int, default=3)
    p.add_argument("--start-weights", help="a Parquet table of variant_idx, group_idx and w to begin with")
    return p


def check(a: argparse.Namespace) -> None:
    """Options that exclude each other, or belong to another analysis."""
    given = vars(parser().parse_args([a.analysis, "--genotypes", "", "--phenotypes", "", "--out", ""]))
    for name, analyses in ONLY.items():
        if name in given and getattr(a, name) != given[name] and a.analysis not in analyses:
            raise ValueError(f"--{name.replace('_', '-')} goes with {' or '.join(analyses)}, not with {a.analysis}")
    if a.components and a.component_sizes:
        raise ValueError("components come from a file or from sizes, not both")
    special = [x for x in (a.weights, a.ancestry, a.more_genotypes) if x]
    if len(special) > 1 or (a.weights or a.ancestry) and (a.components or a.component_sizes):
        raise ValueError("weights, ancestries and further sources exclude each other, the first two any components")
    if a.weight_scale != "trace" and not a.weights:
        raise ValueError("a scale of weights needs weights")
    if a.predict_genotypes and (a.ancestry or a.more_genotypes):
        raise ValueError("prediction from files goes with one source without ancestries")
    if not a.active <= a.candidates <= a.screen:
        raise ValueError("active <= candidates <= screen must hold")
    if (a.predict_genotypes or a.predict_covariates) and not a.effects:
        raise ValueError("prediction needs effects")
    if a.predict_genotypes and bool(a.covariates) != bool(a.predict_covariates):
        raise ValueError("training and prediction need the same covariates")
    if a.predict_covariates and not a.predict_genotypes:
        raise ValueError("covariates to predict for need their genotypes")
    if a.replicates < 1 or a.replicates > 1 and a.method != "stochastic":
        raise ValueError("replicates differ by their probes, so they go with the stochastic method")
    if a.start_weights and a.groups != given["groups"]:
        raise ValueError("the table of weights says how many groups there are")


def options(a: argparse.Namespace) -> Options:
    tolerances = tuple(float(x) for x in a.tolerances.split(","))
    return Options(
        method=a.method, h2=a.start_share, iterations=a.iterations, probes=a.probes, slq_probes=a.quadrature_probes, slq_steps=a.quadrature_steps, tolerances=tolerances, pcg_iterations=a.solver_iterations,
        rank=a.basis, seed=a.seed, optimizer=a.optimizer, refresh=a.refresh, first_order=a.first_order,
    )


def sparse_options(a: argparse.Namespace) -> models.SparseOptions:
    own = models.SparseOptions()
    path = LassoOptions(ratio=a.path_ratio, count=a.path_length, gamma=a.ebic_gamma)
    return models.SparseOptions(outer=a.rounds or own.outer, screen=a.screen, candidates=a.candidates, active=a.active, still_rounds=a.still_rounds, lasso=path)


def components(spark: SparkSession, a: argparse.Namespace, variants: DataFrame) -> DataFrame:
    if a.components:
        rows = specs.spec_rows(specs.read_spec(spark, a.components))
        geno.check_components(rows, variants.count())
        return rows
    if a.component_sizes:
        ranges = geno.block_ranges([int(x) for x in a.component_sizes.split(",")], variants.count())
        table = F.broadcast(spark.createDataFrame(ranges, "component_idx int, first long, end long"))  # a row for each component
        return variants.join(table, (F.col("variant_idx") >= F.col("first")) & (F.col("variant_idx") < F.col("end"))).select("component_idx", "variant_idx")
    return variants.select(F.lit(0).alias("component_idx"), "variant_idx")


def kernel_of(spark: SparkSession, a: argparse.Namespace, data: models.Data, rows: DataFrame) -> tuple[Kernel, np.ndarray | None]:
    """The kernel that the options ask for, and its residual components (a row each) where they are not the identity."""
    if a.weights:
        paths = [specs.weight_list(text_list) for text_list in a.weights]
        table = specs.weight_blocks(spark, paths, data.variants.count())
        ranks = None
        if a.weight_scale == "rank":
            widths = {r["block_id"]: r["width"] for r in table.select("block_id", "width").collect()}
            flat = iter(sorted(widths))
            ranks = [sum(specs.effective_rank(specs.sidecar(path), widths[next(flat)]) for path in own) for own in paths]
        return WeightKernel.of_files(data.raw, table, data.n, data.WIDTH, ranks), None
    if a.ancestry:
        own = specs.q_fam_path(a.ancestry)  # individuals beside the shares, if there are any
        fam = text.read_fam(spark, own if files.exists(own) else f"{a.genotypes}.fam")
        shares = text.read_admixture(spark, a.ancestry, data.samples, fam=fam).toPandas()
        q = np.zeros((data.n, int(shares["ancestry"].max()) + 1))
        q[shares["sample_idx"], shares["ancestry"]] = shares["q"]
        return AdmixedKernel(data.kernel(), q), q.T
    if a.more_genotypes:
        people, parts, widths = text.read_fam(spark, f"{a.genotypes}.fam"), [data.kernel()], [data.variants.count()]
        for prefix in a.more_genotypes:
            if align.order_mismatch(people, text.read_fam(spark, f"{prefix}.fam"), "sample_idx", "iid").count():
                raise ValueError(f"the individuals of {prefix} are not those of {a.genotypes}")
            variants = text.read_bim(spark, f"{prefix}.bim")
            own = models.Data.of_bed(spark, f"{prefix}.bed", people.select("sample_idx", "iid"), variants, rows, variants.select(F.lit(0).alias("component_idx"), "variant_idx"))
            parts.append(own.kernel())
            widths.append(variants.count())
        return SparkKernel.joined(parts, widths), None
    return data.kernel(), None


def load(spark: SparkSession, a: argparse.Namespace) -> tuple[models.Data, align.CovariateTransform | None, DataFrame]:
    samples = text.read_fam(spark, f"{a.genotypes}.fam")
    align.require_unique(samples, "fam")
    pheno = align.parse_pheno(text.read_pheno(spark, a.phenotypes))
    align.require_unique(pheno, "pheno")
    covar = align.parse_covar(text.read_covar(spark, a.covariates)) if a.covariates else None
    keep = text.read_keep(spark, a.keep) if a.keep else None
    rows = align.align(samples.select("sample_idx", "iid"), pheno, covar, keep)
    transform = None
    if covar is not None:
        width = rows.select(F.size("cov")).first()[0]
        transform = align.CovariateTransform.fit(rows, width)
        rows = transform.apply(rows)
    else:
        rows = rows.withColumn("x", F.array(F.lit(1.0)))
    sinks.write_keep(rows, f"{a.out}.keep")
    align.dropped(samples.select("sample_idx", "iid"), pheno, covar, keep).select("iid").write.mode("overwrite").csv(f"{a.out}.dropped")
    variants = text.read_bim(spark, f"{a.genotypes}.bim")
    aligned = rows.select("sample_idx", "iid", F.col("pheno").alias("y"), "x")
    data = models.Data.of_bed(spark, f"{a.genotypes}.bed", samples.select("sample_idx", "iid"), variants, aligned, components(spark, a, variants))
    return data, transform, aligned


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    check(a)
    data, transform, aligned = load(spark, a)
    out = a.out
    if a.analysis == "gwas":
        x = pa.FixedSizeListArray.from_arrays(pa.array(data.x.ravel()), data.x.shape[1]).cast(pa.list_(pa.float64()))
        rows = spark.createDataFrame(pa.table({"sample_idx": np.arange(data.n), "y": data.y, "x": x}))
        names = data.cmap.select("component_idx").distinct().withColumn("component_name", F.format_string("component_%03d", "component_idx"))
        sinks.write_gwas(gwas.table(gwas.scan(data.geno, data.stats, rows, data.x.shape[1]), data.cmap, names, data.variants), out, {"n": data.n})
    elif a.analysis == "reml":
        kernel, residual = kernel_of(spark, a, data, aligned)
        model = models.Model(data, options(a), kernel, residual)
        fit = model.fit()
        sinks.write_fit(out, fit)
        if a.replicates > 1:
            _, mean, error = replicates(lambda seed: Problem(data.y, data.x, kernel, residual, replace(options(a), seed=seed)), a.replicates, a.seed)
            sinks.write_json(f"{out}.replicates.json", {"count": a.replicates, "mean": mean, "monte_carlo_se": error})
        if a.ancestry:
            k = kernel.size
            at = np.indices(residual.T.shape).reshape(2, -1)
            shares = spark.createDataFrame(pa.table({"sample_idx": at[0], "ancestry": at[1].astype(np.int32), "q": residual.T.ravel()}))
            parts = spark.createDataFrame([(g, float(fit.theta[g]), float(fit.theta[k + g])) for g in range(k)], "ancestry int, tau2 double, sigma2 double")
            sinks.write_json(f"{out}.ancestry_summary.json", screen.admixed_summary(shares, geno.exact_diag(data.geno, data.stats, data.samples), parts).first().asDict())
        if a.effects:
            e = model.effects()
            labels = ["intercept", *(f"covariate_{k}" for k in range(1, len(e.fixed)))]
            fixed = spark.createDataFrame([(k, label, float(b)) for k, (label, b) in enumerate(zip(labels, e.fixed))], "covariate_index int, label string, beta double")
            parts = spark.createDataFrame(pa.table({"sample_idx": np.arange(data.n)} | {f"component_{g:03d}": own for g, own in enumerate(e.random)}))
            named = data.samples.join(parts, "sample_idx").withColumnRenamed("sample_idx", "sample_index")
            total = sum((F.col(f"component_{g:03d}") for g in range(len(e.random))), F.lit(0.0))
            sinks.write_effects(out, fixed, named.select("sample_index", "iid", total.alias("random_effect")), named, sinks.effect_rows(e.snps), {"theta": model.result.theta})
            if a.predict_genotypes:
                people = text.read_fam(spark, f"{a.predict_genotypes}.fam")
                cells = bed.read_bed(spark, f"{a.predict_genotypes}.bed", people.count())
                if align.order_mismatch(data.variants, text.read_bim(spark, f"{a.predict_genotypes}.bim"), "variant_idx", "chrom", "variant_id", "bp", "a1", "a2").count():
                    raise ValueError("training and prediction files differ in their variants")
                if transform:
                    people = transform.apply(people.join(align.parse_covar(text.read_covar(spark, a.predict_covariates)), "iid"))
                else:
                    people = people.withColumn("x", F.array(F.lit(1.0)))
                predicted = model.predict(e, cells, people)
                sinks.write_prediction(predicted.join(people.select("sample_idx", "iid"), "sample_idx").withColumnRenamed("sample_idx", "sample_index"), out, {"theta": model.result.theta})
    elif a.analysis == "merge":
        got = models.merge(data, options(a), a.weak_below, a.effective_samples)
        sinks.write_fit(f"{out}.round00", got.first)
        if got.second:
            sinks.write_fit(f"{out}.round01", got.second)
        sinks.append_trace([trace_row(k, fit, got, a.weak_below, f"{out}.round{k:02d}") for k, fit in enumerate((got.first, got.second)) if fit], f"{out}.zscore_merge_trace.tsv")
        sinks.write_json(f"{out}.zscore_merge_summary.json", {"z": got.z, "se": got.se, "cutoff": a.weak_below})
        spec = got.components.groupBy("component_idx").agg(F.sort_array(F.collect_list("variant_idx")).alias("variant_indices"))
        specs.write_spec(spec.select("component_idx", F.format_string("component_%03d", "component_idx").alias("name"), "variant_indices", F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("string").alias("provenance")), f"{out}.spec.json")
    elif a.analysis == "sparse":
        got = models.sparse(data, options(a), sparse_options(a))
        rows = spark.createDataFrame([(int(i), float(b), float(g)) for i, b, g in zip(got.support, got.beta, got.gls)], "variant_idx long, beta_lasso double, beta_gls_reml double")
        sinks.write_selected(sinks.selected_rows(rows, data.variants, data.cmap), out, {"h2": got.h2, "h2_gls": got.h2_gls, "theta": got.fit.theta}, got.history)
    else:
        valid = data.stats.filter("inv_sd > 0")
        if a.start_weights:
            start = spark.read.parquet(a.start_weights).select("variant_idx", "group_idx", "w").join(valid.select("variant_idx"), "variant_idx", "left_semi")
            groups = start.agg(F.max("group_idx")).first()[0] + 1
        else:
            start, groups = screen.theta_random(valid, a.groups, a.seed, 1.0, 1.01), a.groups
        own, rounds = options(a), a.rounds or 5
        if own.method == "stochastic" or (own.method == "auto" and not models.fits_dense(data, own)):
            wide = models.relax_streamed(data, start, groups, a.rate, rounds, a.trials, options=own)
            sinks.write_relaxation(out, wide.weights, wide.fit, wide.history)
        else:
            table = start.groupBy("variant_idx").agg(F.sort_array(F.collect_list(F.struct("group_idx", "w"))).alias("w")).orderBy("variant_idx").select("w.w").collect()
            got = models.relax(data, np.array([r["w"] for r in table]), a.rate, rounds, a.trials, options=own)
            rows = [(v, k, float(got.theta[i, k])) for i, v in enumerate(got.variants) for k in range(groups)]
            sinks.write_relaxation(out, spark.createDataFrame(rows, "variant_idx long, group_idx int, w double"), got.fit, got.history)


def trace_row(k: int, fit, got, cutoff: float, prefix: str) -> dict:
    """What a round of merging adds to its trace; z-scores are those of the first fit."""
    parts = len(fit.theta) - 1
    row = {"round": k, "stage": "refit" if k else "fit", "n_components": parts, "h2": float(fit.h2), "sum_theta_g": float(fit.theta[:parts].sum()), "theta_e": float(fit.theta[parts]), "z_cutoff": cutoff}
    row |= {"theta_npy": f"{prefix}.theta.npy", "ai_npy": f"{prefix}.ai.npy"}
    if k:
        return row
    weak = int((got.z < cutoff).sum())
    after = len(got.second.theta) - 1 if got.second else parts
    z = {"z_min": float(got.z.min()), "z_median": float(np.median(got.z)), "z_max": float(got.z.max()), "se_median": float(np.median(got.se))}
    return row | z | {"n_weak_z": weak, "n_reject_z": parts - weak, "n_merged_groups": int(weak > 1), "next_n_components": after}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lociform-{a.analysis}").getOrCreate()
    run(spark, a)


if __name__ == "__main__":
    main()
