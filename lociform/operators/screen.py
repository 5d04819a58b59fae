"""Screening, candidates, optimality scans, merging and grouping rules, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: components with a z-score below it are weak (the upper 5 % point of the normal distribution).
WEAK_Z = 1.6448536269514722


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` variants with the largest absolute score; ties to the smaller index."""
    return scores.withColumn("size", F.abs("score")).orderBy(F.desc("size"), "variant_idx").limit(k).drop("size")


def assemble(previous: DataFrame, screened: DataFrame, k: int) -> DataFrame:
    """Previous support first, then screened variants by score, up to ``k``; in order of index."""
    old = previous.select("variant_idx", F.lit(0).alias("tier"), F.lit(0.0).alias("size"))
    new = screened.join(previous.select("variant_idx"), "variant_idx", "left_anti").select("variant_idx", F.lit(1).alias("tier"), F.abs("score").alias("size"))
    return old.union(new).orderBy("tier", F.desc("size"), "variant_idx").limit(k).select("variant_idx").orderBy("variant_idx")


def kkt_violators(scores: DataFrame, candidates: DataFrame, penalty: float, abs_tol: float = 1e-4, rel_tol: float = 1e-4) -> DataFrame:
    """Variants outside the candidates whose absolute score exceeds the penalty by more than the tolerance."""
    limit = penalty + max(abs_tol, rel_tol * max(1.0, abs(penalty)))
    return scores.join(candidates.select("variant_idx"), "variant_idx", "left_anti").filter(F.abs("score") > limit)


def add_violators(candidates: DataFrame, violators: DataFrame, most: int) -> DataFrame:
    return candidates.select("variant_idx").union(top_k(violators, most).select("variant_idx")).distinct()


def global_to_local(indices: DataFrame, sources: DataFrame) -> DataFrame:
    """``grm_idx``, ``local_idx`` of global variant numbers, by a range join on cumulative offsets.

    ``sources(grm_idx, first, m)`` has one row for each source.
    """
    s = F.broadcast(sources)
    return indices.join(s, (indices["global_idx"] >= s["first"]) & (indices["global_idx"] < s["first"] + s["m"])).select("global_idx", "grm_idx", (F.col("global_idx") - F.col("first")).alias("local_idx"))


def lookup(indices: DataFrame, variants: DataFrame) -> DataFrame:
    """Metadata of selected variants, with stand-ins where there is none."""
    names = ("chrom", "cm", "bp", "a1", "a2")
    out = indices.join(variants, "variant_idx", "left")
    return out.select("variant_idx", F.coalesce("variant_id", F.concat(F.lit("SNP_"), F.col("variant_idx").cast("string"))).alias("variant_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in names))


def classify(components: DataFrame, cutoff: float = WEAK_Z) -> DataFrame:
    """``z`` (0 where the standard error is 0) and ``weak`` for ``components(component_idx, theta, se)``."""
    z = F.when(F.col("se") > 0, F.col("theta") / F.col("se")).otherwise(0.0)
    return components.withColumn("z", z).withColumn("weak", F.col("z") < cutoff)


def merge_weak(components: DataFrame, cutoff: float = WEAK_Z) -> DataFrame:
    """New component of each old one: strong ones keep their order, weak ones join into a last one.

    A single weak component stays where it is.
    """
    rows = classify(components, cutoff).crossJoin(F.broadcast(classify(components, cutoff).agg(F.count_if("weak").alias("n_weak"))))  # one row
    joins = F.col("weak") & (F.col("n_weak") > 1)
    rank = F.row_number().over(W.orderBy("component_idx"))  # components are few: their count is that of variance parameters
    kept = rows.filter(~joins).withColumn("target", (rank - 1).cast("long"))
    last = F.broadcast(kept.agg(F.count("*").alias("last")))
    merged = rows.filter(joins).crossJoin(last).withColumn("target", F.col("last").cast("long")).drop("last")  # one row
    return kept.unionByName(merged).select("component_idx", "z", "weak", "target")


def merged_spec(cmap: DataFrame, targets: DataFrame) -> DataFrame:
    """Variants of each merged component, with what it was made of."""
    rows = cmap.join(F.broadcast(targets), "component_idx")
    return rows.groupBy("target").agg(F.count("*").alias("m"), F.countDistinct("component_idx").alias("n_sources"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.sort_array(F.collect_set("component_idx")).alias("sources"))


def theta_uniform(variants: DataFrame, groups: int) -> DataFrame:
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    return variants.select("variant_idx", each.alias("group_idx"), F.lit(1.0 / groups).alias("w"))


def theta_random(variants: DataFrame, groups: int, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows of random weights that sum to 1; a variant's weights depend on the seed and its index only."""
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "variant_idx", "group_idx"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = variants.select("variant_idx", each.alias("group_idx")).withColumn("raw", low + (high - low) * unit)
    return rows.select("variant_idx", "group_idx", (F.col("raw") / F.sum("raw").over(W.partitionBy("variant_idx"))).alias("w"))


def group_totals(theta: DataFrame) -> DataFrame:
    """``total`` weight of each group; an empty group is an error."""
    total = F.sum("w")
    return theta.groupBy("group_idx").agg(F.when(total == 0, F.raise_error(F.lit("a group has no weight")).cast("double")).otherwise(total).alias("total"))


def soft_gradient(parts: DataFrame) -> DataFrame:
    """``grad`` of each (variant, group) from ``parts(variant_idx, group_idx, tau, total, zpy, zpz, ypkpy, trpk)``."""
    grad = F.col("tau") * (F.col("zpy") * F.col("zpy") - F.col("zpz") - (F.col("ypkpy") - F.col("trpk"))) / (2 * F.col("total"))
    return parts.select("variant_idx", "group_idx", grad.alias("grad"))


def eg_update(theta: DataFrame, grad: DataFrame, rate: float) -> DataFrame:
    """Exponentiated-gradient step: weights of a variant stay positive and sum to 1."""
    own = W.partitionBy("variant_idx")
    rows = theta.join(grad, ["variant_idx", "group_idx"])
    step = rate * F.col("grad")
    rows = rows.withColumn("raw", F.col("w") * F.exp(step - F.max(step).over(own)))
    return rows.select("variant_idx", "group_idx", (F.col("raw") / F.sum("raw").over(own)).alias("w"))


def heritability(parts: DataFrame, residual: float) -> DataFrame:
    """Trace-weighted share of the genetic components of ``parts(theta, mean_diag)``."""
    g = F.sum(F.col("theta") * F.col("mean_diag"))
    return parts.agg((g / (g + residual)).alias("h2"))


def replicate_summary(values: DataFrame) -> DataFrame:
    """Mean and Monte-Carlo standard error of ``values(component_idx, value)`` over replicates."""
    return values.groupBy("component_idx").agg(F.avg("value").alias("mean"), F.sqrt(F.var_samp("value") / F.count("*")).alias("se"))


def ebic_table(path: DataFrame, n: int, p: int, gamma: float = 0.5) -> DataFrame:
    """``ebic`` of each row of ``path(lam, k, rss)``; log binomials are sums of logarithms."""
    each = F.aggregate(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), F.lit(0.0), lambda a, i: a + F.log((F.lit(p) - F.col("k") + i).cast("double")) - F.log(i.cast("double")))
    choose = F.when(F.col("k") > 0, each).otherwise(0.0)
    return path.withColumn("ebic", n * F.log(F.col("rss") / n) + F.col("k") * F.log(F.lit(float(n))) + 2 * gamma * choose)


def ebic_best(path: DataFrame, n: int, p: int, gamma: float = 0.5) -> DataFrame:
    """The row with the least criterion; ties to the smaller support."""
    return ebic_table(path, n, p, gamma).orderBy("ebic", "k", F.desc("lam")).limit(1)


def chive(fitted: DataFrame) -> DataFrame:
    """``q_hat`` of ``fitted(y, value)``, value = Z b over the selected variants: |Zb|^2 / n + 2 (Zb)'(y - Zb) / n."""
    u, y = F.col("value"), F.col("y")
    return fitted.agg(((F.sum(u * u) + 2 * F.sum(u * (y - u))) / F.count("*")).alias("q_hat"))


def admixed_summary(shares: DataFrame, diag: DataFrame, components: DataFrame) -> DataFrame:
    """``weighted_genetic``, ``weighted_sigma``, ``weighted_h2``: means over samples for ancestry components.

    ``shares(sample_idx, ancestry, q)``, ``diag(sample_idx, diag)`` of the base kernel, ``components(ancestry, tau2, sigma2)``.
    Samples without any variance count in no mean of the share.
    """
    own = shares.join(F.broadcast(components), "ancestry").groupBy("sample_idx").agg(F.sum(F.col("q") * F.col("tau2")).alias("tau"), F.sum(F.col("q") * F.col("sigma2")).alias("sigma"))  # a row for each ancestry
    rows = own.join(diag, "sample_idx").withColumn("genetic", F.col("diag") * F.col("tau"))
    total = F.col("genetic") + F.col("sigma")
    return rows.agg(F.avg("genetic").alias("weighted_genetic"), F.avg("sigma").alias("weighted_sigma"), F.avg(F.when(total > 0, F.col("genetic") / total)).alias("weighted_h2"))


def predict(parts: DataFrame, mean: float, scale: float) -> DataFrame:
    """Predictions on the raw scale from ``parts(sample_idx, fixed_effect, random_effect)``."""
    std = F.col("fixed_effect") + F.col("random_effect")
    return parts.select("sample_idx", "fixed_effect", "random_effect", std.alias("y_pred_std"), (mean + scale * std).alias("y_pred"))
