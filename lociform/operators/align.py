"""Alignment of samples, phenotypes and covariates by individual id, as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing phenotype or covariate.
MISSING_TOKENS = ("-9", "NA", "NaN", "nan", "")
MISSING_NUMBER = -9.0
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?:inf|Inf|infinity|Infinity)$"


def number(text: Column) -> Column:
    """A double, or null for missing tokens, the missing number and what is no number."""
    value = F.when(text.rlike(_NUMBER) & ~text.isin(*MISSING_TOKENS), text.try_cast("double"))
    return F.when(value != MISSING_NUMBER, value)


def parse_pheno(rows: DataFrame, value: str = "value") -> DataFrame:
    """``iid``, ``pheno`` of the rows whose value is present."""
    return rows.select("iid", number(F.col(value).cast("string")).alias("pheno")).filter(F.col("pheno").isNotNull())


def parse_covar(rows: DataFrame) -> DataFrame:
    """``iid``, ``cov``: rows (``iid``, ``parts``) all of whose values are present."""
    cov = F.transform("parts", number)
    return rows.select("iid", cov.alias("cov")).filter(~F.exists("cov", lambda x: x.isNull()))


def modal_width(rows: DataFrame, parts: str = "parts") -> DataFrame:
    """The most frequent number of covariates, ties to the smaller, and how many rows deviate from it."""
    widths = rows.groupBy(F.size(parts).alias("width")).agg(F.count("*").alias("n"))
    top = widths.orderBy(F.desc("n"), F.asc("width")).limit(1)
    return top.crossJoin(rows.agg(F.count("*").alias("total"))).select("width", "n", (F.col("total") - F.col("n")).alias("deviating"))  # one row each


def duplicate_ids(rows: DataFrame, first: int = 10) -> DataFrame:
    """Ids that occur more than once, the first few in order."""
    return rows.groupBy("iid").agg(F.count("*").alias("n")).filter("n > 1").orderBy("iid").limit(first)


def require_unique(rows: DataFrame, what: str) -> None:
    found = [r["iid"] for r in duplicate_ids(rows).collect()]
    if found:
        raise ValueError(f"{what} repeats ids: {', '.join(map(str, found))}")


def align(samples: DataFrame, pheno: DataFrame, covar: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``sample_idx``, ``iid``, ``pheno``[, ``cov``] of the samples that have all that is asked for, in sample order."""
    out = samples.join(pheno, "iid")
    if covar is not None:
        out = out.join(covar, "iid")
    if keep is not None:
        out = out.join(keep.select("iid"), "iid", "left_semi")
    return out


def dropped(samples: DataFrame, pheno: DataFrame, covar: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``sample_idx``, ``iid`` of the samples that ``align`` leaves out: invalid ones, and valid ones outside the keep list."""
    complete = pheno.select("iid") if covar is None else pheno.select("iid").join(covar.select("iid"), "iid", "left_semi")
    invalid = samples.join(complete, "iid", "left_anti")
    if keep is None:
        return invalid
    outside = samples.join(complete, "iid", "left_semi").join(keep.select("iid"), "iid", "left_anti")
    return invalid.unionByName(outside)


def order_mismatch(left: DataFrame, right: DataFrame, position: str = "sample_idx", *columns: str) -> DataFrame:
    """The first position at which two ordered tables differ; empty if they agree."""
    names = columns or ("iid",)
    a = left.select(F.col(position).alias("p"), F.struct(*names).alias("a"))
    b = right.select(F.col(position).alias("p"), F.struct(*names).alias("b"))
    return a.join(b, "p", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("p").alias("position")).filter("position IS NOT NULL")


def subsequence(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept(iid, rank)`` with sample positions; raises where an id is unknown or the order differs."""
    out = kept.join(samples, "iid", "left")
    bad = out.filter(F.col("sample_idx").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"unknown sample {bad[0]['iid']}")
    # Positions ascend with ranks just when both number the rows alike; neighbours are compared over range partitions.
    by_rank, by_place = (ordered(out, c).select("iid", F.col("number").alias(c)) for c in ("rank", "sample_idx"))
    wrong = by_rank.withColumnRenamed("rank", "a").join(by_place.withColumnRenamed("sample_idx", "b"), "iid").filter("a <> b").orderBy("a").limit(1).collect()
    if wrong:
        raise ValueError(f"sample {wrong[0]['iid']} is out of order")
    return out


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``number``, their place from 0 in the order of ``columns``, which must tell rows apart.

    Rows are dealt by ranges; one count for each range goes to the driver.
    """
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__range", F.spark_partition_id()).persist()
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    first, at = {}, 0
    for k in sorted(counts):
        first[k], at = at, at + counts[k]
    offset = F.element_at(F.create_map(*(F.lit(x) for k in first for x in (k, first[k]))), F.col("__range")) if first else F.lit(0)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("number", (offset + inside).cast("long")).drop("__range")


@dataclass
class CovariateTransform:
    """Fitted on training rows, applied to any: constant columns go, the others are standardised."""

    keep: list[bool]
    mean: list[float]
    sd: list[float]
    intercept: bool = True

    @classmethod
    def fit(cls, covar: DataFrame, width: int, intercept: bool = True) -> CovariateTransform:
        each = [f(F.col("cov")[k]).alias(f"{n}{k}") for k in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = covar.agg(*each).first() if width else {}
        sd = [row[f"s{k}"] or 0.0 for k in range(width)]
        return cls([s > 0 for s in sd], [row[f"m{k}"] or 0.0 for k in range(width)], sd, intercept)

    def apply(self, covar: DataFrame) -> DataFrame:
        """Adds ``x``: the intercept, then the kept columns standardised."""
        own = [(F.col("cov")[k] - self.mean[k]) / self.sd[k] for k, good in enumerate(self.keep) if good]
        return covar.withColumn("x", F.array(*([F.lit(1.0)] if self.intercept else []), *own))


def standardise_response(rows: DataFrame, column: str = "pheno") -> DataFrame:
    """Mean 0 and scale 1; the scale is the population deviation plus 1e-6."""
    fit = rows.agg(F.avg(column).alias("mean"), (F.stddev_pop(column) + 1e-6).alias("scale"))
    return rows.crossJoin(F.broadcast(fit)).withColumn("y", (F.col(column) - F.col("mean")) / F.col("scale"))  # one row
