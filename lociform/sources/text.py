"""Readers for sample, variant, phenotype and covariate text files, as DataFrames with explicit positions.

Positions are physical line numbers: order is meaning in these formats, and a
DataFrame has none of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VARIANT_FIELDS = ("chrom", "variant_id", "cm", "bp", "a1", "a2")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``raw``: lines numbered from 0 over the whole file, or over a folder's files in order of their names.

    A line's number is its place in its split and the count of all lines in
    splits before; there is one count for each split.  Both come from one scan
    each; splits that differ between the two are an error.
    """
    read = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = read.groupBy("file", "start").agg(F.min("id").alias("base"), F.count("*").alias("n"))
    before = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)  # one row for each split
    splits = splits.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = read.join(F.broadcast(splits), ["file", "start"], "left")
    place = F.col("id") - F.col("base")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("ahead") + place).otherwise(F.raise_error(F.lit("the file's splits changed while its lines were counted")).cast("long"))
    return rows.select(number.alias("line"), "raw")


def fields(raw: Column | str = "raw") -> Column:
    """Fields between runs of white space; leading and trailing ones are ignored."""
    text = F.col(raw) if isinstance(raw, str) else raw
    return F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")


def _wide(spark: SparkSession, path: str, least: int, strict: bool, what: str) -> DataFrame:
    rows = lines(spark, path).select("line", fields().alias("parts"))
    if not strict:
        return rows.filter(F.size("parts") >= least)
    message = F.concat(F.lit(f"{what}: fewer than {least} fields in line "), (F.col("line") + 1).cast("string"))
    return rows.filter(F.size("parts") > 0).withColumn("parts", F.when(F.size("parts") < least, F.raise_error(message).cast("array<string>")).otherwise(F.col("parts")))


def read_fam(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``sample_idx`` (line), ``fid``, ``iid``; short lines are dropped, or an error where ``strict``."""
    rows = _wide(spark, path, 2, strict, "fam")
    return rows.select(F.col("line").alias("sample_idx"), F.col("parts")[0].alias("fid"), F.col("parts")[1].alias("iid"))


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    """``sample_idx``, ``iid``: by header if there is one, else the second field, or the only one."""
    rows = lines(spark, path).filter(F.trim("raw") != "").select("line", "raw", fields().alias("parts"))
    comments = F.col("raw").startswith("##")
    head = rows.filter(F.col("raw").startswith("#") & ~comments).orderBy("line").limit(1).collect()
    body = rows.filter(~F.col("raw").startswith("#"))
    if head:
        names = [p.lstrip("#") for p in head[0]["parts"]]
        if "IID" not in names:
            raise ValueError("psam: no IID column")
        iid = F.get("parts", F.lit(names.index("IID")))
    else:
        iid = F.coalesce(F.get("parts", F.lit(1)), F.get("parts", F.lit(0)))
    first = body.agg(F.min("line")).first()[0]
    if first is None:
        raise ValueError("psam: no samples")
    return body.select((F.col("line") - first).alias("sample_idx"), iid.alias("iid"))


def fam_from_psam(psam: DataFrame) -> DataFrame:
    """Sample rows in the six-field layout."""
    return psam.select("sample_idx", F.col("iid").alias("fid"), "iid", *(F.lit(x).alias(n) for n, x in (("father", "0"), ("mother", "0"), ("sex", "0"), ("status", "-9"))))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    rows = _wide(spark, path, 6, True, "bim")
    return rows.select(F.col("line").alias("variant_idx"), *(F.col("parts")[k].alias(n) for k, n in enumerate(VARIANT_FIELDS)))


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """Variants by header; the first alternative allele is a1, the reference a2, and there is no genetic position."""
    rows = lines(spark, path).filter(~F.col("raw").startswith("##") & (F.trim("raw") != ""))
    head = rows.filter(F.col("raw").startswith("#CHROM")).orderBy("line").limit(1).collect()
    if not head:
        raise ValueError("pvar: no header")
    names = head[0]["raw"].lstrip("#").split()
    at = {n: names.index(n) for n in ("CHROM", "POS", "ID", "REF", "ALT")}
    p = lambda n: F.col("parts")[at[n]]
    body = rows.filter(~F.col("raw").startswith("#")).select((F.col("line") - head[0]["line"] - 1).alias("variant_idx"), fields().alias("parts"))
    return body.select("variant_idx", p("CHROM").alias("chrom"), p("ID").alias("variant_id"), F.lit(".").alias("cm"), p("POS").alias("bp"), F.split(p("ALT"), ",")[0].alias("a1"), p("REF").alias("a2"))


def read_variants(spark: SparkSession, prefix: str, kind: str = "bed") -> DataFrame:
    return read_bim(spark, f"{prefix}.bim") if kind == "bed" else read_pvar(spark, f"{prefix}.pvar")


def read_samples(spark: SparkSession, prefix: str, kind: str = "bed") -> DataFrame:
    return read_fam(spark, f"{prefix}.fam") if kind == "bed" else read_psam(spark, f"{prefix}.psam")


def read_pheno(spark: SparkSession, path: str) -> DataFrame:
    """``iid``, ``value`` as text; a header line parses to no number and drops out later."""
    rows = _wide(spark, path, 3, False, "pheno")
    return rows.select(F.col("parts")[1].alias("iid"), F.col("parts")[2].alias("value"))


def read_covar(spark: SparkSession, path: str) -> DataFrame:
    """``iid``, ``parts``: covariates as text; rows of another width than most are an error."""
    from ..operators.align import modal_width

    rows = _wide(spark, path, 3, False, "covar").select(F.col("parts")[1].alias("iid"), F.slice("parts", F.lit(3), F.size("parts")).alias("parts"))
    odd = modal_width(rows).collect()
    if odd and odd[0]["deviating"]:
        raise ValueError(f"covar: {odd[0]['deviating']} rows do not have {odd[0]['width']} covariates")
    return rows


def read_keep(spark: SparkSession, path: str) -> DataFrame:
    """``iid``: the second field, or the only one."""
    rows = lines(spark, path).filter(F.trim("raw") != "").select(fields().alias("parts"))
    return rows.select(F.coalesce(F.get("parts", F.lit(1)), F.get("parts", F.lit(0))).alias("iid"))


def read_admixture(spark: SparkSession, path: str, samples: DataFrame, slack: float = 5e-3, fam: DataFrame | None = None) -> DataFrame:
    """``sample_idx``, ``ancestry``, ``q`` of ``samples``; shares are checked and tiny negatives become 0.

    Rows belong to the individuals of ``fam(sample_idx, iid)``, the table that
    was used to make the file, and meet ``samples`` by id; without it they are in
    the order of ``samples``.  A sample without a row is an error.
    """
    values = F.transform(fields(), lambda x: x.cast("double"))
    rows = lines(spark, path).filter(F.trim("raw") != "").select(F.col("line").alias("sample_idx"), values.alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    bad = (F.abs(total - 1) > slack) | F.exists("q", lambda x: x < -1e-6)
    checked = rows.withColumn("q", F.when(bad, F.raise_error(F.concat(F.lit("ancestry shares are wrong in row "), F.col("sample_idx").cast("string"))).cast("array<double>")).otherwise(F.col("q")))
    if fam is None:
        met = samples.select("sample_idx").join(checked, "sample_idx", "left")
    else:
        met = samples.select("sample_idx", "iid").join(checked.join(fam.select("sample_idx", "iid"), "sample_idx").drop("sample_idx"), "iid", "left")
    missing = F.raise_error(F.concat(F.lit("no ancestry shares for sample "), F.col("sample_idx").cast("string"))).cast("array<double>")
    met = met.select("sample_idx", F.when(F.col("q").isNull(), missing).otherwise(F.col("q")).alias("q"))
    return met.select("sample_idx", F.posexplode("q").alias("ancestry", "q")).withColumn("q", F.greatest("q", F.lit(0.0)))
