"""Genotype, phenotype and covariate tables derived from the driver's star schema, as DataFrames and as SQL.

Samples are customers with orders, variants are part brands (or part keys), a
dosage is the capped count of a customer's line items; a fixed arithmetic rule
makes some cells missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.align import ordered


class Tables:
    """Derived tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._samples = spark, sf_dir, None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def pheno(self) -> DataFrame:
        """``iid``, ``pheno`` of customers; every 50th has none."""
        c = self.read("customer")
        return c.select(F.col("c_custkey").cast("long").alias("iid"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal").cast("double")).alias("pheno"))

    def spending(self) -> DataFrame:
        """``iid``, ``pheno``: what a customer's line items of three brands cost, so some variants have effects to find."""
        line = self.read("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
        orders = self.read("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").cast("long").alias("iid"))
        part = self.read("part").filter(F.col("p_brand").isin("Brand#11", "Brand#23", "Brand#42")).select(F.col("p_partkey").alias("p"))
        spent = line.join(orders, "o").join(part, "p").groupBy("iid").agg(F.count("*").cast("double").alias("items"))
        return self.pheno().filter("pheno IS NOT NULL").join(spent, "iid", "left").select("iid", (F.col("pheno") / 5000 + 2 * F.coalesce("items", F.lit(0.0))).alias("pheno"))

    def samples(self) -> DataFrame:
        """``sample_idx``, ``iid``: customers with orders and a phenotype, in key order."""
        o = self.read("orders").select(F.col("o_custkey").cast("long").alias("iid"))
        if self._samples is None:  # numbered by ranges of ids, once
            own = self.pheno().filter("pheno IS NOT NULL").join(o, "iid", "left_semi").select("iid")
            self._samples = ordered(own, "iid").select(F.col("number").alias("sample_idx"), "iid")
        return self._samples

    def n(self) -> int:
        return self.samples().count()

    def variants(self) -> DataFrame:
        """``variant_idx``, metadata as strings: one variant for each brand."""
        p = self.read("part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("bp"), F.min("p_type").alias("kind"))
        rank = (F.row_number().over(W.orderBy("p_brand")) - 1).cast("long")  # brands are few
        return p.select(rank.alias("variant_idx"), F.concat(F.lit("c"), (F.pmod("k", F.lit(5))).cast("string")).alias("chrom"), F.col("p_brand").alias("variant_id"), F.lit("0").alias("cm"), F.col("bp").cast("string").alias("bp"), F.lit("A").alias("a1"), F.lit("G").alias("a2"))

    def geno(self) -> DataFrame:
        """Present cells by brand; missing where (31 sample + variant) mod 97 is 0, on the full grid."""
        s, v = self.samples(), F.broadcast(self.variants().select("variant_idx", "variant_id"))  # 25 brands
        line = self.read("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
        orders = self.read("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").cast("long").alias("iid"))
        part = self.read("part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("variant_id"))
        seen = line.join(orders, "o").join(part, "p").join(v, "variant_id").join(s, "iid").groupBy("sample_idx", "variant_idx").agg(F.least(F.count("*"), F.lit(2)).cast("byte").alias("dosage"))
        hole = (F.col("sample_idx") * 31 + F.col("variant_idx")) % 97 == 0
        holes = s.select("sample_idx").crossJoin(v.select("variant_idx")).filter(hole).withColumn("dosage", F.lit(None).cast("byte"))  # 25 brands a sample
        return seen.filter(~hole).unionByName(holes)

    def wide_geno(self) -> DataFrame:
        """Present cells by part key, none missing."""
        line = self.read("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("long").alias("variant_idx"))
        orders = self.read("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").cast("long").alias("iid"))
        return line.join(orders, "o").join(self.samples(), "iid").groupBy("sample_idx", "variant_idx").agg(F.least(F.count("*"), F.lit(2)).cast("byte").alias("dosage"))

    def wide_variants(self) -> DataFrame:
        p = self.read("part")
        return p.select(F.col("p_partkey").cast("long").alias("variant_idx"), F.col("p_brand").alias("chrom"), F.col("p_partkey").cast("string").alias("variant_id"), F.lit("0").alias("cm"), F.col("p_size").cast("string").alias("bp"), F.lit("A").alias("a1"), F.lit("G").alias("a2"))

    def components(self) -> DataFrame:
        """``component_idx``, ``variant_idx``: brands by their number modulo 3."""
        return self.variants().select((F.col("variant_idx") % 3).cast("int").alias("component_idx"), "variant_idx")

    def v(self, columns: int = 2) -> DataFrame:
        """Signs from arithmetic: ``sample_idx``, ``col``, ``v``."""
        each = F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
        sign = F.when((F.col("sample_idx") * 7919 + F.col("col") * 104729) % 1009 % 2 == 0, 1.0).otherwise(-1.0)
        return self.samples().select("sample_idx", each.alias("col")).withColumn("v", sign)

    def coefficients(self) -> DataFrame:
        return self.variants().select("variant_idx", F.lit(0).alias("col"), ((F.col("variant_idx") * 37 % 11 - 5) / 10.0).alias("b"))

    def theta(self) -> DataFrame:
        return self.spark.sql("SELECT * FROM VALUES (0, 0.5D), (1, 0.25D), (2, 0.125D) AS t(component_idx, theta)")

    def soft(self, groups: int = 2) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        rows = self.variants().select("variant_idx", each.alias("group_idx")).withColumn("raw", ((F.col("variant_idx") * 7919 + F.col("group_idx") * 104729) % 1009 + 1).cast("double"))
        return rows.select("variant_idx", "group_idx", (F.col("raw") / F.sum("raw").over(W.partitionBy("variant_idx"))).alias("w"))

    def admixture(self) -> DataFrame:
        """``sample_idx``, ``ancestry``, ``q``: shares of a customer's orders by priority; absent shares are absent rows."""
        o = self.read("orders").select(F.col("o_custkey").cast("long").alias("iid"), F.substring("o_orderpriority", 1, 1).cast("int").alias("ancestry"))
        rows = o.join(self.samples(), "iid").groupBy("sample_idx", "ancestry").agg(F.count("*").alias("k"))
        return rows.select("sample_idx", "ancestry", (F.col("k") / F.sum("k").over(W.partitionBy("sample_idx"))).alias("q"))

    def block_w(self) -> DataFrame:
        """Symmetric weights inside blocks of five variants."""
        a = self.variants().select(F.col("variant_idx").alias("i"), F.floor(F.col("variant_idx") / 5).cast("int").alias("block_idx"))
        b = a.select(F.col("i").alias("j"), "block_idx")
        return a.join(b, "block_idx").select("block_idx", "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.25 / (1 + F.abs(F.col("i") - F.col("j")))).alias("w"))

    def covar(self) -> DataFrame:
        """``iid``, ``cov``: nation, mean order price, number of orders, and a constant."""
        o = self.read("orders").groupBy(F.col("o_custkey").cast("long").alias("iid")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
        c = self.read("customer").select(F.col("c_custkey").cast("long").alias("iid"), F.col("c_nationkey").cast("double").alias("nation"))
        return c.join(o, "iid").select("iid", F.array("nation", F.col("price").cast("double"), "orders", F.lit(1.0)).alias("cov"))


#: The same tables for DuckDB.
SQL = """
    pheno AS (SELECT CAST(c_custkey AS BIGINT) AS iid, CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS pheno FROM customer),
    samples AS (SELECT CAST(row_number() OVER (ORDER BY iid) - 1 AS BIGINT) AS sample_idx, iid FROM pheno
        WHERE pheno IS NOT NULL AND iid IN (SELECT o_custkey FROM orders)),
    cnt AS (SELECT count(*) AS n FROM samples),
    variants AS (SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS variant_idx, 'c' || CAST(min(p_partkey) % 5 AS VARCHAR) AS chrom,
        p_brand AS variant_id, '0' AS cm, CAST(min(p_size) AS VARCHAR) AS bp, 'A' AS a1, 'G' AS a2 FROM part GROUP BY p_brand),
    grid AS (SELECT sample_idx, iid, variant_idx, variant_id FROM samples, variants),
    seen AS (SELECT o_custkey AS iid, p_brand AS variant_id, least(count(*), 2) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    cells AS (SELECT grid.sample_idx, grid.variant_idx, CASE WHEN (grid.sample_idx * 31 + grid.variant_idx) % 97 = 0 THEN NULL ELSE coalesce(seen.dosage, 0) END AS g
        FROM grid LEFT JOIN seen USING (iid, variant_id)),
    st0 AS (SELECT variant_idx, count(g) AS cnt, avg(g) AS mean, avg(g * g) - avg(g) * avg(g) AS var, count(*) FILTER (g = 1) AS het, count(*) FILTER (g = 2) AS hom, count(*) FILTER (g IS NULL) AS miss
        FROM cells GROUP BY variant_idx),
    stats AS (SELECT *, CASE WHEN cnt > 0 AND var > 0 THEN 1 / sqrt(greatest(var, 1e-6)) ELSE 0 END AS inv_sd FROM st0),
    z AS (SELECT sample_idx, variant_idx, CASE WHEN g IS NULL THEN 0 ELSE (g - mean) * inv_sd END AS z FROM cells JOIN stats USING (variant_idx) WHERE inv_sd > 0),
    meff AS (SELECT count(*) AS m_eff FROM stats WHERE inv_sd > 0),
    components AS (SELECT CAST(variant_idx % 3 AS INTEGER) AS component_idx, variant_idx FROM variants),
    cmeff AS (SELECT component_idx, count(*) AS m, count(*) FILTER (inv_sd > 0) AS m_eff, sum(CASE WHEN inv_sd > 0 THEN cnt ELSE 0 END) AS filled FROM components JOIN stats USING (variant_idx) GROUP BY 1),
    v AS (SELECT sample_idx, col, CASE WHEN (sample_idx * 7919 + col * 104729) % 1009 % 2 = 0 THEN 1.0 ELSE -1.0 END AS v FROM samples, (VALUES (0), (1)) AS t(col)),
    b AS (SELECT variant_idx, 0 AS col, (variant_idx * 37 % 11 - 5) / 10.0 AS b FROM variants),
    theta(component_idx, theta) AS (VALUES (0, 0.5), (1, 0.25), (2, 0.125)),
    soft0 AS (SELECT variant_idx, grp AS group_idx, CAST((variant_idx * 7919 + grp * 104729) % 1009 + 1 AS DOUBLE) AS raw FROM variants, (VALUES (0), (1)) AS t(grp)),
    soft AS (SELECT variant_idx, group_idx, raw / sum(raw) OVER (PARTITION BY variant_idx) AS w FROM soft0),
    adm0 AS (SELECT sample_idx, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ancestry, count(*) AS k FROM orders JOIN samples ON o_custkey = iid GROUP BY 1, 2),
    adm AS (SELECT sample_idx, ancestry, k / CAST(sum(k) OVER (PARTITION BY sample_idx) AS DOUBLE) AS q FROM adm0),
    bw AS (SELECT CAST(floor(a.variant_idx / 5) AS INTEGER) AS block_idx, a.variant_idx AS i, c.variant_idx AS j,
        CASE WHEN a.variant_idx = c.variant_idx THEN 1.0 ELSE 0.25 / (1 + abs(a.variant_idx - c.variant_idx)) END AS w
        FROM variants a JOIN variants c ON floor(a.variant_idx / 5) = floor(c.variant_idx / 5)),
    covar AS (SELECT CAST(c_custkey AS BIGINT) AS iid, CAST(c_nationkey AS DOUBLE) AS x0, price AS x1, orders AS x2, 1.0 AS x3 FROM customer
        JOIN (SELECT o_custkey, CAST(avg(o_totalprice) AS DOUBLE) AS price, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1) ON c_custkey = o_custkey),
    zv AS (SELECT variant_idx, col, sum(z * v) AS score FROM z JOIN v USING (sample_idx) GROUP BY 1, 2)
"""
