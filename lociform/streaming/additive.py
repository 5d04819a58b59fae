"""Per-variant sums over a stream of genotype cells, kept as append-only partial sums.

The sums that variant statistics need are additive, so each micro-batch appends
its own partial aggregate to a table; a read adds them up.  A batch writes under
its own number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUMS = ("cells", "miss", "het", "hom", "s1", "s2")


def partial_sums(cells: DataFrame) -> DataFrame:
    g = F.col("dosage")
    return cells.groupBy("variant_idx").agg(
        F.count("*").alias("cells"),
        F.count_if(g.isNull()).alias("miss"),
        F.count_if(g == 1).alias("het"),
        F.count_if(g == 2).alias("hom"),
        F.coalesce(F.sum(g.cast("double")), F.lit(0.0)).alias("s1"),
        F.coalesce(F.sum((g * g).cast("double")), F.lit(0.0)).alias("s2"),
    )


def maintain(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends each micro-batch's sums to ``table``."""

    def append(batch: DataFrame, number: int) -> None:
        partial_sums(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("variant_idx").agg(*(F.sum(c).alias(c) for c in SUMS))
