"""Connected components of a link table, distributed: nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links(a, b)``; the root is the least node of its component.

    Each round every node takes the least root among its own and its
    neighbours', then the root of its root.  Aggregations combine on the map
    side, so a node with very many links costs one row a task.  Roots are
    written to the shared folder in every round; each round lowers some root, so
    it ends, and trees get flatter by half, so it ends soon.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    roots_before = None
    while True:
        heard = both.join(roots.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        # A root's own root learns of every smaller root seen next to its tree.
        near = heard.groupBy("node").agg(F.min("root").alias("seen"))
        met = roots.join(near, "node").select("node", "root", F.least("root", "seen").alias("seen"))
        hooks = met.groupBy(F.col("root").alias("top")).agg(F.min("seen").alias("low"))
        step = met.join(hooks, met["root"] == hooks["top"]).select("node", "root", F.least("seen", "low").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("over"))
        new = saved(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("over", "next")).alias("root"), (F.least("next", F.coalesce("over", "next")) != F.col("root")).alias("moved")), "roots")
        if roots_before is not None:
            forget(roots_before)
        roots_before, roots = roots, new.select("node", "root")
        roots.saved_at = new.saved_at
        if not new.filter("moved").limit(1).count():
            forget(both, roots_before)
            return roots
