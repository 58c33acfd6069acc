"""Connected components of a link table, as joins and grouped minima.

Alternating large-star and small-star steps (Kiveris et al. 2014): every step
is two shuffles of the links, a node of high degree is only ever a grouped
minimum (combined before the shuffle) and a join key, and the number of steps
is logarithmic in the longest path. Each step is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_stage, write_stage


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node``, ``label`` for each node of ``links`` (``a``, ``b``, of one
    type): the label is the component's least node. Self-links and repeated
    links do no harm; no links give no rows."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    at = write_stage(spark, links.filter("a <> b").select(high, low).distinct(), "links")
    mark = None
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        then = write_stage(spark, small, "links")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove_stage(spark, at)
        at = then
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    return at.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        at.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
