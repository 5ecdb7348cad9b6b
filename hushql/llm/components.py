"""Connected components of a link table by alternating large and small stars.

Every step is a join and an aggregate of links, so no component is ever gathered in a task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import cut


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node of the component.

    Null ends, links of a node to itself and repeated links change nothing; no links give no rows.
    """
    edge = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edge = cut(edge)
    before = _state(edge)
    for _ in range(most):
        if not before[0]:
            break
        both = edge.union(edge.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # A node without larger neighbours keeps its smallest link through the other end's star.
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edge = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _state(edge)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {most} rounds")
    return edge.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(edge.select("b", "b").distinct())
