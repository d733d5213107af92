"""Connected components of a table of links, by alternating stars.

Every round each vertex hands the smallest vertex it knows to its larger neighbours, and then to its smaller ones;
long chains halve, and a component ends as a star round its smallest vertex.  A round is two grouped minima and
two joins, on narrow rows, and is written to the shared folder; a vertex with many neighbours is pre-aggregated, and its rows can
be split in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangloc.llm.common import removed, staged


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, component) for every vertex that has a link; component is the smallest vertex of its component.

    Loops and repeated links are allowed; rows with a null end are no links.  The result is a staged table.
    """
    ends = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    edges = staged(ends.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "links")
    before = _summary(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        # Repeated links do no harm until the end of the round.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large, "links")
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after_edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        removed(edges, large)
        edges, after = after_edges, _summary(after_edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    found = staged(edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots), "components")
    removed(edges)
    return found
