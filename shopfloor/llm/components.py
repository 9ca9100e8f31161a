"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.sources.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per vertex of the edges (long ids): node and root, the smallest id of its component.

    Every round hangs each vertex's larger neighbours, then its smaller ones, on
    the smallest vertex it knows. Minima are aggregated before they are joined
    back, so a vertex with very many edges never gathers in one task. Rounds grow
    with the logarithm of the component size. Loops and null ids are ignored.
    """
    high, low = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = stage(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.union(least.select("a", "m")).distinct(), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
