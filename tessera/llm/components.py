"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import written


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    pairs = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges (two long columns).

    Loops and repeats do no harm. Each round is written to the shared folder, so lineage stays short; a hot node costs
    a map-side minimum and a join that adaptive execution can split, never one task's list.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        e = written(_small(_large(e)), "edges")
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
