"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize


def components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``links``, by alternating large and small stars.

    Each round links all larger neighbours of a node, then all smaller ones, to its smallest neighbour; depth shrinks
    exponentially. Rounds are written to the shared folder, so lineage stays short. Minima are aggregated before they are
    joined back, so a node with very many links is no task of its own. Links that repeat, loop or have a null end are
    harmless; an empty table has no nodes.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") > F.col("lo"))).distinct()
    edges, state = materialize(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m"))
        # large star: node lo passes its larger neighbour hi to its minimum
        large = edges.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct()
        # small star: node hi passes its smaller neighbours to the smallest of them
        down = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        small = large.join(down, F.col("hi") == F.col("u")).select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        edges = materialize(small.filter(F.col("hi") > F.col("lo")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
