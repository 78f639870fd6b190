"""Connected components by contraction: every node points at its least neighbour, pointers are followed to their ends,
and the edges are mapped to the groups and cleaned. At least half of the nodes with edges go in each round. All state is
in tables in the shared folder; the driver only sees counts. A hub's neighbours are pre-aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member) for every node of edges (a, b); nodes without edges have no row."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                       .select("node", F.least("node", "m").alias("root")), "least")
        while True:
            up = least.select(F.col("node").alias("root"), F.col("root").alias("above"))
            step = stored(least.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "least")
            least = step.select("node", "root")
            if not step.where("moved").limit(1).count():
                break
        if mapping is None:
            mapping = least.select("node", F.col("root").alias("component"))
        else:
            to = least.select(F.col("node").alias("component"), "root")
            mapping = stored(mapping.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "mapping")
        a, b = (least.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        edges = stored(edges.join(a, "a").join(b, "b").where("a_root <> b_root").select(
            F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    if mapping is None:
        kind = edges.schema["a"].dataType
        mapping = edges.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    return mapping
