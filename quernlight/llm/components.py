"""Connected components by min-label contraction, on tables alone.

Nulls: an edge with a null end is none. Repeated edges, edges both ways and loops add nothing; ties can't be, as a
component's label is its smallest node. An empty table of edges gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _mapped(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """df with column replaced by its parent, where it has one."""
    p = parents.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    return df.join(p, df[column] == p["__node"], "left").withColumn(column, F.coalesce("__parent", column)).drop("__node", "__parent")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). node, root for every node that isn't its component's smallest.

    Each round points every node at its smallest neighbour (or itself), follows the pointers twice, and contracts the
    edges to what they point at; a component of n nodes is done after about log n rounds. Every round is a written table.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, maps = stored(links, "edges", small=True), []
    used = [edges]
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        nearest = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        used.append(nearest := stored(nearest, "nearest", small=True))
        used.append(parents := stored(_mapped(_mapped(nearest, "parent", nearest), "parent", nearest), "parents", small=True))
        maps.append(parents)
        left = _mapped(_mapped(edges, "a", parents), "b", parents).filter("a <> b")
        used.append(edges := stored(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", small=True))
    roots = maps[0].select("node", F.col("parent").alias("root")) if maps else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for later in maps[1:]:
        roots = _mapped(roots, "root", later)
    roots = stored(roots.filter("node <> root"), "roots", small=True)
    drop_stored(*used)
    return roots
