"""Connected components of a graph given as an edge table, all of it in Spark.

Alternating large-star and small-star rounds.  A node's neighbours are dealt over
``SALTS`` sub-keys, so the hub of a component that holds a third of all nodes is never
one task's work.  Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import discard, materialize

SALTS = 32


def _star(pairs: DataFrame) -> DataFrame:
    """``(u, v, m)``: each pair with the least of u and all its partners."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = (
        salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
        .withColumn("m", F.least("u", F.min("m").over(W.partitionBy("u"))))
    )
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go in ``_small``


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    starred = _star(down)
    moved = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        starred.select("u", F.col("m").alias("v"))
    )
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct ``edges``, each from ``u`` to a lesser ``v``, are stars: each u has one v,
    which has none.  Then every v is the root of its component, and no round changes it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    marks = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return marks.where("down > 1 or (down = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the least node it can reach.

    Loops and repeated edges do not matter; edges with a null end are no edges; an empty
    table gives no rows.
    """
    ends = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull())
    first = materialize(ends.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    loops = first.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    now, before = first.where("u <> v"), None
    while not _settled(now):
        now = materialize(_small(_large(now)), "stars")
        if before is not None:
            discard(before)
        before = now
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("root").alias("root"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots``, as ``components`` gives them, after ``links`` (``u``, ``v``) are added: only the
    components that a link joins are searched, each as one node."""
    top = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(top("u"), "u", "left").join(top("v"), "v", "left")
    tops = ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).where("u <> v")
    joined = materialize(components(tops), "joined")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    fresh = joined.join(roots, "node", "left_anti")
    return moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(fresh)
