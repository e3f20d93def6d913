"""Connected components by alternating large-star and small-star steps.

Each round is two aggregations on narrow edge rows; labels never leave the executors. Rounds are staged to the shared
folder, so lineage stays short and a lost executor costs one round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabularium.plans.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` of every node with an edge to another; ``component`` is the least node of its component.

    Null ends and self loops are ignored. An edge table without edges gives no rows.
    """
    now = staged(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        nxt = staged(_small_star(_large_star(now)), "edges")
        changed = nxt.exceptAll(now).limit(1).count() or now.exceptAll(nxt).limit(1).count()
        now = nxt
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
