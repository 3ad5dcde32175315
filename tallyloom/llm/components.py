"""Connected components of a link table, as rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links (a, b)``.

    Each round points every node at its smallest neighbour, follows the pointers
    twice more, and contracts the links; a star vanishes in one round, a path of
    n nodes in about log n.  Groups are only ever reduced to a minimum, so no
    node's neighbours meet in one place.  Repeated links and loops do no harm."""
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = materialize(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not links.isEmpty():
        up = materialize(links.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("up")), "parents")
        for _ in range(2):
            above = up.select(F.col("child").alias("mid"), F.col("up").alias("top"))
            further = materialize(up.join(above, up["up"] == above["mid"], "left").select("child", F.coalesce("top", "up").alias("up")), "parents")
            discard(up)
            up = further
        moved = links.join(up.withColumnsRenamed({"child": "a", "up": "ua"}), "a", "left").join(up.withColumnsRenamed({"child": "b", "up": "ub"}), "b", "left")
        moved = moved.select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).where("a <> b")
        moved = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        named = materialize(labels.join(up, labels["component"] == up["child"], "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        discard(links, labels, up)
        links, labels = moved, named
    discard(links)
    return labels
