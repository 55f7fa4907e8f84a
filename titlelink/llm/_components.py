"""Connected components of undirected links, by least labels and pointer jumping; nothing reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Rows id, component (the least id that links reach) for every id that has a link."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("heard"))
        new = labels.join(heard, labels["id"] == heard["a"]).select("id", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("root"), F.col("component").alias("jump"))
        new = new.join(up, new["component"] == up["root"]).select("id", F.least("component", "jump").alias("component"), "old")
        new = materialize(new, "labels")
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
