"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapline.llm.shared import Scratch


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the smallest node that it reaches.

    Each round ties every neighbour to the smallest one, first those above a node, then those below; the links end as
    stars round the smallest node. Minima are combined before the shuffle and written before they are joined, so a
    node with very many links is split like any skewed key. Null ends and links of a node to itself are left out.
    """
    stars = scratch.write(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    before, turn = None, 0
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, turn = now, turn + 1
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("least")), f"{name}_{turn}_least")
        large = scratch.write(
            both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct(), f"{name}_{turn}_large")
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("least")), f"{name}_{turn}_low")
        joined = large.join(low, "a")
        stars = scratch.write(
            joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(low.select("a", F.col("least").alias("b"))).distinct(), f"{name}_{turn}")
        scratch.drop(f"{name}_{turn - 1}", f"{name}_{turn}_least", f"{name}_{turn}_large", f"{name}_{turn}_low")
