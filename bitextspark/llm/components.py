"""Connected components of a link table by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextspark.scale import scratch_path


def _store(df: DataFrame, name: str) -> DataFrame:
    """A written table in the shared folder: cuts lineage, survives lost executors."""
    location = scratch_path(df.sparkSession, name)
    df.write.parquet(location)
    return df.sparkSession.read.parquet(location)


def connected(links: DataFrame) -> DataFrame:
    """`(id, component)` for every id in `links(a, b)`: the smallest id that is reachable.

    Union-find as data: in each round every node points to one neighbour (or itself), nodes
    are renamed to what they point to, and links inside a node vanish. Rounds take turns in
    how they choose: the smallest id, which folds links to common heads at once, and the smallest
    hash, which shrinks the links by a constant factor in expectation, whatever their shape.
    Hubs are pre-aggregated (minimum) before the shuffle, so a node with very many links is no
    task of its own. Only the pointers of each round are kept; they are followed from the
    last round back to the first. Nothing is collected; repeated links, self links and nulls are
    harmless.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    given = _store(links.where("a IS NOT NULL AND b IS NOT NULL"), "links")
    edges = given.where("a <> b")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        order = F.xxhash64(F.lit(len(pointers)), "to") if len(pointers) % 2 else F.col("to")
        ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("to")) for x in "ab" for y in "ab"))
        least = F.min_by("to", F.struct(order, F.col("to"))).alias("to")
        step = _store(edges.select(F.inline(ends)).groupBy("node").agg(least), "step")
        pointers.append(step)
        renamed = (
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct()
        )
        edges = _store(renamed, "links")
    names = given.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("name", F.col("id"))
    if pointers:
        last = pointers.pop()
        while pointers:
            later = last.select(F.col("node").alias("to"), F.col("to").alias("end"))
            last = pointers.pop().join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        names = names.join(last.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("to", "name").alias("name"))
    names = _store(names, "names")
    smallest = names.groupBy("name").agg(F.min("id").alias("component"))
    return names.join(smallest, "name").select("id", "component")


def extended(components: DataFrame, links: DataFrame) -> DataFrame:
    """`components(id, component)` with more `links(a, b)`: only the components that the
    links touch are connected anew, each as one node."""
    a, b = (components.select(F.col("id").alias(x), F.col("component").alias(f"{x}_in")) for x in "ab")
    placed = links.join(a, "a", "left").join(b, "b", "left")
    merged = _store(connected(placed.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))), "merged")
    fresh = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(components, "id", "left_anti")
    every = components.unionByName(fresh.withColumn("component", F.col("id")))
    ends = merged.select(F.col("id").alias("component"), F.col("component").alias("end"))
    return every.join(ends, "component", "left").select("id", F.coalesce("end", "component").alias("component"))
