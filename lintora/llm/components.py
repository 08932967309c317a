"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import discard, written

#: Neighbours from which a node is a hub, whose edges stay where they are while
#: its minimum is broadcast. There are at most 2 * edges / HUB hubs; more than
#: MAX_HUBS (16 bytes each) are joined by shuffle, their edges dealt to SALTS.
HUB, MAX_HUBS, SALTS = 256, 1_000_000, 64


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def spread_join(rows: DataFrame, values: DataFrame, key: str, other: str) -> DataFrame:
    """rows with the columns of `values` (key, n, and more), an inner join in which
    no key with many rows lies in one task. n: the key's number of rows. Those of
    keys with HUB or more stay where they are while the keys are broadcast, if
    there are few enough; of too many each is dealt to SALTS tasks by the column
    `other`. The rest is joined by shuffle."""
    hubs, few = values.filter(F.col("n") >= HUB).drop("n"), values.filter(F.col("n") < HUB).drop("n")
    n_hubs = hubs.count()
    if not n_hubs:
        return rows.join(few, key)
    if n_hubs <= MAX_HUBS:
        near = F.broadcast(hubs)
        return rows.join(near, key).unionByName(rows.join(near.select(key), key, "left_anti").join(few, key))
    salted = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "salt"]).drop("salt").unionByName(rows.join(few, key))


def _with_least(edges: DataFrame, around: DataFrame) -> DataFrame:
    """edges with m, the smallest neighbour that around(u, v) gives each u."""
    least = written(around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return spread_join(edges, least, "u", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    around = _both_ways(edges)
    met = _with_least(around.filter("v > u"), around)
    return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down, down)
    return met.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of
    its component. Edges may be repeated, loops and nulls are ignored. The
    number of rounds grows with the logarithm of the longest chain; each
    round's edges, no more than the first ones, are a written table."""
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        large = written(_large_star(edges), "large-star")
        discard(edges)
        before, edges = state, written(_small_star(large), "edges")
        discard(large)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
