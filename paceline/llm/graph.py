"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of `edges` (u long, v long) the smallest node it reaches.

    Alternates the large-star and the small-star step until no edge changes; each round
    halves the height of the trees at least, and is written to the shared folder. The
    minima of the nodes' neighbours are written before they meet the edges: a join whose
    sides are both read from tables is one that the skew rule can split at a hub, which a
    join with an aggregate on its own key isn't. No edges give no rows.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            around = pairs
        least = stored(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "least")
        met = around.join(least, around["u"] == least["x"])
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    flat = stored(flat, "edges")
    mark = _mark(flat)
    while mark[0]:
        flat = stored(star(star(flat, large=True), large=False), "edges")
        now = _mark(flat)
        if now == mark:
            break
        mark = now
    nodes = flat.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that change when the set of edges does."""
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(mixed, F.lit(2**40))), F.bit_xor(mixed)).first())
