"""Connected components of an edge table: alternating large-star and small-star steps on DataFrames, until what is left is small enough for one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.shared import checkpointed


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]


#: Edges, as counted, that one task settles by itself: some tens of megabytes.
SMALL = 1 << 19


def _settle(table: pa.Table) -> pa.Table:
    """Edges of one task as (node, component): labels fall to the least of both ends of each edge, at the node and at its label, until none changes."""
    both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], table.schema.field("a").type)
    nodes = both.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(table.column(c), value_set=nodes).to_numpy() for c in ("a", "b"))
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pa.table({"node": nodes, "component": nodes.take(pa.array(label))})


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that is reachable.

    Each step keeps one edge table and needs the minimum neighbour of each node, which a partial aggregation computes: no neighbourhood is ever gathered,
    so a node with a third of all edges is as cheap as others, and AQE splits its join partition. Steps are O(log n); cut ends the lineage of each, in
    the folder that executors share. Once no more than small edges are left, as counted, one task settles them; small = 0 leaves all to the steps. Null ends and loops are
    dropped; an empty table has no components.
    """
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _digest(now)
    kind = now.schema["a"].dataType.simpleString()

    def settle(batches):
        table = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            yield from _settle(table).to_batches()

    while was[0]:
        if was[0] <= small:
            return cut(now.repartition(1).mapInArrow(settle, f"node {kind}, component {kind}"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of u, and u, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        pairs = large.join(low, F.col("a") == F.col("u"))
        star = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut(star.where("a <> b").distinct())
        is_now = _digest(now)
        if is_now == was:
            break
        was = is_now
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def alias_members(aliases: DataFrame) -> DataFrame:
    """(symbol, component): symbols that aliases (canonical, alias) make one, each with the first of them."""
    return connected_components(aliases.select(F.col("canonical").alias("a"), F.col("alias").alias("b"))).withColumnRenamed("node", "symbol")
