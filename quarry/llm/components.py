"""Connected components of pairs of 128-bit nodes, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import removed, written

NODE = "struct<n0:bigint,n1:bigint>"


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component; nodes are 0 to n-1, pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs make a minimum spanning forest: each component takes its lightest way out, round by round."""
    order = np.lexsort((b, a, weight))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    label, chosen, live = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        x, y = label[a[live]], label[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            return chosen
        best = np.full(n, len(order))
        np.minimum.at(best, x, place[live])
        np.minimum.at(best, y, place[live])
        chosen[order[np.unique(best[best < len(order)])]] = True
        label = labels_of(n, a[chosen], b[chosen])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(k).to_numpy() for k in range(4)], axis=1) for b in batches if b.num_rows]
    if not parts:
        return
    pairs = np.concatenate(parts).reshape(-1, 2)
    nodes, place = np.unique(np.ascontiguousarray(pairs).view([("n0", np.int64), ("n1", np.int64)]).ravel(), return_inverse=True)
    place = place.reshape(-1, 2)
    label = labels_of(len(nodes), place[:, 0], place[:, 1])
    own = np.flatnonzero(label != np.arange(len(nodes)))
    arrays = [nodes["n0"][own], nodes["n1"][own], nodes["n0"][label[own]], nodes["n1"][label[own]]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a0", "a1", "b0", "b1"])


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for all nodes but the roots of the graph whose edges are ``pairs`` (a, b).

    Each partition first shrinks its own edges to stars. Then large-star and small-star
    steps alternate, each written to the shared folder, until every node has one edge, to a
    node that has none. Edges of a hot node are never gathered in one place.
    """
    flat = pairs.select("a.n0", "a.n1", "b.n0", "b.n1").toDF("a0", "a1", "b0", "b1")
    done = None
    while True:
        stars = flat.mapInArrow(_contract, "a0 bigint, a1 bigint, b0 bigint, b1 bigint")
        edges = written(stars.select(F.struct(F.col("a0").alias("n0"), F.col("a1").alias("n1")).alias("node"), F.struct(F.col("b0").alias("n0"), F.col("b1").alias("n1")).alias("root")), "stars")
        if done is not None:
            removed(done)
        done = edges
        loose = edges.groupBy("node").count().filter("count > 1").limit(1).unionAll(edges.join(edges.select(F.col("root").alias("node")), "node", "left_semi").select("node", F.lit(1).cast("bigint"))).limit(1)
        if loose.isEmpty():
            return edges
        both = edges.union(edges.select("root", "node")).toDF("u", "v")
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        small = large.distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))
        flat = small.select("v", "m").filter("v != m").union(small.select("u", "m")).distinct().select("v.n0", "v.n1", "m.n0", "m.n1").toDF("a0", "a1", "b0", "b1")
