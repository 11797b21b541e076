"""Connected components of edge tables, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that connect what the given edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def apart(key: str) -> Column:
    """The key of an aggregate, wrapped: a join on it exchanges both sides anew, so that the
    rows of a hot key on the other side can be split over tasks."""
    return F.element_at(F.array(key), 1)


def _star(edges: DataFrame, bound: DataFrame) -> DataFrame:
    """``edges`` (a, b) beside the smallest of a's neighbours in ``bound`` and a itself, as m."""
    least = bound.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(apart("a").alias("k"), "m")
    return edges.join(least, edges["a"] == least["k"]).drop("k")


def _distinct(edges: DataFrame) -> DataFrame:
    return written(edges.filter("a <> b").distinct(), "star-edges")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every first node has one edge and is nobody's root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("r"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("r")))
    return ends.groupBy("n").agg(F.sum("c").alias("c"), F.max("r").alias("r")).filter("c > 1 or (c = 1 and r = 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node of its component.

    Large star: the larger neighbours of a node hang on its smallest neighbour;
    small star: so do the smaller ones and the node itself. Both keep the
    components; the rounds end when all edges point at roots. Their number
    grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _distinct(_star(both, both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _star(large, large).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = _distinct(small)
        if _all_stars(edges):
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
