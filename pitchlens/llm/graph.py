"""Connected components of a graph that is only known as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import component_labels
from pitchlens.staging import stage

#: Links that are contracted at once in a task; a bound on its memory only.
LINKS_AT_ONCE = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a partition by stars with the same components."""

    def stars(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        src = np.concatenate([p[0] for p in parts])
        dst = np.concatenate([p[1] for p in parts])
        nodes, index = np.unique(np.concatenate([src, dst]), return_inverse=True)
        label = component_labels(len(nodes), index[: len(src)], index[len(src) :])
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[own]), pa.array(nodes[label[own]])], ["u", "v"]
        )

    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count >= LINKS_AT_ONCE:
            yield stars(held)
            held, count = [], 0
    if held:
        yield stars(held)


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """The component of every node that has a link to another one.

    ``links`` has two long columns, without nulls. Returns ``node`` and ``root``, the smallest
    node it is connected with; nodes that are their own root are left out. Links are first
    contracted inside each partition. Then large stars and small stars alternate until nothing
    changes, about log(nodes) rounds. The smallest neighbour of every node is stored before it is
    joined, so both sides of the join are plain exchanges and Spark can split a node that has very
    many links. Each round is a table in the shared folder: lost executors cost one round at most.
    """
    a, b = links.columns
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = edges.mapInArrow(_contract, "u long, v long").distinct()
    edges = stage(edges, f"{label}-links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = stage(least, f"{label}-large")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), f"{label}-large-star")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-small")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, f"{label}-small-star")
        mark = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if seen == (mark.n, mark.x):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (mark.n, mark.x)
