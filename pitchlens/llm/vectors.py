"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random direction; vectors near a
split go to both sides (spill). The spill is at least as wide as the distance of a pair at the threshold, and
a node that it would nearly cover is not split: a dense group stays whole, however large. Vectors are
compared only with those of their leaves, large leaves block by block, and every pair that is near
enough is verified by its cosine. Over many trees a near pair is missed only if each of them
separates it beyond the spill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import component_labels, table
from pitchlens.llm.graph import components
from pitchlens.staging import stage

#: The trees are fitted on so many vectors and numbers at most; every vector is indexed.
FIT_ROWS, FIT_NUMBERS = 20_000, 4_000_000
#: Vectors of a leaf that are compared in one task; larger leaves are compared block by block.
BLOCK_ROWS = 1024
#: Cosines that are held at once.
CELLS_AT_ONCE = 1 << 22
#: A node is not split in a direction in which one side would get more of it.
SIDE = 0.7


class Forest:
    """``trees`` trees of ``depth`` levels: a direction for each level, a median for each node.

    Vectors within ``spill`` (a share of the node) or ``margin`` (a distance) of the median go to both
    sides. The difference of a pair at distance x has the standard deviation x in a direction. A node
    that is not split passes whole to its left side.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, margin: float, seed: int):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1] if sample.size else 1
        self.depth = depth
        self.directions = rng.standard_normal((trees, depth, dims))
        self.middle = np.zeros((trees, (1 << depth) - 1 or 1))
        self.low, self.high = self.middle.copy(), self.middle.copy()
        for t in range(trees):
            members = [np.arange(len(sample))]
            for level in range(depth):
                shadow = sample @ self.directions[t, level] if len(sample) else np.zeros(0)
                below = []
                for i, rows in enumerate(members):
                    node = (1 << level) - 1 + i
                    own = shadow[rows]
                    if len(own):
                        low, mid, high = np.quantile(own, [0.5 - spill, 0.5, 0.5 + spill])
                        low, high = min(low, mid - margin), max(high, mid + margin)
                        if max((own <= high).mean(), (own > low).mean()) > SIDE:
                            low = mid = high = np.inf
                        self.middle[t, node], self.low[t, node], self.high[t, node] = mid, low, high
                        below += [rows[own <= high], rows[own > low]]
                    else:
                        below += [rows, rows]
                members = below

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``unit`` and leaves that they are in; leaf numbers differ between trees."""
        rows_out, leaves_out = [], []
        for t in range(len(self.directions)):
            rows, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            shadows = unit @ self.directions[t].T
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                own = shadows[rows, level]
                left, right = own <= self.high[t, at], own > self.low[t, at]
                left |= own <= self.middle[t, at]
                right |= own > self.middle[t, at]
                rows = np.concatenate([rows[left], rows[right]])
                node = np.concatenate([node[left] * 2, node[right] * 2 + 1])
            rows_out.append(rows)
            leaves_out.append(node + (t << self.depth))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dims)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _assign(forests: dict[int, Forest]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(3).to_numpy()
            for dims in np.unique(widths):
                part = batch.take(pa.array(np.flatnonzero(widths == dims)))
                rows, leaves = forests[int(dims)].leaves(_unit(part.column(1), int(dims)))
                order = np.lexsort([leaves, rows])
                rows, leaves = rows[order], leaves[order]
                counts = np.bincount(rows, minlength=part.num_rows)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(3),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves)),
                    ],
                    ["node", "dims", "leaves"],
                )

    return run


def _compare(least: float):
    """Verify the pairs of a block (or of two blocks) of a leaf.

    A pair that shares several leaves is counted in the first of them only. Returns the links that
    each vector gets here, copies counted, and a star for each component; no row per pair.
    """

    def run(group: pa.Table) -> pa.Table:
        dims, leaf = group["dims"][0].as_py(), group["leaf"][0].as_py()
        unit = _unit(group["vec"].combine_chunks(), dims)
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        block, x, y = group["block"].to_numpy(), group["x"][0].as_py(), group["y"][0].as_py()
        left = np.flatnonzero(block == x)
        right = left if x == y else np.flatnonzero(block == y)
        lists = [[f for f in all_of if f < leaf] for all_of in group["leaves"].to_pylist()]
        width = max(map(len, lists))
        earlier = np.full((len(lists), width), -1)
        for i, before in enumerate(lists):
            earlier[i, : len(before)] = before
        within = None
        n_links = np.zeros(len(node), np.int64)
        a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS_AT_ONCE // max(1, len(right)))
        for i in range(0, len(left), step):
            part = left[i : i + step]
            near = unit[part] @ unit[right].T >= least
            if left is right:
                near &= part[:, None] < right
            p, q = np.nonzero(near)
            p, q = part[p], right[q]
            a_all.append(p)
            b_all.append(q)
            if len(p) * 16 > near.size:  # many links: whole rows at once
                if within is None:
                    known, place = np.unique(earlier, return_inverse=True)
                    within = np.zeros((len(node), len(known)), np.float32)
                    within[np.repeat(np.arange(len(node)), width), place.ravel()] = 1
                    within = within[:, known >= 0]
                near &= within[part] @ within[right].T == 0
                weight = near.astype(np.float64)
                n_links[part] += (weight @ copies[right]).astype(np.int64)
                n_links[right] += (copies[part] @ weight).astype(np.int64)
                continue
            new = np.ones(len(p), bool)
            for k in range(width):
                own = earlier[p, k]
                new &= (own < 0) | ~(earlier[q] == own[:, None]).any(axis=1)
            p, q = p[new], q[new]
            n_links += np.bincount(p, copies[q], len(node)).astype(np.int64)
            n_links += np.bincount(q, copies[p], len(node)).astype(np.int64)
        label = component_labels(len(node), np.concatenate(a_all), np.concatenate(b_all))
        some = (n_links > 0) | (label != np.arange(len(node)))
        return pa.table({"node": node[some], "root": node[label[some]], "links": n_links[some]})

    return run


def near_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    trees: int = 8,
    leaf_rows: int = 256,
    spill: float = 0.07,
    seed: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Link vectors of equal label whose cosine is ``least`` or more.

    Returns a row per row of ``vectors``: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest vec_id reachable, its own included), ``kept``. A row without label,
    a vector that is null, empty, zero or has null or non-finite components, and vectors of different
    length link with nothing; such a row is its own component. Equal vectors are one node with a
    number of copies, all linked with one another. A row without id takes part; if no row of its
    component has an id, its component and ``kept`` are null. Repeated rows count as other rows.
    An empty table gives no rows. Further columns are not read.

    The trees are fitted on ``FIT_ROWS`` vectors (those with the smallest hashes); all are indexed.
    Leaves of more than 2 x ``BLOCK_ROWS`` vectors are compared block by block in tasks of their own,
    but blocks of vectors that share an earlier large leaf are not compared again.
    """
    spark = vectors.sparkSession
    usable = (
        F.col("label").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        & F.exists("vec", lambda x: x != 0)
    )
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec")
    )
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64("label", "vec")).withColumn("k2", F.hash("vec", "label"))
    known = stage(rows.select("vec_id", "ok", "k1", "k2"), "vector-rows")
    nodes = rows.filter("ok").groupBy("k1", "k2").agg(
        F.first("label").alias("label"),
        F.first("vec").alias("vec"),
        F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("first_id"),
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    nodes = nodes.withColumn("dims", F.size("vec"))

    sizes = nodes.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count").alias("n"))
    margin = math.sqrt(max(0.0, 2 - 2 * least)) / 2
    forests = {}
    for dims, largest in sorted(sizes.toLocalIterator()):
        some = max(1, min(FIT_ROWS, FIT_NUMBERS // dims))
        picked = nodes.filter(F.col("dims") == dims).select("k1", "vec").orderBy("k1").limit(some)
        sample = picked.toArrow()["vec"].combine_chunks()
        unit = _unit(sample, dims)
        wanted = math.ceil(math.log2(max(1, largest / leaf_rows)))
        depth = min(max(0, wanted), max(0, int(math.log2(max(1, len(unit) / 16)))))
        forests[dims] = Forest(unit, trees, depth, spill, margin, seed)

    placed = nodes.select("node", "vec", "label", "dims")
    homes = placed.mapInArrow(_assign(forests), "node long, dims int, leaves array<long>")
    homes = stage(homes, "vector-leaves")
    full = nodes.select("node", "vec", "label", "copies").join(homes, "node")
    places = nodes.select("node", "label").join(homes, "node").withColumn("leaf", F.explode("leaves"))
    places = places.drop("leaves")
    leaf = ["label", "dims", "leaf"]
    large = places.groupBy(*leaf).count().filter(F.col("count") > 2 * BLOCK_ROWS).drop("count")
    inside = places.join(stage(large, "vector-large-leaves"), leaf)
    firsts = stage(inside.groupBy("node").agg(F.min("leaf").alias("first")), "vector-first-leaves")
    # Blocks of a large leaf: of the vectors with the same earlier large leaf, if many, and of all others.
    kinds = inside.join(firsts, "node").groupBy(*leaf, "first").count()
    many = (F.col("first") < F.col("leaf")) & (F.col("count") > 2 * BLOCK_ROWS)
    kinds = kinds.withColumn("kind", F.when(many, F.col("first")).otherwise(F.lit(-1).cast("long")))
    kinds = kinds.groupBy(*leaf, "kind").agg(F.ceil(F.sum("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    kinds = kinds.groupBy(*leaf).agg(F.array_sort(F.collect_list(F.struct("kind", "blocks"))).alias("kinds"))
    kinds = stage(kinds, "vector-blocks")

    def until(n: Column) -> Column:
        return F.aggregate(F.slice("kinds", F.lit(1), n), F.lit(0), lambda total, k: total + k["blocks"])

    single = full.join(firsts, "node", "left").withColumn("leaf", F.explode("leaves")).join(kinds, leaf, "left")
    names = F.col("kinds")["kind"]
    own = F.array_position(names, F.coalesce("first", F.lit(-1).cast("long"))).cast("int")
    single = single.withColumn("own", F.when(own > 0, own).otherwise(1))  # -1 comes first
    open_ = F.element_at("kinds", F.col("own"))["kind"] < 0
    single = single.withColumns({
        "start": F.coalesce(until(F.col("own") - 1), F.lit(0)),
        "stop": F.coalesce(until(F.col("own")), F.lit(1)),
        "every": F.coalesce(until(F.size("kinds")), F.lit(1)),
        "open": F.coalesce(open_, F.lit(True)),
    })
    hashed = F.pmod(F.xxhash64("node"), F.col("stop") - F.col("start"))
    single = single.withColumn("block", (F.col("start") + hashed).cast("int"))
    met = F.filter(
        F.sequence(F.lit(0), F.col("every") - 1),
        lambda b: F.col("open") | (b < F.col("start")) | (b >= F.col("stop")),
    )
    pairs = single.withColumn("other", F.explode(met)).withColumn("x", F.least("block", "other"))
    pairs = pairs.withColumn("y", F.greatest("block", "other"))
    pairs = pairs.select("node", "vec", "label", "copies", "dims", "leaves", "leaf", "block", "x", "y")
    found = pairs.groupBy("label", "dims", "leaf", "x", "y").applyInArrow(
        _compare(least), "node long, root long, links long"
    )
    found = stage(found, "vector-links")

    roots = components(found.select("node", "root"), "vectors")
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    classed = (
        nodes.select("node", "k1", "k2", "copies", "first_id")
        .join(roots, "node", "left")
        .join(degrees, "node", "left")
        .select("k1", "k2", "copies", "first_id", F.coalesce("root", "node").alias("root"), "links")
    )
    classed = stage(classed, "vector-classed")
    smallest = classed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classed = classed.join(smallest, "root").select(
        F.lit(True).alias("ok"),
        "k1",
        "k2",
        "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    classed = stage(classed, "vector-classes")
    out = known.join(classed, ["ok", "k1", "k2"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def vectors_query(spark, folder: str) -> DataFrame:
    """op2: all rows of ``embeddings``."""
    return near_vectors(table(spark, folder, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM comp LEFT JOIN deg USING (vec_id)
"""
