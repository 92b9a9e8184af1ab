"""Near-duplicate documents by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant: a value that
differs from either in at most half of it. Every distinct fingerprint therefore emits all its
variants, equal variants meet, and each meeting is a verified link. The variants leave in two
steps, so that not all 2,081 of them have to be shuffled: the flips among the leading bits of a
fingerprint decide the buckets it is sent to, the flips among the other bits are made inside the
bucket. The number of leading bits follows from the number of distinct fingerprints alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlens.llm.common import component_labels, free_name, raw_texts
from pitchlens.llm.graph import components
from pitchlens.staging import stage

#: Hashes whose bits are counted at once, and variants that meet at once: bounds on memory only.
HASHES_AT_ONCE = 1 << 14
VARIANTS_AT_ONCE = 1 << 22


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text over its word shingles, repeats included."""
    found = (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        starts, ends = starts[: -(words - 1) or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(whole[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[i : i + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4
) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for t in raw_texts(batch.column(1))]
            values = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _masks(low: int, high: int, flips: int) -> np.ndarray:
    """All values with at most ``flips`` of the bits ``low`` to ``high`` (exclusive) set."""
    return np.array(
        [
            sum(1 << i for i in chosen)
            for k in range(flips + 1)
            for chosen in combinations(range(low, high), k)
        ],
        np.uint64,
    )


def _send(lead: int, half: int):
    """Send a fingerprint to the bucket of each variant of its ``lead`` leading bits."""
    masks = _masks(64 - lead, 64, half)
    left = (half - np.bitwise_count(masks)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            buckets = (prints[:, None] ^ masks[None, :]) >> np.uint64(64 - lead)
            if lead == 0:
                buckets = np.zeros_like(buckets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(buckets.ravel().view(np.int64)),
                    pa.array(np.repeat(prints.view(np.int64), len(masks))),
                    pa.array(np.tile(left, len(prints))),
                ],
                ["bucket", "fp", "flips"],
            )

    return run


def _meet(lead: int, half: int, radius: int):
    """Make the variants of a bucket's fingerprints and link those that share one."""
    rest = np.uint64((1 << (64 - lead)) - 1)
    masks = [_masks(0, 64 - lead, k) for k in range(half + 1)]

    def run(group: pa.Table) -> pa.Table:
        prints, owner = np.unique(group["fp"].to_numpy().view(np.uint64), return_inverse=True)
        flips = group["flips"].to_numpy()
        total = sum(int((flips == k).sum()) * len(masks[k]) for k in range(half + 1))
        # Passes over one residue of the variants each; their number only bounds memory.
        passes = 1 << max(0, math.ceil(math.log2(max(total, 1) / VARIANTS_AT_ONCE)))
        found: list[np.ndarray] = []
        for turn in range(passes):
            values, owners = [], []
            for k in range(half + 1):
                own = owner[flips == k]
                step = max(1, VARIANTS_AT_ONCE // len(masks[k]))
                for i in range(0, len(own), step):
                    part = own[i : i + step]
                    v = ((prints[part] & rest)[:, None] ^ masks[k][None, :]).ravel()
                    o = np.repeat(part.astype(np.int32), len(masks[k]))
                    if passes > 1:
                        keep = (v & np.uint64(passes - 1)) == turn
                        v, o = v[keep], o[keep]
                    values.append(v)
                    owners.append(o)
            if not values:
                continue
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v)
            v, o = v[order], o[order].astype(np.int64)
            same = v[1:] == v[:-1]
            found.append(np.unique(o[:-1][same] * len(prints) + o[1:][same]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        a, b = pairs // len(prints), pairs % len(prints)
        near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= radius)
        label = component_labels(len(prints), a[near], b[near])
        own = label != np.arange(len(prints))
        signed = prints.view(np.int64)
        return pa.table({"a": signed[own], "b": signed[label[own]]})

    return run


def links(prints: DataFrame, distinct: int, radius: int = 4) -> DataFrame:
    """Links (``a``, ``b``) with the components of "differ in at most ``radius`` bits".

    ``prints`` has one long column without repeats. A bucket returns stars, not all its pairs:
    values that share a variant are within ``radius`` of one another, so a chain joins them all.
    """
    half = (radius + 1) // 2
    variants = sum(math.comb(64, k) for k in range(half + 1))
    lead = min(32, max(0, math.ceil(math.log2(max(1, distinct * variants) / (VARIANTS_AT_ONCE / 2)))))
    sent = prints.mapInArrow(_send(lead, half), "bucket long, fp long, flips int")
    return sent.groupBy("bucket").applyInArrow(_meet(lead, half, radius), "a long, b long")


def _classes(known: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``first_id`` (smallest id with it) and ``root`` (of its component) per fingerprint."""
    nodes = stage(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    # Stored, as workers of two Python steps in one task would both stay in the executor's memory.
    met = stage(links(nodes.select("fp"), nodes.count(), radius), "simhash-met")
    roots = components(met, "simhash")
    return nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that is reachable by links, the row's own included.
    A null or blank text has fingerprint zero and links like any other; a row without an id takes
    part and gets its component's smallest id, null if no row of it has an id; repeated rows give
    repeated results; an empty table gives none. Further columns of ``docs`` are not read.
    Equal fingerprints are one node, so copies cost nothing beyond the first aggregation.
    """
    known = stage(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    classed = _classes(known, radius)
    smallest = classed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classed = stage(classed.join(smallest, "root").select("fp", "component_id"), "simhash-classes")
    return known.join(classed, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4
) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``.

    The row with the smallest id stays (rows without an id come last). Of rows that repeat an id in
    a group one stays. An empty table gives no rows.
    """
    names = docs.columns
    at = names.index(text_col)
    own, other, first = (free_name(n, names) for n in ("_fp", "_kept_fp", "_kept_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for t in raw_texts(batch.column(at))]
            values = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*names, own])

    known = stage(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    order = F.struct(F.col("first_id").isNull(), "first_id", "fp")
    kept = _classes(known, radius).groupBy("root").agg(F.min(order).alias("k"))
    kept = stage(kept.select(F.col("k.fp").alias(other), F.col("k.first_id").alias(first)), "simhash-kept")
    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    same = (F.col(own) == F.col(other)) & F.col(id_col).eqNullSafe(F.col(first))
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, own]).drop(own)


def simhash_query(spark, folder: str) -> DataFrame:
    """op4: the contract's columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
