"""Byte strings that occur more than once, by distributed doubling of ranked prefixes.

Every window of ``least`` bytes that occurs twice has to be found without keeping a row for every
byte. Positions are therefore thinned out first, without losing a repeat: each window has an *anchor*,
the position in it whose ``START`` bytes have the smallest hash, so equal windows have equal anchors
at equal distances. Anchors (about one in 85 bytes) get the hash of those bytes as their first rank.
Then the ranked strings around an anchor grow, and Spark ranks the positions anew each time:

- an anchor whose rank is unique is dropped: no window around it can repeat;
- an anchor whose whole surroundings repeat (all windows that hold it) is settled;
- for the others the windows are split into ranges, and those again. What all windows of a range have
  in common grows (32, 153, 193, then all 200 bytes); ranges with a unique rank drop out, ranges
  that repeat as a whole are settled, and the rest is split down to single windows.

One anchor stands for all that have equal surroundings, so large groups of copies cost one row beyond
the first ranking. Ranks are 64-bit hashes, compared only among anchors with an equal first rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import among, table
from pitchlens.staging import discard, stage

#: Bytes of the first rank, and windows in the ranges of each later one (each divides the one before).
START, RANGES = 32, (48, 8, 1)
#: Windows that a task hashes at once; a bound on its memory only.
WINDOWS_AT_ONCE = 1 << 17
BASE = 0x9E3779B97F4A7C15
U = np.uint64


class Hasher:
    """Hashes of any substrings of a byte array: polynomials modulo 2^64 over random byte values."""

    table = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)
    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hasher.powers) < n:
            factors = np.full(n + n // 2, U(BASE))
            factors[0] = U(1)
            Hasher.powers = np.multiply.accumulate(factors)
            factors[1:] = U(pow(BASE, -1, 1 << 64))
            Hasher.inverses = np.multiply.accumulate(factors)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(Hasher.table[data] * Hasher.powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * Hasher.inverses[start]
        value ^= value >> U(33)
        value *= U(0xFF51AFD7ED558CCD)
        value ^= value >> U(33)
        return value


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and where each value starts (and the last ends)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _entries(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many entries each list of structs has, and the fields of all entries, an array each."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    return sizes, {f.name: pc.struct_field(flat, f.name) for f in flat.type}


def _anchors(data: np.ndarray, ends: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Anchors of all windows inside one value each: value, position, window range and two ranks.

    ``near`` and ``far``: the smallest and largest distance of a window's start before the anchor.
    """
    span = least - START + 1
    out: list[tuple[np.ndarray, ...]] = []
    total = len(data)
    for first in range(0, max(0, total - least + 1), WINDOWS_AT_ONCE):
        last = min(first + WINDOWS_AT_ONCE, total - least + 1)  # window starts first..last-1
        low, high = max(0, first - span), min(total, last + 2 * least)
        hashed = Hasher(data[low:high])
        at = np.arange(first, last + span - 1)
        rank = hashed.of(at - low, at - low + START)
        # The hash decides, ties go to the left: the position fills the low bits.
        order = (rank >> U(20) << U(20)) | (at - first).astype(np.uint64)
        width = 1
        while width * 2 <= span:
            order = np.minimum(order[:-width], order[width:])
            width *= 2
        rest = span - width
        best = np.minimum(order[: len(order) - rest], order[rest:]) if rest else order
        start = np.arange(first, last)
        value = np.searchsorted(ends, start, "right") - 1
        inside = start + least <= ends[value + 1]
        anchor, index = np.unique(best[inside] & U((1 << 20) - 1), return_index=True)
        if not len(anchor):
            continue
        anchor = anchor.astype(np.int64)
        own = value[inside][index]
        place = anchor + first
        near = np.maximum(0, place - (ends[own + 1] - least))
        far = np.minimum(span - 1, place - ends[own])
        around = hashed.of(place - far - low, place - near + least - low)
        around ^= (near * 1_000 + far).astype(np.uint64) * U(BASE)
        out.append((own, place - ends[own], near, far, rank[anchor], around))
    names = ("value", "pos", "near", "far", "rank", "around")
    if not out:
        return {n: np.zeros(0, np.int64) for n in names}
    return {n: np.concatenate([x[i] for x in out]) for i, n in enumerate(names)}


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _anchors(*_flat(batch.column(2)), least)
            yield _rows(batch, found)

    return run


def _rows(batch: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Each anchor once, also where two chunks of windows have found it."""
    value, pos = found["value"], found["pos"]
    keep = np.concatenate([np.ones(min(1, len(pos)), bool), (value[1:] != value[:-1]) | (pos[1:] != pos[:-1])])
    found = {k: v[keep] for k, v in found.items()}
    own = pa.array(found["value"])
    columns = [batch.column(0).take(own), batch.column(1).take(own)]
    columns += [pa.array(found[k].astype(np.int32)) for k in ("pos", "near", "far")]
    columns += [pa.array(found[k].view(np.int64)) for k in ("rank", "around")]
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "pos", "near", "far", "rank", "around"])


def _surroundings(least: int):
    """Cut the bytes around the listed anchors out of their texts."""
    kinds = pa.schema(
        [("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("near", pa.int32()),
         ("far", pa.int32()), ("rank", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _flat(batch.column(0))
            data = data.tobytes()
            n, spots = _entries(batch.column(3))
            own = np.repeat(np.arange(len(n)), n)
            pos, near, far = (spots[c].to_numpy().astype(np.int64) for c in ("pos", "near", "far"))
            start, stop = ends[own] + pos - far, ends[own] + pos - near + least
            for i in range(0, len(own), 10_000):
                some = slice(i, i + 10_000)
                cut = [data[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist())]
                columns = [batch.column(c).take(pa.array(own[some])) for c in (1, 2)]
                columns += [spots[f.name][some] for f in list(kinds)[2:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], schema=kinds)

    return run


def _ranges(least: int, width: int):
    """Ranges of ``width`` windows around an anchor: the rank of what a range's windows share, and of
    all that they hold (null where the text has only a part of them).

    ``low`` and ``high`` (distances of window starts before the anchor) say what is to be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            data, ends = _flat(column["bytes"])
            near, far, low, high = (
                column[c].to_numpy().astype(np.int64) for c in ("near", "far", "low", "high")
            )
            low, high = np.maximum(low, near), np.minimum(high, far)
            first, last = low // width, high // width
            n = np.maximum(last - first + 1, 0)
            own = np.repeat(np.arange(len(near)), n)
            part = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            low, high = part * width, part * width + width - 1
            spot = ends[:-1][own] + far[own]  # where the anchor is in ``data``
            hashed = Hasher(data)
            core = hashed.of(spot - low, spot - high + least)
            full = (low >= near[own]) & (high <= far[own])
            a, b = np.where(full, spot - high, 0), np.where(full, spot - low + least, 0)
            whole = pa.array(hashed.of(a, b).view(np.int64), mask=~full)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [*(column[c].take(take) for c in ("id", "rank", "single")),
                 pa.array(part.astype(np.int32)), pa.array(core.view(np.int64)), whole],
                ["id", "rank", "single", "part", "core", "whole"],
            )

    return run


def _runs(ends: np.ndarray, n: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal runs that spans cover, never beyond a text: the text of each, its start and its end.

    Text i is at ``ends[i]`` to ``ends[i + 1]`` and has ``n[i]`` of the spans, whose places count from its start.
    """
    own = np.repeat(np.arange(len(n)), n)
    start, stop = ends[own] + start, ends[own] + stop
    order = np.argsort(start, kind="stable")  # texts lie one after the other, so this keeps them apart
    own, start, stop = own[order], start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(own) + 1, bool)
    new[1:-1] = (own[1:] != own[:-1]) | (start[1:] > stop[:-1])
    return own[new[:-1]], start[new[:-1]], stop[new[1:]]


def _cut(with_text: bool):
    """Remove the covered bytes of each text; what is left is returned only ``with_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _flat(batch.column(1))
            n, spans = _entries(batch.column(2))
            own, first, last = _runs(ends, n, *(spans[c].to_numpy().astype(np.int64) for c in ("start", "stop")))
            keep = np.ones(len(data), bool)
            for a, b in zip(first.tolist(), last.tolist()):
                keep[a:b] = False
            kept = data[keep].tobytes()
            removed = np.zeros(len(n), np.int64)
            np.add.at(removed, own, last - first)
            sizes = np.diff(ends)
            edges = np.append(0, np.cumsum(sizes - removed)).tolist()
            left = [kept[a:b] for a, b in zip(edges, edges[1:])]
            columns = [
                batch.column(0), pa.array(sizes), pa.array(removed), pa.array(np.bincount(own, minlength=len(n))),
                pa.array([hashlib.sha256(k).hexdigest() for k in left], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(left, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


SPLIT = "id long, rank long, single boolean, part int, core long, whole long"


def _settle(todo: DataFrame, least: int, width: int) -> tuple[DataFrame, DataFrame]:
    """One round of ranking: windows that repeat (``id``, ``low``, ``high``), and ranges to be split.

    ``todo`` has the bytes around each anchor and the range to be looked at. Both results are stored.
    """
    ranges = todo.mapInArrow(_ranges(least, width), SPLIT)
    cores = ranges.groupBy("rank", "part", "core").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.count("whole") == F.count(F.lit(1))) & (F.min("whole") == F.max("whole"))).alias("alike"),
    )
    cores = cores.filter("n > 1").select(
        "rank", "part", "core", F.coalesce("alike", F.lit(False)).alias("alike")
    )
    cores = stage(cores, "repeat-cores")
    alive = stage(ranges.join(cores, ["rank", "part", "core"]), "repeat-alive")
    discard(cores)
    mixed = alive.filter("not alike")
    wholes = mixed.filter("whole is not null").groupBy("rank", "part", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.first("id").alias("id"), F.first("single").alias("single")
    )  # of one row; numbers, so that they are kept in the hash table
    wholes = stage(wholes, "repeat-wholes")
    copied = mixed.filter("single").join(
        wholes.filter("n > 1").select("rank", "part", "whole"), ["rank", "part", "whole"]
    )
    low, high = F.col("part") * width, F.col("part") * width + width - 1
    range_ = ("id", low.alias("low"), high.alias("high"))
    settled = alive.filter("alike and single").select(*range_).unionByName(copied.select(*range_))
    settled = stage(settled, "repeat-settled")
    # One anchor stands for those whose ranges are equal; as their range is settled, it is no longer
    # single, but the others still have to meet it.
    left = wholes.select(
        "part", "id", (F.col("single") & (F.col("n") == 1)).alias("single")
    ).unionByName(mixed.filter("whole is null").select("part", "id", "single"))
    left = stage(left.select("id", "single", low.alias("low"), high.alias("high")), "repeat-left")
    discard(alive, wholes)
    return settled, left


def repeated_spans(texts: DataFrame, least: int = 200) -> DataFrame:
    """Byte spans of windows that occur twice: ``k1``, ``k2`` and ``spans`` (array of start, stop).

    ``texts``: ``k1``, ``k2`` (hash and length of the text) and ``data`` (its bytes). A key may have
    several rows, which are copies and hence repeats of one another. Spans may overlap. Tables are
    deleted as soon as no later step reads them.
    """
    anchors = stage(
        texts.filter(F.col("k2") >= least).select("k1", "k2", "data").mapInArrow(
            _find(least), "k1 long, k2 long, pos int, near int, far int, rank long, around long"
        ),
        "repeat-anchors",
    )
    ranks = anchors.groupBy("rank").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("a"), F.max("around").alias("b")
    )
    ranks = ranks.filter("n > 1").select("rank", (F.col("a") == F.col("b")).alias("alike"))
    ranks = stage(ranks, "repeat-ranks")
    likely = among(anchors, F.col("rank"), ranks.select("rank")).filter("_maybe").drop("_maybe")
    shared = stage(likely.join(ranks, "rank"), "repeat-shared")
    discard(anchors, ranks)

    mixed = shared.filter("not alike").drop("alike")
    place = ("k1", "k2", "pos", "near", "far")
    classes = mixed.groupBy("rank", "around").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in place)
    )  # any one of the class, all of it from one row
    classes = stage(classes, "repeat-classes")
    copied = mixed.join(classes.filter("n > 1").select("rank", "around"), ["rank", "around"])
    start, stop = (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("near") + least).alias("stop")
    settled = shared.filter("alike").select("k1", "k2", start, stop)
    settled = settled.unionByName(copied.select("k1", "k2", start, stop))

    # One anchor of each class, with the bytes around it.
    spots = classes.select("rank", *place, (F.col("n") == 1).alias("single")).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("pos", "near", "far", "rank", "single")).alias("spots")
    )
    spots = stage(spots, "repeat-spots")
    likely = among(texts, F.col("k1"), spots.select("k1")).filter("_maybe").drop("_maybe")
    once = likely.groupBy("k1", "k2").agg(F.first("data").alias("data"))
    around = once.join(spots, ["k1", "k2"]).select("data", "k1", "k2", "spots").mapInArrow(
        _surroundings(least),
        "k1 long, k2 long, pos int, near int, far int, rank long, single boolean, bytes binary",
    )
    around = stage(around.withColumn("id", F.monotonically_increasing_id()), "repeat-surroundings")
    discard(spots)

    todo = around.withColumn("low", F.col("near")).withColumn("high", F.col("far"))
    found, left = [], None
    for width in RANGES:
        more, next_left = _settle(todo, least, width)
        found.append(more)
        if left is not None:
            discard(left)
        left = next_left
        todo = around.drop("single").join(left, "id")
    places = around.select("id", "k1", "k2", "pos")
    windows = reduce(DataFrame.unionByName, found).join(places, "id").select(
        "k1", "k2",
        (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + least).alias("stop"),
    )
    spans = settled.unionByName(windows).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )
    spans = stage(spans, "repeat-spans")
    discard(shared, classes, around, left, *found)
    return spans


def without_repeats(
    docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Remove every byte that is covered by a ``least``-byte string which also starts elsewhere.

    Texts are UTF-8 bytes; strings do not cross documents, and are judged on the input, overlaps
    and repeats inside a document included. Returns a row per row of ``docs``: ``doc_id``,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, and ``with_text`` ``kept``. Null and
    empty texts have no bytes; texts shorter than ``least`` lose nothing; copies of a text of that
    length lose everything; rows without an id are kept apart by their text; an empty table gives no
    rows. Further columns are not read.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"))
    rows = rows.withColumn("k1", F.xxhash64("data")).withColumn("k2", F.octet_length("data").cast("long"))
    spans = repeated_spans(rows.drop("doc_id"), least)
    marked = among(rows, F.col("k1"), spans.select("k1"))
    cut = marked.filter("_maybe").join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = cut.mapInArrow(_cut(with_text), f"{columns}, kept binary" if with_text else columns)
    nothing = F.lit(0).cast("long")
    whole = marked.filter("not _maybe").select(
        "doc_id", F.col("k2").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.sha2("data", 256).alias("kept_sha256"), *([F.col("data").alias("kept")] if with_text else []),
    )
    return cut.unionByName(whole)


def repeats_query(spark, folder: str) -> DataFrame:
    """op10: the contract's columns."""
    return without_repeats(table(spark, folder, "documents"), with_text=False)
