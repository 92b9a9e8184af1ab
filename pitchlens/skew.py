"""Keeping very frequent keys out of single tasks.

A key counts as *hot* when it holds more than ``FLOOR_ROWS`` rows, whatever the size of the data.
The hot keys are found once per data set by counting (key columns only, combined before the shuffle),
are stored as a table, and decide the shape of the plan: without hot keys every operator is a plain
join or window; with them, their rows are split over many tasks. Rows are counted by a hash of the key
first, so keys travel only where a hash value has more rows than one key may have. There is at most one
hot key per ``FLOOR_ROWS`` rows; their number and some hash values are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.staging import stage

FLOOR_ROWS = 1_000_000
#: Up to so many hot keys are broadcast to the joins that split them; Spark decides beyond.
BROADCAST_KEYS = 100_000
#: Hash values by which rows are counted before their keys are.
HASH_VALUES = 1 << 14


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a frame: key columns and ``parts``, the pieces each is to be split into.

    ``rows`` is None when there are none, and a stored table of ``number`` rows otherwise.
    """

    keys: tuple[str, ...]
    rows: DataFrame | None = None
    number: int = 0

    def listed(self, *columns: str) -> DataFrame:
        """The rows for a join, broadcast only if there are few."""
        rows = self.rows.select(*columns)
        return F.broadcast(rows) if self.number <= BROADCAST_KEYS else rows

    def renamed(self, *keys: str) -> HotKeys:
        """The same keys under other column names."""
        if self.rows is None:
            return HotKeys(keys)
        return HotKeys(keys, self.rows.withColumnsRenamed(dict(zip(self.keys, keys))), self.number)


def find_hot(df: DataFrame, keys: Sequence[str], floor_rows: int | None = None) -> HotKeys:
    """Count the rows per key and return the keys with more than ``floor_rows`` of them."""
    keys = list(keys)
    floor_rows = FLOOR_ROWS if floor_rows is None else floor_rows
    known = df.dropna(subset=keys)
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HASH_VALUES)).cast("int")
    sizes = known.groupBy(hashed.alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    large = [r[0] for r in sizes.filter(F.col("_n") > floor_rows).select("_hash").collect()]
    if not large:
        return HotKeys(tuple(keys))
    counts = known.filter(hashed.isin(large)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > floor_rows)
    hot = stage(
        hot.select(*keys, F.ceil(F.col("_n") / F.lit(float(floor_rows))).cast("int").alias("parts")),
        "hot-keys",
    )
    number = hot.count()
    return HotKeys(tuple(keys), hot, number) if number else HotKeys(tuple(keys))


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot: HotKeys | None = None,
    spread_by: Sequence[str] = (),
    floor_rows: int | None = None,
) -> DataFrame:
    """Join ``left``, which may have hot keys, to ``right``, which has few rows per key.

    Rows of a hot key are dealt out over its parts by a hash of ``spread_by``, and the matching
    rows of ``right`` are repeated once per part; all other rows join as usual. The part is a
    hash of row values, so a task that runs again deals the same way. ``hot`` may come from
    another frame that bounds the row counts of ``left``, and may name fewer keys than the join.
    Supports inner and left joins.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"split_join supports inner and left joins, not {how!r}")
    keys = list(keys)
    if hot is None:
        hot = find_hot(left, keys, floor_rows)
    if hot.rows is None:
        return left.join(right, keys, how)
    spread = list(spread_by) or [c for c in left.columns if c not in keys]
    listed = list(hot.keys)
    parts = hot.listed(*listed, "parts")
    own_part = F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int")
    ).otherwise(0)
    all_parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    dealt = left.join(parts, listed, "left").withColumn("_part", own_part).drop("parts")
    repeated = right.join(parts, listed, "left").withColumn("_part", F.explode(all_parts))
    return dealt.join(repeated.drop("parts"), [*keys, "_part"], how).drop("_part")


def dealt_by(df: DataFrame, key: str, hot: HotKeys, parts: int | None = None) -> DataFrame:
    """``df`` dealt out by ``key`` once, so that windows and aggregates on it and more columns need no exchange.

    With hot keys it stays as it is, and the operators split them. ``parts`` fixes the number of partitions.
    """
    if hot.rows is not None:
        return df
    return df.repartition(key) if parts is None else df.repartition(parts, key)


def by_key_size(
    df: DataFrame,
    keys: Sequence[str],
    usual: Callable[[DataFrame], DataFrame],
    heavy: Callable[[DataFrame], DataFrame],
    hot: HotKeys | None = None,
    floor_rows: int | None = None,
) -> DataFrame:
    """Apply ``usual`` to the keys that fit one task and ``heavy`` to the hot ones.

    Both must give the same result for the same rows; ``heavy`` must not need all rows of a key
    in one task. Keys that are NULL go the usual way.
    """
    keys = list(keys)
    if hot is None:
        hot = find_hot(df, keys, floor_rows)
    if hot.rows is None:
        return usual(df)
    listed = hot.listed(*keys)
    return usual(df.join(listed, keys, "left_anti")).unionByName(
        heavy(df.join(listed, keys, "left_semi"))
    )
