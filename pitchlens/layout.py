"""Tables stored by key, so that joins and windows on the key need no exchange.

A laid-out table is a bucketed table: rows of a key are in one file, files are numbered by the hash that
Spark's exchanges use, and the catalog knows it. The tables that are read by match are stored by
match, points by player. Writing costs one exchange; every later join, window or aggregate on the key, or on
more columns than the key, reads its files as they are.

A bucket is read by one task. So tables with hot keys (see ``pitchlens.skew``) are stored without a
layout, and operators split them as ever.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from pitchlens.functions.columns import DEFAULT_XS
from pitchlens.operators.neutral import neutral_points
from pitchlens.operators.pitch_time import entries
from pitchlens.operators.ranked import credited, ranked_points
from pitchlens.operators.rolling import last_x
from pitchlens.schema import Tables
from pitchlens.skew import HotKeys
from pitchlens.staging import new_path, stage

#: Tables whose rows belong to a match.
OF_MATCH = ("match", "player", "substitution", "card", "goal")
#: Those that are stored by match. The others are read for the times of the players alone, which are stored so.
BY_MATCH = ("match", "goal")
#: Rows that a bucket should hold, about.
BUCKET_ROWS = 2_000_000


def buckets_for(rows: int, least: int) -> int:
    """A power of two, so that tables of different size still meet without an exchange."""
    return 1 << (max(least, -(-rows // BUCKET_ROWS)) - 1).bit_length()


def write_by_key(
    df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, is_dealt: bool = False
) -> DataFrame:
    """Store ``df`` under ``path`` by ``keys`` as the table ``name`` of the session's catalog.

    Rows are dealt out by the keys first, so each bucket is one file; with ``is_dealt`` they are already.
    """
    dealt = df if is_dealt else df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_by_key(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table that another application has stored; its catalog need not be shared."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        listed = ", ".join(f"`{k}`" for k in keys)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({listed}) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


_staged: list[str] = []


def stage_by_key(
    df: DataFrame, label: str, keys: Sequence[str], buckets: int, is_dealt: bool = False
) -> DataFrame:
    """As ``stage``, stored by ``keys``; ``forget_staged`` takes the names out of the catalog again."""
    path, name = new_path(df.sparkSession, label), f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    _staged.append(name)
    return write_by_key(df, name, path, keys, buckets, is_dealt)


def forget_staged(spark: SparkSession) -> int:
    """Drop the catalog's entries of ``stage_by_key``; their files go with ``staging.discard_all``."""
    names = list(_staged)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _staged.remove(name)
    return len(names)


@dataclass
class LaidOut:
    """The tables of a data set, stored by match, and what is derived from them, stored by player.

    Each derived table is stored when it is first asked for; an exchange is paid once, then.
    """

    tables: Tables
    buckets: int
    _kept: dict[str, DataFrame] = field(default_factory=dict)

    def _stored(self, name: str, hot: HotKeys, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            if hot.rows is None:
                self._kept[name] = stage_by_key(make(), name, [key], self.buckets)
            else:
                self._kept[name] = stage(make(), name)
        return self._kept[name]

    @property
    def points(self) -> DataFrame:
        """Neutral points, by player."""
        return self._stored(
            "points", self.tables.hot_players, "playerid", lambda: neutral_points(self.tables)
        )

    def last_x(self, xs: Sequence[int] = DEFAULT_XS, **more) -> DataFrame:
        return last_x(self.points, xs, hot=self.tables.hot_players, **more)

    def ranked_points(self, x: int = 1) -> DataFrame:
        """Neutral and ranked points, by player. The form behind them meets the goals by match.

        The weights go to the players next, so they are stored as they come.
        """
        is_hot = self.tables.hot_matches.rows is not None

        def by_match(df: DataFrame, label: str) -> DataFrame:
            return stage(df, label) if is_hot or label != "form" else stage_by_key(df, label, ["matchid"], self.buckets)

        return self._stored(
            f"ranked-{x}",
            self.tables.hot_players,
            "playerid",
            lambda: ranked_points(self.tables, x, credited(self.tables, x, by_match)),
        )


def lay_out(tables: Tables, buckets: int | None = None) -> LaidOut:
    """Store the tables that are read by match in a layout by match; the others stay as they are.

    So are the times of the players, in one shuffle of line-up, substitutions and cards.

    The number of buckets follows the largest table, and is at least the number of shuffle partitions.
    """
    spark = tables.match.sparkSession
    if buckets is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = buckets_for(max(getattr(tables, name).count() for name in OF_MATCH), least)
    hot_matches, hot_players = tables.hot_matches, tables.hot_players
    if hot_matches.rows is None:
        stored = {name: stage_by_key(getattr(tables, name), f"by-match-{name}", ["matchid"], buckets) for name in BY_MATCH}
        laid = replace(tables, **stored)
        # The rows are the same, so the keys need not be counted again.
        laid.__dict__.update(hot_matches=hot_matches, hot_players=hot_players)
        times = entries(tables, by_match=True, parts=buckets)
        laid.stored_entries = stage_by_key(times, "by-match-entries", ["matchid"], buckets, is_dealt=True)
    else:
        laid = tables
    return LaidOut(laid, buckets)
