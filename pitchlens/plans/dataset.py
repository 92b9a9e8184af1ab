"""A data set with its stored tables, and the batch jobs that write them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.functions.columns import DEFAULT_XS, WIDE_ATTRIBUTES, WIDE_XS
from pitchlens.layout import LaidOut, lay_out
from pitchlens.model import features
from pitchlens.operators.neutral import neutral_points
from pitchlens.operators.pitch_time import ENTRY, player_time
from pitchlens.operators.ranked import credited, neutral_ranked_last_x
from pitchlens.operators.rolling import last_x
from pitchlens.operators.scores import score_latest, score_with_age, with_age
from pitchlens.schema import Tables
from pitchlens.skew import dealt_by
from pitchlens.sources.adapter import tables_from_orders
from pitchlens.sources.jdbc import write_jdbc
from pitchlens.sources.parquet import write_parquet
from pitchlens.staging import stage


class DataSet:
    """Input tables, and the derived tables that reports share.

    Each derived table is written to the shared folder when it is first asked for.
    """

    def __init__(self, tables: Tables, features_since: int = 2014):
        self.tables = tables
        self.features_since = features_since
        self._kept: dict[str, DataFrame] = {}
        self._held: dict[str, Any] = {}

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``make`` returns, made and stored once under ``name``."""
        if name not in self._kept:
            self._kept[name] = stage(make(), name)
        return self._kept[name]

    def held(self, name: str, make: Callable[[], Any]) -> Any:
        """A small object, such as a fitted model, made once."""
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def credited(self, x: int = 1) -> DataFrame:
        """Goal weights per player and match, for the form of the last ``x`` matches."""
        name = f"credited-{x}"
        if name not in self._kept:
            self._kept[name] = credited(self.tables, x)
        return self._kept[name]

    @cached_property
    def laid_out(self) -> LaidOut:
        """The tables stored by match, and points stored by player."""
        return lay_out(self.tables)

    @cached_property
    def played(self) -> DataFrame:
        """Player times with tournament and season."""
        return stage(player_time(self.tables, ("tournament", "saison")), "played")

    @cached_property
    def scores(self) -> DataFrame:
        """Neutral rolling columns over the career, with age."""
        return stage(score_with_age(self.tables), "scores")

    @cached_property
    def results(self) -> DataFrame:
        """Neutral and ranked rolling columns over the season, in a folder per season."""
        rows = neutral_ranked_last_x(self.tables, stored=self.credited())
        return stage(rows, "results", partition_by=("saison",))

    def results_of(self, seasons: Sequence[str]) -> DataFrame:
        """The rows of ``results`` in some seasons. Others are not computed, nor anything stored for it."""
        if "results" in self.__dict__:
            return self.results.filter(F.col("saison").isin(list(seasons)))
        return neutral_ranked_last_x(self.tables, stored=self.credited(), by_player=True, seasons=seasons)

    @property
    def times(self) -> DataFrame:
        """``played`` for a single reader: nothing is stored for it."""
        return self.played if "played" in self.__dict__ else player_time(self.tables, ("tournament", "saison"))

    def scores_by_player(self, xs: Sequence[int] = DEFAULT_XS) -> DataFrame:
        """``scores`` of some X without the age, for a single reader: narrow rows are dealt out by player."""
        hot = self.tables.hot_players
        return score_latest(last_x(dealt_by(neutral_points(self.tables), "playerid", hot), xs, hot=hot))

    def aged_scores(self, xs: Sequence[int]) -> DataFrame:
        """``scores`` of some X, for a single reader: nothing is stored for it."""
        if "scores" in self.__dict__:
            return self.scores
        return with_age(self.scores_by_player(xs), self.tables.profile, hot=self.tables.hot_players)

    @cached_property
    def points(self) -> DataFrame:
        """Neutral points; the minutes of a match are in them, too."""
        rows = neutral_points(self.tables)
        return stage(rows.select(*ENTRY, "matchday", "playtime", "off", "def"), "points")

    @property
    def lineups(self) -> DataFrame:
        """Starting players since the first year of the features, with their minutes."""
        tables = self.tables
        rows = features.lineups_since(tables.match, tables.player, self.features_since, tables.hot_matches)
        return features.with_minutes(rows, self.points)

    @property
    def strength(self) -> DataFrame:
        """Players' latest scores before each match, summed per match and team.

        Not stored: it is wide, and what it is made of (points) is not.
        """
        hot = self.tables.hot_players
        scores = score_latest(last_x(dealt_by(self.points, "playerid", hot), hot=hot))
        return features.strength_as_of(self.lineups, scores, self.tables.hot_matches, hot)

    @property
    def wide_strength(self) -> DataFrame:
        """The same for all attributes, neutral and ranked over the season, as vectors."""
        scores = neutral_ranked_last_x(self.tables, WIDE_XS, form_x=1, stored=self.credited(), by_player=True)
        hot_matches, hot_players = self.tables.hot_matches, self.tables.hot_players
        return features.vectors_as_of(self.lineups, scores, hot_matches, hot_players, WIDE_ATTRIBUTES)


def score_batch(tables: Tables, folder: str, xs: Sequence[int] = DEFAULT_XS) -> None:
    """Write ``playertime`` and ``scores`` as parquet tables under ``folder``."""
    write_parquet(player_time(tables), f"{folder}/playertime")
    write_parquet(score_with_age(tables, xs), f"{folder}/scores")


def score_batch_jdbc(
    tables: Tables, url: str, user: str, password: str, xs: Sequence[int] = DEFAULT_XS
) -> None:
    """As ``score_batch``, replacing the tables of a database."""
    write_jdbc(player_time(tables), "playertime", url, user, password)
    write_jdbc(score_with_age(tables, xs), "scores", url, user, password)


def result_batch(tables: Tables, folder: str, xs: Sequence[int] = (1,)) -> None:
    """Write the neutral and ranked columns as one parquet table."""
    write_parquet(neutral_ranked_last_x(tables, xs), f"{folder}/results")


_open: dict[tuple, DataSet] = {}


# First year of the goal model's matches in the derived data, which start in 1995.
ORDERS_FEATURES_SINCE = 1996


def _state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of the tables in ``folder``: other files, other data set."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(
        sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(place))
    )


def dataset_of(spark: SparkSession, folder: str) -> DataSet:
    """The data set derived from the order tables in ``folder``.

    There is one per application and state of the folder, so stored tables are not served after
    the files have changed.
    """
    key = (spark.sparkContext.applicationId, folder, _state_of(spark, folder))
    if key not in _open:
        _open[key] = DataSet(tables_from_orders(spark, folder), ORDERS_FEATURES_SINCE)
    return _open[key]
