"""Canonical tables, their schemas, and the column names of the raw CSV files."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlens.skew import HotKeys, find_hot


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "BOOLEAN": T.BooleanType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema from 'name TYPE, ...'; needs no session, unlike parsing DDL."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {
    "match": _struct(
        "matchid BIGINT, matchday DATE, saison STRING, tournament STRING, country STRING, "
        "matchtime STRING, matchlength INT, hometeam BIGINT, guestteam BIGINT, refereeid BIGINT"
    ),
    "player": _struct("playerid BIGINT, matchid BIGINT, teamid BIGINT"),
    "substitution": _struct(
        "matchid BIGINT, teamid BIGINT, playerin BIGINT, playerout BIGINT, time INT"
    ),
    "card": _struct("matchid BIGINT, teamid BIGINT, playerid BIGINT, color STRING, time INT"),
    "goal": _struct(
        "matchid BIGINT, teamid BIGINT, time INT, scorer BIGINT, assist BIGINT, own_goal BOOLEAN"
    ),
    "team": _struct("teamid BIGINT, teamname STRING"),
    "profile": _struct(
        "playerid BIGINT, playername STRING, birthdate DATE, nationality STRING, position STRING"
    ),
    "referee": _struct("refereeid BIGINT, refereename STRING"),
    "trainer": _struct("trainer BIGINT, team BIGINT, match BIGINT"),
    "trainer_name": _struct("trainer BIGINT, trainername STRING"),
}

# Folder of each table in a raw CSV dump, and raw column -> canonical column.
CSV_FOLDERS: dict[str, str] = {
    "match": "match",
    "player": "player",
    "substitution": "substitution",
    "card": "card",
    "goal": "goal",
    "team": "team",
    "profile": "player-profile",
    "referee": "referee",
    "trainer": "trainer",
    "trainer_name": "trainer-name",
}
CSV_COLUMNS: dict[str, dict[str, str]] = {
    "match": {
        ":id": "matchid",
        ":date": "matchday",
        ":saison": "saison",
        ":tournament": "tournament",
        ":country": "country",
        ":match-time": "matchtime",
        ":match-length": "matchlength",
        ":home": "hometeam",
        ":guest": "guestteam",
        ":referee": "refereeid",
    },
    "player": {":player": "playerid", ":match": "matchid", ":team": "teamid"},
    "substitution": {
        ":match": "matchid",
        ":team": "teamid",
        ":in": "playerin",
        ":out": "playerout",
        ":time": "time",
    },
    "card": {
        ":match": "matchid",
        ":team": "teamid",
        ":player": "playerid",
        ":color": "color",
        ":time": "time",
    },
    "goal": {
        ":match": "matchid",
        ":team": "teamid",
        ":time": "time",
        ":scorer": "scorer",
        ":assist": "assist",
        ":own-goal?": "own_goal",
    },
    "team": {":team": "teamid", ":teamname": "teamname"},
    "profile": {
        ":player-id": "playerid",
        ":name": "playername",
        ":birth-date": "birthdate",
        ":nationality": "nationality",
        ":position": "position",
    },
    "referee": {":referee": "refereeid", ":refereename": "refereename"},
    "trainer": {":trainer": "trainer", ":team": "team", ":match": "match"},
    "trainer_name": {":trainer": "trainer", ":trainername": "trainername"},
}


#: Tables that a dump or a database may lack.
OPTIONAL = ("referee", "trainer", "trainer_name")


@dataclass
class Tables:
    """The input tables of one data set, each a lazy DataFrame in the canonical schema."""

    match: DataFrame
    player: DataFrame
    substitution: DataFrame
    card: DataFrame
    goal: DataFrame
    team: DataFrame
    profile: DataFrame
    referee: DataFrame | None = None
    trainer: DataFrame | None = None
    trainer_name: DataFrame | None = None

    #: When players came on, went off and were sent off (``pitch_time.entries``), where that is stored.
    stored_entries: ClassVar[DataFrame | None] = None

    @cached_property
    def hot_matches(self) -> HotKeys:
        """Matches with too many line-up, substitution, card and goal rows for one task."""
        rows = self.player.select("matchid")
        for table in (self.substitution, self.card, self.goal):
            rows = rows.unionByName(table.select("matchid"))
        return find_hot(rows, ["matchid"])

    @cached_property
    def usual_minutes(self) -> bool:
        """Whether all substitutions are in minutes 0 to 127, so that sets of minutes fit two numbers."""
        return self.substitution.filter(~F.col("time").between(0, 127)).isEmpty()

    @cached_property
    def hot_players(self) -> HotKeys:
        """Players with too many line-up and substitution rows for one task."""
        starts = self.player.select("playerid")
        comes_on = self.substitution.select(F.col("playerin").alias("playerid"))
        return find_hot(starts.unionByName(comes_on), ["playerid"])

    @cached_property
    def hot_teams(self) -> HotKeys:
        """Teams with too many matches for one task."""
        home = self.match.select(F.col("hometeam").alias("teamid"))
        guest = self.match.select(F.col("guestteam").alias("teamid"))
        return find_hot(home.unionByName(guest), ["teamid"])

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
