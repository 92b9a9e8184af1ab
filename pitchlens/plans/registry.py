"""All queries by name, over the football tables derived from an orders data set."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlens.functions.columns import DEFAULT_XS, RANKED, WIDE_ATTRIBUTES, total_col
from pitchlens.functions.scalars import dedupe, minute_of_text, number_of_text, parse_day
from pitchlens.model import features as feat
from pitchlens.model import training
from pitchlens.operators import neutral, pitch_time, ranked, rolling, scores, segments
from pitchlens.plans.dataset import ORDERS_FEATURES_SINCE as FEATURES_SINCE
from pitchlens.plans import store
from pitchlens.plans.dataset import DataSet, dataset_of
from pitchlens.reports import careers, coplay, leagues, monthly, overview, trainers
from pitchlens.schema import CSV_FOLDERS, SCHEMAS
from pitchlens.sources import csv_files, jdbc, parquet
from pitchlens.staging import new_path, stage

Query = Callable[[SparkSession, str], DataFrame]

TOURNAMENT = "1-URGENT"
SEASONS = ["1995", "1996", "1997", "1998", "1999", "2000", "2001"]
SEASON = "1998"
PLAYED_SINCE = 1997
CAREER_NAMES = ["red plate", "small widget", "hot plate", "large rod", "blue gear"]
PLAYERS = {0: "Ada", 1: "Bea", 2: "Cleo", 3: "Dana", 8: "Edda", 9: "Fee", 14: "Gwen", 15: "Hede"}
TARGET_SEASONS = ["1997", "1998", "1999"]
MEMBER_TOURNAMENTS = ["1-URGENT", "2-HIGH"]
POINTS_SINCE, POINTS_UNTIL, TRAINER_SINCE = 1995, 2001, 1999
STORE_UPDATED = 2001
SLICES = 6
GRAPH_SINCE, GRAPH_COUNTRIES = datetime.date(1998, 1, 1), ["F", "P"]
BEST_METRICS = {
    "total_off": "total_ranked_off",
    "avg_off": "avg_ranked_off",
    "total_def": "total_ranked_def",
    "avg_def": "avg_ranked_def",
}


# Digits compared, where other than six: means of means have exact ties at the seventh digit.
DIGITS = {"team_minus_player": 9}
# Sums of many quotients have such ties, too, and their last bits depend on the order of adding up. A
# shift far above that error and far below the sixth digit makes all ties fall to the same side.
TIES = {"team_strength_wide": 3.1e-8, "match_features_wide": 3.1e-8}


def comparable(df: DataFrame, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """Doubles to some digits and whole numbers as bigint, so that engines can be compared."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column + F.lit(shift) if shift else column, digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


_QUERIES: dict[str, Callable[[DataSet, SparkSession, str], DataFrame]] = {}


def _query(name: str):
    def add(fn):
        _QUERIES[name] = fn
        return fn

    return add


def _simple(name: str, fn: Callable[[DataSet], DataFrame]) -> None:
    _QUERIES[name] = lambda data, spark, folder: fn(data)


# --- sources and scalar functions -------------------------------------------------------------


@_query("parse_match_dates")
def _parse_match_dates(data, spark, folder):
    text = F.when(F.col("matchid") % 97 == 0, "n/a").otherwise(
        F.date_format("matchday", "dd.MM.yyyy")
    )
    return data.tables.match.select("matchid", text.alias("date_text")).withColumn(
        "matchday", parse_day("date_text")
    )


@_query("cast_minutes")
def _cast_minutes(data, spark, folder):
    quantity = F.col("l_quantity").cast("int")
    text = F.when(quantity % 17 == 0, "45+2").otherwise((20 + quantity).cast("string"))
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", text.alias("minute_text")).withColumn(
        "minute", minute_of_text("minute_text")
    )


@_query("coerce_team_ids")
def _coerce_team_ids(data, spark, folder):
    text = F.when(F.col("hometeam") % 7 == 0, "n/a").otherwise(F.col("hometeam").cast("string"))
    ids = data.tables.match.select("matchid", number_of_text(text).alias("teamid"))
    return ids.filter(F.col("teamid").isNotNull())


@_query("dedupe_trainer")
def _dedupe_trainer(data, spark, folder):
    trainer = data.tables.trainer
    return dedupe(trainer.unionByName(trainer).select("trainer", "team"))


@_query("load_csv_roundtrip")
def _load_csv_roundtrip(data, spark, folder):
    path = new_path(spark, "csv")
    csv_files.write_csv_tables(data.tables, path)
    loaded = csv_files.read_csv_tables(spark, path)
    return loaded.substitution.join(loaded.match.select("matchid", "matchday"), "matchid")


@_query("load_csv_all_tables")
def _load_csv_all_tables(data, spark, folder):
    """Every row of every table after a round trip: its table, its values, and how often it occurs."""
    path = new_path(spark, "csv")
    csv_files.write_csv_tables(data.tables, path)
    loaded = csv_files.read_csv_tables(spark, path)
    rows = None
    for name, schema in SCHEMAS.items():
        table = getattr(loaded, name)
        values = [
            F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in table.columns else F.lit("-")
            for c in schema.names
        ]
        part = table.select(F.lit(name).alias("name"), F.concat_ws("|", *values).alias("line"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name", "line").agg(F.count(F.lit(1)).alias("n"))


@_query("load_csv_rejects")
def _load_csv_rejects(data, spark, folder):
    """Rejects per table and column of a dump in which some days, minutes and ids are not legible."""
    path, tables = new_path(spark, "csv"), data.tables
    csv_files.write_csv_tables(tables, path)
    spoiled = {
        "match": csv_files.as_text(tables.match, "match").withColumns({
            ":date": F.when(F.col(":id") % 97 == 0, "n/a").otherwise(F.col(":date")),
            ":referee": F.when(F.col(":id") % 89 == 0, "12.7").otherwise(F.col(":referee")),
        }),
        "substitution": csv_files.as_text(tables.substitution, "substitution").withColumn(
            ":time", F.when(F.col(":match") % 5 == 0, "45+2").otherwise(F.col(":time"))
        ),
    }
    for name, rows in spoiled.items():
        csv_files.write_csv(rows, f"{path}/{CSV_FOLDERS[name]}")
    rejects = new_path(spark, "rejects")
    csv_files.write_rejects(spark, path, rejects)
    return spark.read.parquet(rejects).groupBy("name", "column", "text").agg(F.count(F.lit(1)).alias("n"))


@_query("match_slices")
def _match_slices(data, spark, folder):
    """Rows per slice of the line-ups, sliced by match for parallel reads."""
    ids = data.tables.player.select("matchid")
    bounds = jdbc.slice_bounds(ids, "matchid", SLICES)
    number = F.lit(0)
    for i, condition in enumerate(jdbc.slice_predicates("matchid", bounds)):
        number = F.when(F.expr(condition), i).otherwise(number)
    sizes = ids.groupBy(number.cast("bigint").alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())  # one row per slice
    return sizes.select("slice", (F.abs(F.col("n") / total - 1 / SLICES) < 0.01).alias("even"))


@_query("write_read_scores")
def _write_read_scores(data, spark, folder):
    path = new_path(spark, "scores")
    parquet.write_parquet(data.scores, path)
    return parquet.read_scores(spark, path)


@_query("scan_scores")
def _scan_scores(data, spark, folder):
    rows = data.scores.filter(F.col("age") >= careers.MIN_AGE)
    return rows.select("playerid", "matchid", "teamid", "age", total_col("diff", 1))


# --- core -------------------------------------------------------------------------------------

_simple("player_time", lambda d: pitch_time.player_time(d.tables))
_simple("playtime_by_season", lambda d: pitch_time.playtime_by_season(d.tables))
_simple("goalless_segments", lambda d: segments.goalless_segments(d.tables))
_simple("goalless_segments_compat", lambda d: segments.goalless_segments(d.tables, compat=True))
_simple("neutral_off_points", lambda d: neutral.neutral_off_points(d.tables))
_simple("neutral_def_points", lambda d: neutral.neutral_def_points(d.tables))
_simple("neutral_def_points_compat", lambda d: neutral.neutral_def_points(d.tables, compat=True))
_simple("neutral_points", lambda d: neutral.neutral_points(d.tables))
_simple("neutral_points_compat", lambda d: neutral.neutral_points_compat(d.tables))


def _last_x(data: DataSet, x: int) -> DataFrame:
    return rolling.last_x(
        neutral.neutral_points(data.tables), (x,), hot=data.tables.hot_players
    )


_simple("last_x_1", lambda d: _last_x(d, 1))
_simple("last_x_5", lambda d: _last_x(d, 5))
_simple("score_set", lambda d: scores.score_set(d.tables))
_simple("score_latest", lambda d: scores.score_latest(scores.score_set(d.tables)))
_simple("score_with_age", lambda d: scores.score_with_age(d.tables))

_POINT_KEYS = ["playerid", "matchid", "teamid"]
_simple(
    "ranked_off_points",
    lambda d: ranked.ranked_points(d.tables, stored=d.credited()).select(*_POINT_KEYS, RANKED.off),
)
_simple(
    "ranked_def_points",
    lambda d: ranked.ranked_points(d.tables, stored=d.credited()).select(*_POINT_KEYS, RANKED.deff),
)
_simple("ranked_points", lambda d: ranked.ranked_points(d.tables, stored=d.credited()))
_simple("ranked_last_x", lambda d: ranked.ranked_last_x(d.tables, stored=d.credited()))
_simple(
    "neutral_ranked_last_x", lambda d: ranked.neutral_ranked_last_x(d.tables, stored=d.credited())
)
_simple("ranked_last_x_5", lambda d: ranked.ranked_last_x(d.tables, (5,), stored=d.credited(5)))
_simple(
    "neutral_ranked_last_x_5",
    lambda d: ranked.neutral_ranked_last_x(d.tables, (5,), stored=d.credited(5)),
)
_simple(
    "neutral_ranked_last_x_5_compat",
    lambda d: ranked.neutral_ranked_last_x(d.tables, (5,), stored=d.credited(5), compat=True),
)


@_query("incremental_scores")
def _incremental_scores(data, spark, folder):
    """The score table of a store that was written up to some day and then updated."""
    path, tables = new_path(spark, "store"), data.tables
    late = tables.match.filter(F.year("matchday") >= STORE_UPDATED)
    early = {
        name: getattr(tables, name).join(late.select("matchid"), "matchid", "left_anti") for name in store.OF_MATCH
    }
    store.write_store(replace(tables, **early), path)
    store.update_store(tables, path, late.select("matchid"))
    return store.read_store(spark, path, "scores").drop(store.SEASON)


_simple("laid_out_last_x_5", lambda d: d.laid_out.last_x((5,)))
_simple("laid_out_ranked_points", lambda d: d.laid_out.ranked_points())

# --- overview ---------------------------------------------------------------------------------

_simple("matches_by_season", lambda d: overview.matches_by_season(d.tables.match))
_simple("top_countries", lambda d: overview.top_countries(d.tables.match))
_simple("top_tournaments", lambda d: overview.top_tournaments(d.tables.match))
_simple("top_referees", lambda d: overview.top_referees(d.tables.match, d.tables.referee))
_simple("top_teams", lambda d: overview.top_teams(d.tables.match, d.tables.team))


def _card_diff(data: DataSet) -> DataFrame:
    return overview.referee_card_diff(data.tables.match, data.tables.card, TOURNAMENT, SEASONS)


def _with_card_diff(fn):
    return lambda d: fn(_card_diff(d), d.tables.team, d.tables.referee)


_simple("referee_card_diff", _card_diff)
_simple("referee_most_cards", _with_card_diff(overview.referee_most_cards))
_simple("referee_least_cards", _with_card_diff(overview.referee_least_cards))
_simple(
    "referee_fav_hate",
    lambda d: overview.referee_fav_hate(
        stage(_card_diff(d), "card-diff"), d.tables.team, d.tables.referee
    ),
)


def _played(data: DataSet) -> DataFrame:
    return overview.played_since(data.times, PLAYED_SINCE)


_simple("top_playtime", lambda d: overview.top_playtime(_played(d)))
_simple(
    "position_counts",
    lambda d: overview.position_counts(overview.top_playtime(_played(d)), d.tables.profile),
)
_simple(
    "position_kind_counts",
    lambda d: overview.position_kind_counts(overview.top_playtime(_played(d)), d.tables.profile),
)
_simple(
    "playtime_by_position", lambda d: overview.playtime_by_position(_played(d), d.tables.profile)
)
_simple("playtime_by_kind", lambda d: overview.playtime_by_kind(_played(d), d.tables.profile))

# --- careers ----------------------------------------------------------------------------------

_simple(
    "career_curve",
    lambda d: careers.career_curve(
        d.scores, d.tables.profile, CAREER_NAMES, hot=d.tables.hot_players
    ),
)


def _compared(data: DataSet) -> DataFrame:
    return careers.team_minus_player(
        data.aged_scores((1,)),
        data.tables.profile,
        hot_matches=data.tables.hot_matches,
        hot_players=data.tables.hot_players,
    )


_simple("team_minus_player", _compared)
_simple("team_minus_player_top10", lambda d: careers.team_minus_player_top(_compared(d)))
_simple(
    "team_minus_player_curve",
    lambda d: careers.team_minus_player_curve(
        stage(_compared(d), "compared"), d.tables.profile, hot=d.tables.hot_players
    ),
)

# --- monthly ----------------------------------------------------------------------------------


def _season(data: DataSet) -> DataFrame:
    return monthly.in_season(data.results_of([SEASON]), [SEASON], [TOURNAMENT])


def _monthly(data: DataSet) -> DataFrame:
    return data.kept("monthly", lambda: monthly.monthly_player(_season(data)))


_simple("monthly_player", _monthly)
_simple("month_spine", lambda d: monthly.month_spine(_monthly(d)))
_simple(
    "monthly_average_player", lambda d: monthly.monthly_average_player(_monthly(d), _monthly(d))
)
_simple("season_performance", lambda d: monthly.season_performance(_monthly(d)))
for _short, _metric in BEST_METRICS.items():
    _simple(
        f"best5_{_short}",
        lambda d, m=_metric: monthly.best(monthly.season_performance(_monthly(d)), m),
    )
    _simple(
        f"worst5_{_short}",
        lambda d, m=_metric: monthly.worst(monthly.season_performance(_monthly(d)), m),
    )
_simple(
    "best5_series", lambda d: monthly.best_series(_monthly(d), _monthly(d), "total_ranked_off")
)
_simple(
    "best5_series_avg_off",
    lambda d: monthly.best_series(_monthly(d), _monthly(d), "avg_ranked_off"),
)
_simple(
    "def_series_shifted",
    lambda d: monthly.shifted_series(_monthly(d), _monthly(d), "total_ranked_def"),
)
_simple(
    "def_series_shifted_avg",
    lambda d: monthly.shifted_series(_monthly(d), _monthly(d), "avg_ranked_def"),
)
_simple(
    "relevant_tournaments",
    lambda d: monthly.relevant_tournaments(d.results_of([SEASON]), list(PLAYERS), [SEASON]),
)
_simple(
    "chosen_player_series", lambda d: monthly.chosen_player_series(d.results, PLAYERS, [SEASON])
)
_simple("filtered_count", lambda d: monthly.filtered_count(d.results_of([SEASON]), 2, SEASON))
_simple("running_total", lambda d: monthly.running_total(d.results, list(PLAYERS)))
_simple(
    "running_total_compat",
    lambda d: monthly.running_total(d.results, list(PLAYERS), compat=True),
)
_simple(
    "running_total_yearly",
    lambda d: monthly.running_total_yearly(monthly.running_total(d.results, list(PLAYERS))),
)


def _topn(data: DataSet, metric: str) -> DataFrame:
    return monthly.topn_cumulative(
        data.results_of(list(dict.fromkeys([*TARGET_SEASONS, SEASON]))),
        data.tables.profile,
        metric,
        TARGET_SEASONS,
        [SEASON],
        MEMBER_TOURNAMENTS,
    )


_simple("topn_cumulative", lambda d: _topn(d, "total_diff"))
for _metric in ("avg_diff", "avg_off", "avg_def"):
    _simple(f"topn_cumulative_{_metric}", lambda d, m=_metric: _topn(d, m))
_simple("topn_pivot", lambda d: monthly.topn_pivot(_topn(d, "total_diff")))

# --- leagues, trainers, graph -----------------------------------------------------------------

_simple("league_strength", lambda d: leagues.league_strength(d.tables.match, d.results))


def _points(data: DataSet, compat: bool = False) -> DataFrame:
    return trainers.match_points(
        data.tables.match, data.tables.goal, POINTS_SINCE, POINTS_UNTIL, compat
    )


def _trainer_effect(data: DataSet, compat: bool = False) -> DataFrame:
    return trainers.trainer_effect(
        stage(_points(data, compat), "points"),
        data.tables.trainer,
        data.tables.trainer_name,
        TOURNAMENT,
        TRAINER_SINCE,
        compat,
        data.tables.hot_teams,
    )


_simple("match_points", _points)
_simple("match_points_compat", lambda d: _points(d, compat=True))
_simple("trainer_effect", _trainer_effect)
_simple("trainer_effect_compat", lambda d: _trainer_effect(d, compat=True))


def _graph(data: DataSet) -> tuple[DataFrame, DataFrame]:
    present = coplay.coplay_presence(
        data.played,
        data.tables.match,
        GRAPH_SINCE,
        GRAPH_COUNTRIES,
        data.tables.hot_matches,
    )
    return present, coplay.coplay_nodes(present, data.tables.profile, data.tables.team)


_simple("coplay_nodes", lambda d: _graph(d)[1])
for _name, _edges in (
    ("coplay_edges", coplay.coplay_edges),
    ("coplay_edges_weighted", coplay.coplay_edges_weighted),
):
    _simple(
        _name,
        lambda d, fn=_edges: fn(*_graph(d), d.tables.hot_matches, d.tables.hot_players),
    )


_simple(
    "coplay_edges_compat",
    lambda d: coplay.coplay_edges(*_graph(d), d.tables.hot_matches, d.tables.hot_players, compat=True),
)


@_query("coplay_export_edges")
def _coplay_export_edges(data, spark, folder):
    path = new_path(spark, "edges")
    csv_files.write_csv(_QUERIES["coplay_edges"](data, spark, folder), path)
    return spark.read.schema("source bigint, target bigint").option("header", True).csv(path)


@_query("coplay_export")
def _coplay_export(data, spark, folder):
    path = new_path(spark, "nodes")
    csv_files.write_csv(_graph(data)[1], path)
    return spark.read.schema("id bigint, label string, nationality string, position string, "
                             "teamname string").option("header", True).csv(path)


# --- goal model -------------------------------------------------------------------------------


def _asof(data: DataSet, compat: bool = False) -> DataFrame:
    lineups = feat.lineups_since(
        data.tables.match, data.tables.player, FEATURES_SINCE, data.tables.hot_matches
    )
    # With their age: a player with several profiles has as many rows, which compat counts.
    return feat.asof_scores(lineups, data.aged_scores(DEFAULT_XS), compat=compat, hot=data.tables.hot_players)


def _features(data: DataSet) -> DataFrame:
    goals = feat.team_goal_table(data.tables.match, data.tables.goal)
    return feat.match_features(goals, data.strength)


def _split(data: DataSet, compat: bool = False) -> DataFrame:
    rows = feat.match_features_norm(_features(data), keep_ids=True)
    return training.train_split(rows, compat=compat)


def _wide_features(data: DataSet) -> DataFrame:
    goals = feat.team_goal_table(data.tables.match, data.tables.goal)
    return feat.match_vectors_norm(feat.match_vectors(goals, data.wide_strength))


_simple("team_strength_wide", lambda d: feat.named(d.wide_strength, WIDE_ATTRIBUTES))
_simple("match_features_wide", lambda d: feat.named(_wide_features(d), WIDE_ATTRIBUTES))
_simple("team_goal_table", lambda d: feat.team_goal_table(d.tables.match, d.tables.goal))
_simple("matches_by_year", lambda d: feat.matches_by_year(d.tables.match, FEATURES_SINCE))
_simple("asof_scores", _asof)
_simple("asof_scores_compat", lambda d: _asof(d, compat=True))
_simple("team_strength", lambda d: d.strength)
_simple("match_features", _features)
_simple("match_features_norm", lambda d: feat.match_features_norm(_features(d)))
_simple(
    "train_split",
    lambda d: _split(d).select("matchid", "teamid", "goals", "matchlength", "is_test", "is_valid"),
)
_simple(
    "train_split_compat",
    lambda d: _split(d, compat=True).select("matchid", "teamid", "goals", "matchlength", "is_test"),
)


def _stored_split(data: DataSet) -> DataFrame:
    return data.kept("split", lambda: _split(data))


def _goals(data: DataSet) -> DataFrame:
    """The rows of the split without their inputs."""
    columns = ["matchid", "teamid", training.LABEL, "is_test", "is_valid"]
    return data.kept("split-goals", lambda: _split(data).select(*columns))


def _goal_model(data: DataSet) -> training.GoalModel:
    return data.held("goal-model", lambda: training.goal_model(_stored_split(data)))


def _predictions(data: DataSet) -> DataFrame:
    return data.kept("predictions", lambda: training.goal_predictions(_goal_model(data), _stored_split(data)))


def _prepared(data: DataSet) -> training.Prepared:
    return data.held("prepared", lambda: training.prepare(_stored_split(data)))


def _fits(data: DataSet) -> dict[float, training.Boosted]:
    return data.held("fits", lambda: training.boost_each(_prepared(data)))


_simple("train_imputed", lambda d: training.imputed(_stored_split(d)))
_simple("mean_predictions", lambda d: training.mean_predictions(_goals(d)))
_simple("mean_errors", lambda d: training.model_errors(training.mean_predictions(_goals(d))))
_simple("goal_predictions", _predictions)
_simple("model_errors", lambda d: training.model_errors(_predictions(d)))
_QUERIES["goal_trees"] = lambda d, spark, folder: training.tree_nodes(_goal_model(d).trees, spark)
_QUERIES["model_curves"] = lambda d, spark, folder: training.model_curves(_fits(d), spark)
_simple("model_grid", lambda d: training.model_grid(_prepared(d), _fits(d)))


def queries() -> dict[str, Query]:
    def bind(name: str, fn) -> Query:
        digits = DIGITS.get(name, 6)
        return lambda spark, folder: comparable(
            fn(dataset_of(spark, folder), spark, folder), digits, TIES.get(name, 0.0)
        )

    return {name: bind(name, fn) for name, fn in _QUERIES.items()}


