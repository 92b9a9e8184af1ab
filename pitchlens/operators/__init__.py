from pitchlens.operators.neutral import (
    neutral_def_points,
    neutral_off_points,
    neutral_points,
    neutral_points_compat,
)
from pitchlens.operators.pitch_time import player_time, playtime_by_season, presence
from pitchlens.operators.ranked import ranked_points
from pitchlens.operators.rolling import last_x, running_sum
from pitchlens.operators.scores import score_latest, score_set, with_age
from pitchlens.operators.segments import goalless_segments

__all__ = [
    "goalless_segments",
    "last_x",
    "neutral_def_points",
    "neutral_off_points",
    "neutral_points",
    "neutral_points_compat",
    "player_time",
    "playtime_by_season",
    "presence",
    "ranked_points",
    "running_sum",
    "score_latest",
    "score_set",
    "with_age",
]
