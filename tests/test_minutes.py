"""Sets of minutes as bits give what sets give."""

from conftest import day
from pyspark.sql import functions as F

from pitchlens.operators.pitch_time import entries


def test_minutes_as_bits_equal_sets(make_tables):
    at = [None, 0, 1, 45, 62, 63, 64, 65, 90, 126, 127]
    changes = [(1, 1, 100 + i % 7, 200 + i % 5, at[(i * i + i // 3) % 11]) for i in range(60)]
    changes += [(1, 1, 300, 301, 10), (1, 1, 300, 301, 10), (1, 1, 302, None, 127), (None, 1, 303, 304, 5)]
    tables = make_tables(
        match=[(1, day(0), 1, 2)],
        player=[(200 + i, 1, 1) for i in range(4)] + [(400, 1, 2), (400, 1, 2)],
        substitution=changes,
        card=[(1, 1, 200, "red", 50), (1, 1, 201, "yellowred", None), (1, 2, 400, "yellow", 3)],
    )

    def told(df):
        sets = [F.sort_array(c).alias(c) for c in ("ins", "outs")]
        return sorted(map(repr, df.select("playerid", "matchid", "teamid", *sets, "open_out", "dismissed", "card_time").collect()))

    assert tables.usual_minutes
    bits = entries(tables)
    assert "collect_set" not in bits._jdf.queryExecution().optimizedPlan().toString()
    got = told(bits)
    tables.__dict__["usual_minutes"] = False
    assert got == told(entries(tables)) == told(entries(tables, by_match=True)) and len(got) > 10


def test_other_minutes_stay_exact(make_tables):
    tables = make_tables(match=[(1, day(0), 1, 2)], substitution=[(1, 1, 5, 6, -3), (1, 1, 5, 6, 128), (1, 1, 5, 6, 500)])
    assert not tables.usual_minutes
    assert [sorted(r.ins) for r in entries(tables).collect()] == [[-3, 128, 500]]


def test_strength_shuffles_no_averages(make_tables, spark):
    import re

    from pitchlens.model import features as feat
    from pitchlens.plans.dataset import DataSet

    tables = make_tables(
        match=[(m, day(m // 2), m % 3, (m + 1) % 3) for m in range(30)],
        player=[(p, m, m % 3 if p % 2 else (m + 1) % 3) for m in range(30) for p in range(8) if (m + p) % 3],
        substitution=[(m, m % 3, 20 + m % 4, m % 8, 30 + m) for m in range(30)],
        goal=[(m, t % 3, 5 * m % 90, None) for m in range(30) for t in (m, m + 1)],
    )
    data = DataSet(tables)
    lineups = feat.lineups_since(tables.match, tables.player, 2014, tables.hot_matches)
    want = feat.team_strength(feat.asof_scores(lineups, data.scores, hot=tables.hot_players), data.played)

    def told(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    got = data.strength.select(*want.columns)
    assert told(got) == told(want) and want.count() > 30
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [matchid" in plan and not re.search(r"RepartitionByExpression \[matchid(?:.*\n){1}.*avg_", plan)
    goals = feat.team_goal_table(tables.match, tables.goal)
    assert told(feat.match_features(goals, got)) == told(feat.match_features(goals, want))
