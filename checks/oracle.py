"""The queries once more, as SQL for another engine.

Each is written from the definition of the operator (self-joins, unions of zero rows, range
joins), not from the Spark plan, so that agreement says something about the rewrites.
"""

from __future__ import annotations

import re

from pitchlens.functions.columns import ATTRIBUTE_ORDER as ATTRS
from pitchlens.functions.columns import WIDE_ATTRIBUTES, WIDE_XS
from pitchlens.functions.scalars import POSITION_KINDS
from pitchlens.plans import registry as p
from pitchlens.schema import SCHEMAS

XS = (1, 2, 3, 5)

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


def r(expression: str, alias: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {alias}"


def big(expression: str, alias: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {alias}"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- input tables -----------------------------------------------------------------------------

cte(
    "f_match",
    """
    SELECT o_orderkey AS matchid, CAST(o_orderdate AS DATE) AS matchday,
           CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS saison,
           o_orderpriority AS tournament, o_orderstatus AS country,
           CAST(90 + 10 * (o_orderkey % 4) AS INT) AS matchlength,
           o_custkey % 25 AS hometeam,
           (o_custkey % 25 + 1 + o_orderkey % 24) % 25 AS guestteam,
           (o_orderkey * 7 + o_custkey) % 20 AS refereeid
    FROM orders
    """,
)
cte(
    "f_seen",
    """
    SELECT l_orderkey AS matchid, 2 * l_suppkey AS playerid,
           CASE WHEN min(l_linenumber) % 2 = 1 THEN min(hometeam) ELSE min(guestteam) END AS teamid,
           CAST(min(l_quantity) AS INT) AS qty,
           CAST(round(min(l_discount) * 100) AS INT) AS disc,
           CAST(round(min(l_tax) * 100) AS INT) AS tax,
           min(l_returnflag) AS rf, min(l_linestatus) AS ls
    FROM lineitem JOIN f_match ON l_orderkey = matchid
    GROUP BY l_orderkey, l_suppkey
    """,
)
cte("f_player", "SELECT playerid, matchid, teamid FROM f_seen")
cte(
    "f_sub",
    """
    SELECT matchid, teamid, playerid + 1 AS playerin, playerid AS playerout,
           CASE WHEN qty = 50 THEN NULL ELSE 45 + qty % 40 END AS time
    FROM f_seen WHERE ls = 'F' AND disc < 5
    """,
)
cte(
    "f_card",
    """
    SELECT matchid, teamid, playerid,
           CASE WHEN disc >= 9 THEN 'red' WHEN disc >= 8 THEN 'yellowred' ELSE 'yellow' END AS color,
           20 + qty AS time
    FROM f_seen WHERE rf = 'R'
    """,
)
cte(
    "f_goal",
    """
    SELECT matchid, teamid, 1 + (qty * 3) % 90 AS time,
           CASE WHEN tax = 8 THEN NULL ELSE playerid END AS scorer, tax = 8 AS own_goal
    FROM f_seen WHERE tax >= 4
    """,
)
cte("f_team", "SELECT CAST(n_nationkey AS BIGINT) AS teamid, n_name AS teamname FROM nation")
_positions = ", ".join(f"'{x}'" for x in [*POSITION_KINDS, "Unbekannt"])
cte(
    "f_profile",
    f"""
    SELECT p_partkey AS playerid, p_name AS playername,
           CASE WHEN p_size % 10 = 0 THEN NULL
                ELSE CAST(DATE '1960-01-01' + CAST(p_size * 300 AS INT) AS DATE) END AS birthdate,
           p_brand AS nationality, ([{_positions}])[p_partkey % 18 + 1] AS position
    FROM part
    """,
)
_kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION_KINDS.items())
cte(
    "f_kind",
    f"""
    SELECT playerid, CASE position {_kinds} ELSE NULL END AS position_kind FROM f_profile
    """,
)
cte(
    "f_referee",
    "SELECT c_custkey AS refereeid, c_name AS refereename FROM customer WHERE c_custkey < 20",
)
cte(
    "f_trainer",
    """
    SELECT hometeam * 4 + CAST(saison AS INT) % 4 AS trainer, hometeam AS team, matchid AS match
    FROM f_match
    UNION ALL
    SELECT guestteam * 4 + CAST(saison AS INT) % 4, guestteam, matchid FROM f_match
    """,
)
cte(
    "f_trainer_name",
    "SELECT c_custkey AS trainer, c_name AS trainername FROM customer WHERE c_custkey < 100",
)

# --- time on the pitch ------------------------------------------------------------------------

cte(
    "f_listed",
    """
    SELECT teamid, playerid, matchid, 0 AS in_time FROM f_player
    UNION ALL
    SELECT teamid, playerin, matchid, time FROM f_sub
    """,
)
cte(
    "f_with_out",
    """
    SELECT l.playerid, l.matchid, l.teamid, l.in_time, s.time AS out_time, m.matchlength
    FROM f_listed l
    LEFT JOIN f_sub s
      ON s.playerout = l.playerid AND s.matchid = l.matchid AND s.teamid = l.teamid
    JOIN f_match m ON m.matchid = l.matchid
    """,
)
cte(
    "f_stayed",
    """
    SELECT DISTINCT playerid, matchid, teamid, in_time, matchlength
    FROM f_with_out WHERE out_time IS NULL
    """,
)
cte(
    "f_sent_off",
    """
    SELECT playerid, matchid, teamid, min(time) AS card_time, 1 AS sent
    FROM f_card WHERE color IN ('red', 'yellowred') GROUP BY ALL
    """,
)
cte(
    "f_spell",
    """
    SELECT playerid, matchid, teamid, in_time, out_time FROM f_with_out
    WHERE out_time IS NOT NULL
    UNION ALL
    SELECT s.playerid, s.matchid, s.teamid, s.in_time,
           CASE WHEN c.sent = 1 THEN c.card_time ELSE s.matchlength END
    FROM f_stayed s LEFT JOIN f_sent_off c USING (playerid, matchid, teamid)
    """,
)
cte(
    "f_time",
    """
    SELECT *, CASE WHEN out_time <> in_time THEN out_time - in_time ELSE 1 END AS playtime
    FROM f_spell
    """,
)
oracle(
    "player_time",
    f"""
    SELECT playerid, matchid, teamid, {big("in_time", "in_time")}, {big("out_time", "out_time")},
           {big("playtime", "playtime")} FROM f_time
    """,
)
oracle(
    "playtime_by_season",
    f"""
    SELECT playerid, teamid, tournament, saison, {big("sum(playtime)", "playtimes")}
    FROM f_time JOIN f_match USING (matchid) GROUP BY playerid, teamid, tournament, saison
    """,
)

cte(
    "f_segment",
    """
    SELECT CAST(r * 5 AS INT) AS segment_from, CAST(r * 5 + 5 AS INT) AS segment_to
    FROM range(0, 24) t(r)
    """,
)
cte(
    "f_side_segment",
    """
    SELECT s.*, segment_from, segment_to
    FROM (SELECT matchid, matchday, matchlength, hometeam AS teamid FROM f_match
          UNION ALL
          SELECT matchid, matchday, matchlength, guestteam FROM f_match) s
    JOIN f_segment ON matchlength >= segment_to
    """,
)


def _segments(kept: str) -> str:
    return f"""
    SELECT p.playerid, f.matchid, f.teamid, f.matchday AS target_match_timestamp,
           {big("f.matchlength", "matchlength")}, {big("segment_from", "segment_from")},
           {big("segment_to", "segment_to")}, {big("in_time", "in_time")},
           {big("out_time", "out_time")}, {big("playtime", "playtime")}
    FROM ({kept}) f
    JOIN f_time p ON f.matchid = p.matchid AND f.teamid = p.teamid
     AND f.segment_from >= p.in_time AND f.segment_to <= p.out_time
    """


_segment_goal = """
    g.matchid = s.matchid AND g.teamid <> s.teamid
    AND s.segment_from < g.time AND g.time <= s.segment_to
"""
oracle(
    "goalless_segments",
    _segments(
        f"SELECT s.* FROM f_side_segment s WHERE NOT EXISTS "
        f"(SELECT 1 FROM f_goal g WHERE {_segment_goal})"
    ),
)
oracle(
    "goalless_segments_compat",
    _segments(
        f"SELECT s.* FROM f_side_segment s LEFT JOIN f_goal g ON {_segment_goal} "
        "WHERE g.scorer IS NULL"
    ),
)

# --- neutral points ---------------------------------------------------------------------------

cte(
    "f_off_goal",
    """
    SELECT p.matchid, p.playerid, 1.0::DOUBLE AS point FROM f_time p JOIN f_goal g
      ON p.matchid = g.matchid AND p.teamid = g.teamid
     AND p.in_time <= g.time AND g.time <= p.out_time
    """,
)
cte(
    "f_def_goal",
    """
    SELECT p.matchid, p.playerid, -1 AS point FROM f_time p JOIN f_goal g
      ON p.matchid = g.matchid AND p.teamid <> g.teamid
     AND p.in_time <= g.time AND g.time <= p.out_time
    """,
)
cte(
    "f_off",
    """
    SELECT matchid, playerid, sum(point) AS off FROM (
        SELECT * FROM f_off_goal UNION ALL SELECT matchid, playerid, 0.0 FROM f_time)
    GROUP BY matchid, playerid
    """,
)
cte(
    "f_def",
    """
    SELECT matchid, playerid, CAST(sum(point) AS BIGINT) AS def FROM (
        SELECT * FROM f_def_goal UNION ALL SELECT matchid, playerid, 0 FROM f_time)
    GROUP BY matchid, playerid
    """,
)
cte(
    "f_def_compat",
    """
    SELECT matchid, playerid, CAST(sum(point) AS BIGINT) AS def FROM (
        SELECT * FROM f_def_goal UNION ALL SELECT teamid, playerid, 0 FROM f_time)
    GROUP BY matchid, playerid
    """,
)


def _merged(defensive: str) -> str:
    return f"""
    SELECT t.playerid, t.matchid, t.teamid, m.matchday, m.saison, m.tournament,
           CAST(t.playtime AS BIGINT) AS playtime, o.off, d.def, o.off + d.def AS diff
    FROM f_time t JOIN f_off o USING (playerid, matchid)
    JOIN {defensive} d USING (playerid, matchid) JOIN f_match m USING (matchid)
    """


cte("f_points", _merged("f_def"))
oracle("neutral_off_points", f"SELECT matchid, playerid, {r('off', 'off_points')} FROM f_off")
oracle("neutral_def_points", "SELECT matchid, playerid, def AS def_points FROM f_def")
oracle("neutral_def_points_compat", "SELECT matchid, playerid, def AS def_points FROM f_def_compat")
_points_out = f"""
    SELECT playerid, matchid, teamid, matchday, saison, tournament, playtime,
           {r("off", "off")}, def, {r("diff", "diff")}
"""
oracle("neutral_points", f"{_points_out} FROM f_points")
oracle("neutral_points_compat", f"{_points_out} FROM ({_merged('f_def_compat')})")

# --- last X, from the definition --------------------------------------------------------------

cte(
    "f_history",
    """
    SELECT t.playerid, t.matchid, t.teamid, t.matchday AS day, h.playtime, h.off, h.def, h.diff,
           row_number() OVER (PARTITION BY t.matchid, t.playerid, t.teamid, t.matchday
                              ORDER BY h.matchday DESC, h.matchid DESC) AS rank
    FROM f_points t JOIN f_points h
      ON t.playerid = h.playerid AND t.matchday >= h.matchday
    QUALIFY rank <= 5
    """,
)


def _rolling(xs, names, value=lambda n, x: f"sum({n}) FILTER (rank <= {x})") -> str:
    out = []
    for x in xs:
        minutes = value("playtime", x)
        out.append(big(minutes, f"playtime_last_{x}"))
        for n in names:
            kind = big if n == "def" else r
            out.append(kind(value(n, x), f"total_{n}_last_{x}"))
            out.append(r(f"{value(n, x)} / {minutes}", f"avg_{n}_last_{x}"))
    return ", ".join(out)


def _score_rows(xs) -> str:
    return f"""
    SELECT playerid, matchid, teamid, day AS target_match_timestamp,
           {_rolling(xs, ("off", "def", "diff"))}
    FROM f_history GROUP BY playerid, matchid, teamid, day
    """


oracle("last_x_1", _score_rows((1,)))
oracle("last_x_5", _score_rows((5,)))
oracle("score_set", _score_rows(XS))
oracle("score_latest", _score_rows(XS))
oracle(
    "score_with_age",
    f"""
    SELECT s.*, {r("datediff('day', birthdate, target_match_timestamp) / 365.0::DOUBLE", "age")}
    FROM ({_score_rows(XS)}) s
    LEFT JOIN (SELECT playerid, birthdate FROM f_profile WHERE birthdate IS NOT NULL)
    USING (playerid)
    """,
)
oracle(
    "write_read_scores",
    ORACLES["score_with_age"],
)

# --- last X, by windows (for the reports; equality with the above is checked by score_set) -----


def _windowed(source: str, scope: str, xs, names) -> str:
    parts = ", ".join(
        f"sum({n}) OVER (PARTITION BY {scope} ORDER BY matchday, matchid "
        f"ROWS BETWEEN {x - 1} PRECEDING AND CURRENT ROW) AS {n}_{x}"
        for x in xs
        for n in ("playtime", *names)
    )
    whole_day = (
        f"OVER (PARTITION BY {scope}, matchday ORDER BY matchid "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    )
    cols = []
    for x in xs:
        last = {n: f"last_value({n}_{x}) {whole_day}" for n in ("playtime", *names)}
        cols.append(f"CAST({last['playtime']} AS BIGINT) AS playtime_last_{x}")
        for n in names:
            cols.append(f"{last[n]} AS total_{n}_last_{x}")
            cols.append(f"{last[n]} / {last['playtime']} AS avg_{n}_last_{x}")
    return f"""
    SELECT playerid, matchid, teamid, saison, tournament, matchday AS target_match_timestamp,
           {", ".join(cols)}
    FROM (SELECT *, {parts} FROM {source})
    """


cte("f_career", _windowed("f_points", "playerid", XS, ("off", "def", "diff")))
cte("f_season", _windowed("f_points", "playerid, saison", (1,), ("off", "def", "diff")))
cte(
    "f_scores",
    """
    SELECT s.*, datediff('day', birthdate, target_match_timestamp) / 365.0::DOUBLE AS age
    FROM f_career s
    LEFT JOIN (SELECT playerid, birthdate FROM f_profile WHERE birthdate IS NOT NULL)
    USING (playerid)
    """,
)
oracle(
    "scan_scores",
    f"""
    SELECT playerid, matchid, teamid, {r("age", "age")},
           {r("total_diff_last_1", "total_diff_last_1")}
    FROM f_scores WHERE age >= 17
    """,
)

# --- ranked points ----------------------------------------------------------------------------

cte(
    "f_def_weight",
    """
    SELECT g.time, g.teamid AS off_team, p.teamid AS def_team, g.matchid,
           sum(f.avg_def_last_1) AS weight
    FROM f_goal g JOIN f_time p ON g.matchid = p.matchid AND g.teamid <> p.teamid
     AND p.in_time <= g.time AND g.time <= p.out_time
    JOIN f_season f
      ON f.playerid = p.playerid AND f.matchid = p.matchid AND f.teamid = p.teamid
    GROUP BY g.time, g.teamid, p.teamid, g.matchid
    """,
)
cte(
    "f_off_weight",
    """
    SELECT g.time, g.teamid AS off_team, g.matchid, sum(f.avg_off_last_1) AS weight
    FROM f_goal g JOIN f_time p ON g.matchid = p.matchid AND g.teamid = p.teamid
     AND p.in_time <= g.time AND g.time <= p.out_time
    JOIN f_season f
      ON f.playerid = p.playerid AND f.matchid = p.matchid AND f.teamid = p.teamid
    GROUP BY g.time, g.teamid, g.matchid
    """,
)
cte(
    "f_off_hit",
    """
    SELECT p.playerid, p.matchid, p.playtime, w.weight
    FROM f_time p JOIN f_def_weight w ON w.matchid = p.matchid AND w.off_team = p.teamid
     AND p.in_time <= w.time AND w.time <= p.out_time
    """,
)
cte(
    "f_def_hit",
    """
    SELECT p.playerid, p.matchid, p.playtime, w.weight
    FROM f_time p JOIN f_off_weight w ON w.matchid = p.matchid AND w.off_team <> p.teamid
     AND p.in_time <= w.time AND w.time <= p.out_time
    """,
)
cte(
    "f_ranked_off",
    """
    SELECT playerid, matchid, sum(v) AS ranked_off FROM (
        SELECT playerid, matchid, weight - (SELECT min(weight) FROM f_off_hit) AS v FROM f_off_hit
        UNION ALL SELECT DISTINCT playerid, matchid, 0.0 FROM f_time)
    GROUP BY playerid, matchid
    """,
)
cte(
    "f_ranked_def",
    """
    SELECT playerid, matchid, sum(v) AS ranked_def FROM (
        SELECT playerid, matchid, weight - (SELECT max(weight) FROM f_def_hit) AS v FROM f_def_hit
        UNION ALL SELECT DISTINCT playerid, matchid, 0.0 FROM f_time)
    GROUP BY playerid, matchid
    """,
)
cte(
    "f_ranked",
    """
    SELECT p.*, ranked_off, ranked_def, ranked_off + ranked_def AS ranked_diff
    FROM f_points p JOIN f_ranked_off USING (playerid, matchid)
    JOIN f_ranked_def USING (playerid, matchid)
    """,
)
_RANKED = ("ranked_off", "ranked_def", "ranked_diff")
for _side in ("off", "def"):
    oracle(
        f"ranked_{_side}_points",
        f"SELECT playerid, matchid, teamid, {r(f'ranked_{_side}', f'ranked_{_side}')} FROM f_ranked",
    )
oracle(
    "ranked_points",
    f"""
    SELECT playerid, matchid, teamid, saison, tournament, matchday, playtime, {r("off", "off")},
           def, {", ".join(r(c, c) for c in _RANKED)}
    FROM f_ranked
    """,
)
cte(
    "f_season_history",
    """
    SELECT t.playerid, t.matchid, t.teamid, t.saison, t.tournament, t.matchday AS day,
           h.playtime, h.off, h.def, h.diff, h.ranked_off, h.ranked_def, h.ranked_diff,
           row_number() OVER (PARTITION BY t.matchid, t.playerid, t.teamid, t.matchday
                              ORDER BY h.matchday DESC, h.matchid DESC) AS rank
    FROM f_ranked t JOIN f_ranked h
      ON t.playerid = h.playerid AND t.saison = h.saison AND t.matchday >= h.matchday
    QUALIFY rank <= 1
    """,
)


def _season_rows(names) -> str:
    return f"""
    SELECT playerid, matchid, teamid, saison, tournament, day AS target_match_timestamp,
           {_rolling((1,), names)}
    FROM f_season_history GROUP BY playerid, matchid, teamid, saison, tournament, day
    """


oracle("ranked_last_x", _season_rows(_RANKED))
oracle("neutral_ranked_last_x", _season_rows(("off", "def", "diff", *_RANKED)))
cte(
    "f_results",
    _windowed("f_ranked", "playerid, saison", (1,), ("off", "def", "diff", *_RANKED)),
)

# The same for a form of five matches; names of the tables that depend on the form end in _5.


def _five(sql: str) -> str:
    names = ("f_def_weight", "f_off_weight", "f_off_hit", "f_def_hit", "f_ranked_off", "f_ranked_def", "f_ranked")
    for name in names:
        sql = re.sub(rf"\b{name}\b", f"{name}_5", sql)
    return sql.replace("f_season ", "f_season_5 ").replace("_last_1", "_last_5")


cte("f_season_5", _windowed("f_points", "playerid, saison", (5,), ("off", "def", "diff")))
for _name in ("f_def_weight", "f_off_weight", "f_off_hit", "f_def_hit", "f_ranked_off", "f_ranked_def", "f_ranked"):
    cte(f"{_name}_5", _five(CTES[_name]))
cte("f_season_history_5", _five(CTES["f_season_history"]).replace("rank <= 1", "rank <= 5"))


def _rows_of_five(source: str, names) -> str:
    return f"""
    SELECT playerid, matchid, teamid, saison, tournament, day AS target_match_timestamp,
           {_rolling((5,), names)}
    FROM {source} GROUP BY playerid, matchid, teamid, saison, tournament, day
    """


oracle("ranked_last_x_5", _rows_of_five("f_season_history_5", _RANKED))
oracle("neutral_ranked_last_x_5", _rows_of_five("f_season_history_5", ("off", "def", "diff", *_RANKED)))
oracle(
    "neutral_ranked_last_x_5_compat",
    f"""
    SELECT * FROM (
        SELECT h.playerid, h.matchid, h.teamid, m.saison, m.tournament, day AS target_match_timestamp,
               {_rolling((5,), ("off", "def", "diff"))}
        FROM f_history h JOIN f_match m USING (matchid)
        GROUP BY h.playerid, h.matchid, h.teamid, m.saison, m.tournament, day)
    JOIN ({_rows_of_five("f_season_history_5", _RANKED)})
    USING (playerid, matchid, teamid, saison, tournament, target_match_timestamp, playtime_last_5)
    """,
)

# --- sources and scalar functions -------------------------------------------------------------


def _lines(name: str) -> str:
    absent = {"match": "matchtime", "goal": "assist"}.get(name)
    columns = ", ".join(
        "'-'" if c == absent else f"coalesce(CAST({c} AS VARCHAR), '-')" for c in SCHEMAS[name].names
    )
    table = "f_sub" if name == "substitution" else f"f_{name}"
    once = "DISTINCT " if name in ("team", "trainer", "trainer_name") else ""
    return f"SELECT '{name}' AS name, concat_ws('|', {columns}) AS line FROM (SELECT {once}* FROM {table})"


oracle(
    "load_csv_all_tables",
    f"SELECT name, line, count(*) AS n FROM ({' UNION ALL '.join(map(_lines, SCHEMAS))}) GROUP BY ALL",
)
oracle(
    "load_csv_rejects",
    """
    SELECT 'match' AS name, 'matchday' AS "column", 'n/a' AS text, count(*) AS n FROM f_match WHERE matchid % 97 = 0
    HAVING count(*) > 0 UNION ALL
    SELECT 'match', 'refereeid', '12.7', count(*) FROM f_match WHERE matchid % 89 = 0 HAVING count(*) > 0 UNION ALL
    SELECT 'substitution', 'time', '45+2', count(*) FROM f_sub WHERE matchid % 5 = 0 HAVING count(*) > 0
    """,
)
oracle(
    "match_slices",
    f"SELECT unnest(range({p.SLICES}))::BIGINT AS slice, true AS even",
)
oracle(
    "parse_match_dates",
    """
    SELECT matchid, date_text, CAST(try_strptime(date_text, '%d.%m.%Y') AS DATE) AS matchday
    FROM (SELECT matchid, CASE WHEN matchid % 97 = 0 THEN 'n/a'
                               ELSE strftime(matchday, '%d.%m.%Y') END AS date_text FROM f_match)
    """,
)
oracle(
    "cast_minutes",
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, minute_text,
           TRY_CAST(minute_text AS BIGINT) AS minute
    FROM (SELECT l_orderkey, l_linenumber,
                 CASE WHEN CAST(l_quantity AS INT) % 17 = 0 THEN '45+2'
                      ELSE CAST(20 + CAST(l_quantity AS INT) AS VARCHAR) END AS minute_text
          FROM lineitem)
    """,
)
oracle("coerce_team_ids", "SELECT matchid, hometeam AS teamid FROM f_match WHERE hometeam % 7 <> 0")
oracle("dedupe_trainer", "SELECT DISTINCT trainer, team FROM f_trainer")
oracle(
    "load_csv_roundtrip",
    f"""
    SELECT matchid, teamid, playerin, playerout, {big("time", "time")}, matchday
    FROM f_sub JOIN f_match USING (matchid)
    """,
)

# The same rows, whatever the layout of the stored tables.
oracle("incremental_scores", ORACLES["score_with_age"])
oracle("laid_out_last_x_5", ORACLES["last_x_5"])
oracle("laid_out_ranked_points", ORACLES["ranked_points"])

# --- overview ---------------------------------------------------------------------------------

oracle("matches_by_season", "SELECT saison, count(*) AS matches FROM f_match GROUP BY saison")
oracle(
    "top_countries",
    """
    SELECT country, count(*) AS matches FROM f_match GROUP BY country
    ORDER BY matches DESC, country LIMIT 30
    """,
)
oracle(
    "top_tournaments",
    """
    SELECT tournament, country, count(*) AS matches FROM f_match GROUP BY ALL
    ORDER BY matches DESC, tournament, country LIMIT 30
    """,
)
oracle(
    "top_referees",
    """
    SELECT refereeid, refereename, count(*) AS matches FROM f_match JOIN f_referee USING (refereeid)
    GROUP BY ALL ORDER BY matches DESC, refereeid LIMIT 20
    """,
)
oracle(
    "top_teams",
    """
    SELECT teamid, teamname, count(*) AS matches
    FROM (SELECT guestteam AS teamid FROM f_match UNION ALL SELECT hometeam FROM f_match)
    JOIN f_team USING (teamid) GROUP BY ALL ORDER BY matches DESC, teamid LIMIT 20
    """,
)
cte(
    "f_league_side",
    f"""
    SELECT matchid, guestteam AS teamid, refereeid FROM f_match
    WHERE tournament = '{p.TOURNAMENT}' AND saison IN ({quoted(p.SEASONS)})
    UNION ALL
    SELECT matchid, hometeam, refereeid FROM f_match
    WHERE tournament = '{p.TOURNAMENT}' AND saison IN ({quoted(p.SEASONS)})
    """,
)
cte(
    "f_card_count",
    """
    SELECT refereeid, teamid, matchid, count(*) AS n
    FROM f_league_side JOIN f_card USING (matchid, teamid) GROUP BY ALL
    """,
)
cte(
    "f_referee_avg",
    "SELECT refereeid, teamid, avg(n) AS avg_referee FROM f_card_count GROUP BY ALL",
)
cte("f_team_avg", "SELECT teamid, avg(avg_referee) AS avg_team FROM f_referee_avg GROUP BY ALL")
cte(
    "f_met",
    "SELECT refereeid, teamid, count(*) AS match_count FROM f_league_side GROUP BY ALL",
)
cte(
    "f_card_diff",
    """
    SELECT *, avg_referee - avg_team AS diff
    FROM f_team_avg JOIN f_referee_avg USING (teamid) JOIN f_met USING (refereeid, teamid)
    WHERE match_count > 2
    """,
)
cte(
    "f_card_extreme",
    """
    SELECT *, max(diff) OVER (PARTITION BY refereeid) AS most,
           min(diff) OVER (PARTITION BY refereeid) AS least FROM f_card_diff
    """,
)
oracle(
    "referee_card_diff",
    f"""
    SELECT refereeid, teamid, {r("avg_team", "avg_team")}, {r("avg_referee", "avg_referee")},
           match_count, {r("diff", "diff")} FROM f_card_diff
    """,
)
for _name, _which in (("referee_most_cards", "most"), ("referee_least_cards", "least")):
    oracle(
        _name,
        f"""
        SELECT refereeid, teamid, {r("diff", "diff")}, match_count, teamname, refereename
        FROM f_card_extreme JOIN f_team USING (teamid) JOIN f_referee USING (refereeid)
        WHERE diff = {_which}
        """,
    )
oracle(
    "referee_fav_hate",
    """
    SELECT l.refereename AS referee, lt.teamname AS favourite_team, mt.teamname AS hate_team
    FROM (SELECT * FROM f_card_extreme JOIN f_referee USING (refereeid) WHERE diff = least) l
    JOIN f_team lt ON lt.teamid = l.teamid
    JOIN (SELECT * FROM f_card_extreme JOIN f_referee USING (refereeid) WHERE diff = most) m
      ON l.refereeid = m.refereeid
    JOIN f_team mt ON mt.teamid = m.teamid
    WHERE lt.teamname <> mt.teamname
    """,
)
cte(
    "f_played",
    f"""
    SELECT t.*, tournament, saison FROM f_time t JOIN f_match USING (matchid)
    WHERE TRY_CAST(saison AS INT) >= {p.PLAYED_SINCE}
    """,
)
cte(
    "f_leader",
    """
    SELECT tournament, saison, playerid, total AS playtime_max FROM (
        SELECT *, max(total) OVER (PARTITION BY tournament, saison) AS most FROM (
            SELECT tournament, saison, playerid, sum(playtime) AS total FROM f_played GROUP BY ALL))
    WHERE total = most
    """,
)
oracle(
    "top_playtime",
    f"SELECT tournament, saison, playerid, {big('playtime_max', 'playtime_max')} FROM f_leader",
)
oracle(
    "position_counts",
    """
    SELECT position, count(*) AS players FROM f_leader JOIN f_profile USING (playerid)
    GROUP BY position
    """,
)
oracle(
    "position_kind_counts",
    """
    SELECT position_kind, count(*) AS players FROM f_leader JOIN f_kind USING (playerid)
    WHERE position_kind IS NOT NULL GROUP BY position_kind
    """,
)
cte("f_player_mean", "SELECT playerid, avg(playtime) AS playtime FROM f_played GROUP BY playerid")
oracle(
    "playtime_by_position",
    f"""
    SELECT position, {r("avg(playtime)", "playtime")}
    FROM f_player_mean JOIN f_profile USING (playerid) GROUP BY position
    """,
)
oracle(
    "playtime_by_kind",
    f"""
    SELECT position_kind, {r("avg(playtime)", "playtime")}
    FROM f_player_mean JOIN f_kind USING (playerid)
    WHERE position_kind IS NOT NULL GROUP BY position_kind
    """,
)

# --- careers ----------------------------------------------------------------------------------

oracle(
    "career_curve",
    f"""
    SELECT playerid, playername, matchid, teamid, {r("age", "age")},
           {r('''sum(total_diff_last_1) OVER (PARTITION BY playerid ORDER BY age, matchid, teamid
                 ROWS UNBOUNDED PRECEDING)''', "score")}
    FROM f_scores JOIN f_profile USING (playerid)
    WHERE playername IN ({quoted(p.CAREER_NAMES)}) AND age >= 17
    """,
)
cte(
    "f_grown",
    """
    SELECT s.* FROM f_scores s JOIN f_profile USING (playerid) WHERE age >= 17
    """,
)
cte(
    "f_team_mean",
    """
    SELECT matchid, teamid, avg(total_diff_last_1) AS team_total, avg(avg_diff_last_1) AS team_avg
    FROM f_grown GROUP BY matchid, teamid
    """,
)
cte(
    "f_versus",
    """
    SELECT *, team_total - total_diff_last_1 AS miss,
           CASE WHEN team_total - total_diff_last_1 > 0 THEN 1
                WHEN team_total - total_diff_last_1 < 0 THEN -1 ELSE 0 END AS performance
    FROM f_grown JOIN f_team_mean USING (matchid, teamid)
    """,
)
oracle(
    "team_minus_player",
    f"""
    SELECT matchid, playerid, teamid, {r("age", "age", 9)}, target_match_timestamp,
           {r("total_diff_last_1", "total_diff_last_1", 9)},
           {r("avg_diff_last_1", "avg_diff_last_1", 9)},
           {r("team_total", "team_total_diff_last_1", 9)}, {r("team_avg", "team_avg_diff_last_1", 9)},
           {r("miss", "diff_total_diff_last_1", 9)},
           {r("team_avg - avg_diff_last_1", "diff_avg_diff_last_1", 9)},
           {big("performance", "diff_performance")},
           {big("sum(performance) OVER (PARTITION BY playerid)", "diff_performance_sum")}
    FROM f_versus
    """,
)
cte(
    "f_versus_top",
    """
    SELECT playerid, CAST(sum(performance) AS BIGINT) AS diff_performance_sum
    FROM f_versus GROUP BY playerid ORDER BY 2 DESC, 1 LIMIT 10
    """,
)
oracle("team_minus_player_top10", "SELECT * FROM f_versus_top")
oracle(
    "team_minus_player_curve",
    f"""
    SELECT playerid, playername, matchid, teamid, {r("age", "age")},
           {big('''sum(performance) OVER (PARTITION BY playerid ORDER BY age, matchid, teamid
                   ROWS UNBOUNDED PRECEDING)''', "score")}
    FROM f_versus JOIN f_versus_top USING (playerid) JOIN f_profile USING (playerid)
    """,
)

# --- monthly ----------------------------------------------------------------------------------

_METRICS = [
    f"{kind}_{name}"
    for name in ("off", "ranked_off", "def", "ranked_def")
    for kind in ("total", "avg")
]
_OFFENSIVE = [m for m in _METRICS if m.endswith("off")]


def _month_aggs() -> str:
    return ", ".join(
        f"{'sum' if m.startswith('total') else 'avg'}({m}_last_1) AS {m}" for m in _METRICS
    )


def _out(m: str, expression: str | None = None) -> str:
    expression = expression or m
    return big(expression, m) if m == "total_def" else r(expression, m)


cte(
    "f_in_season",
    f"""
    SELECT * FROM f_results WHERE saison = '{p.SEASON}' AND tournament = '{p.TOURNAMENT}'
    """,
)
cte(
    "f_monthly",
    f"""
    SELECT playerid, CAST(date_trunc('month', target_match_timestamp) AS DATE) AS time,
           {_month_aggs()}, sum(playtime_last_1) AS playtime
    FROM f_in_season GROUP BY 1, 2
    """,
)


def _spine(source: str) -> str:
    return f"""
    SELECT make_date(y, m, 1) AS time
    FROM (SELECT DISTINCT y FROM (SELECT unnest(range(a, b + 1)) AS y FROM (
              SELECT min(year(target_match_timestamp)) AS a,
                     max(year(target_match_timestamp)) AS b FROM {source}))),
         (SELECT unnest(range(1, 13)) AS m)
    """


cte("f_spine", _spine("f_in_season"))
oracle(
    "monthly_player",
    f"""
    SELECT playerid, time, {", ".join(_out(m) for m in _METRICS)}, {big("playtime", "playtime")}
    FROM f_monthly
    """,
)
oracle("month_spine", "SELECT time FROM f_spine")
cte(
    "f_month_avg",
    f"""
    SELECT time, {", ".join(f"avg({m}) AS {m}" for m in _METRICS)} FROM f_monthly GROUP BY time
    """,
)
oracle(
    "monthly_average_player",
    f"""
    SELECT time, {", ".join(r(f"coalesce({m}, 0)", m) for m in _METRICS)}, 'avg' AS name
    FROM f_month_avg RIGHT JOIN f_spine USING (time)
    """,
)
_RANKED_METRICS = [m for m in _METRICS if "ranked" in m]
cte(
    "f_performance",
    f"""
    SELECT playerid, {", ".join(f"avg({m}) AS {m}" for m in _RANKED_METRICS)},
           sum(playtime) AS playtime
    FROM f_monthly GROUP BY playerid HAVING sum(playtime) >= 800
    """,
)
_performance_out = f"""
    SELECT playerid, {", ".join(r(m, m) for m in _RANKED_METRICS)}, {big("playtime", "playtime")}
"""
oracle("season_performance", f"{_performance_out} FROM f_performance")
for _short, _metric in p.BEST_METRICS.items():
    for _name, _order in (("best5", "DESC"), ("worst5", "ASC")):
        oracle(
            f"{_name}_{_short}",
            f"""
            {_performance_out} FROM (
                SELECT * FROM f_performance ORDER BY {_metric} {_order}, playerid LIMIT 5)
            """,
        )


def _series(metric: str, shift: str = "0") -> str:
    return f"""
    SELECT time, CAST(playerid AS VARCHAR) AS name,
           {r(f"coalesce(m.{metric} - {shift}, 0)", "points")}
    FROM f_monthly m RIGHT JOIN (
        SELECT time, playerid FROM f_spine, (
            SELECT playerid FROM f_performance ORDER BY {metric} DESC, playerid LIMIT 5))
    USING (time, playerid)
    UNION ALL
    SELECT time, 'avg', {r(f"coalesce({metric} - {shift}, 0)", "points")}
    FROM f_month_avg RIGHT JOIN f_spine USING (time)
    """


oracle("best5_series", _series("total_ranked_off"))
oracle("best5_series_avg_off", _series("avg_ranked_off"))
oracle(
    "def_series_shifted",
    _series("total_ranked_def", "(SELECT min(total_ranked_def) FROM f_performance)"),
)
oracle(
    "def_series_shifted_avg",
    _series("avg_ranked_def", "(SELECT min(avg_ranked_def) FROM f_performance)"),
)
_ids = ", ".join(str(i) for i in p.PLAYERS)
cte(
    "f_relevant",
    f"""
    SELECT DISTINCT tournament FROM f_results
    WHERE saison = '{p.SEASON}' AND playerid IN ({_ids})
    """,
)
oracle("relevant_tournaments", "SELECT tournament FROM f_relevant")
cte(
    "f_names",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in p.PLAYERS.items())
    + ") AS v(playerid, name)",
)
cte(
    "f_chosen",
    f"SELECT * FROM f_results JOIN f_names USING (playerid) WHERE saison = '{p.SEASON}'",
)
cte("f_chosen_spine", _spine("f_chosen"))
cte(
    "f_chosen_month",
    f"""
    SELECT name, CAST(date_trunc('month', target_match_timestamp) AS DATE) AS time, {_month_aggs()}
    FROM f_chosen GROUP BY 1, 2
    """,
)
cte(
    "f_peer_month",
    f"""
    SELECT playerid, CAST(date_trunc('month', target_match_timestamp) AS DATE) AS time,
           {_month_aggs()}
    FROM f_results JOIN f_relevant USING (tournament) WHERE saison = '{p.SEASON}' GROUP BY 1, 2
    """,
)
oracle(
    "chosen_player_series",
    f"""
    SELECT time, name, {", ".join(r(f"coalesce({m}, 0)", m) for m in _OFFENSIVE)}
    FROM f_chosen_month RIGHT JOIN (SELECT time, name FROM f_chosen_spine, f_names)
    USING (time, name)
    UNION ALL
    SELECT time, 'avg', {", ".join(r(f"coalesce({m}, 0)", m) for m in _OFFENSIVE)}
    FROM (SELECT time, {", ".join(f"avg({m}) AS {m}" for m in _OFFENSIVE)}
          FROM f_peer_month GROUP BY time)
    RIGHT JOIN f_chosen_spine USING (time)
    """,
)
oracle(
    "filtered_count",
    f"SELECT count(*) AS n FROM f_results WHERE playerid = 2 AND saison = '{p.SEASON}'",
)


def _running(targets: str) -> str:
    return f"""
    SELECT t.playerid, t.day AS target_match_timestamp,
           sum(h.total_ranked_off_last_1) AS total_ranked_off_last_1,
           sum(h.total_ranked_def_last_1) AS total_ranked_def_last_1
    FROM ({targets}) t JOIN f_results h
      ON t.playerid = h.playerid AND t.day >= h.target_match_timestamp
    GROUP BY t.playerid, t.day
    """


_target_days = (
    f"SELECT playerid, target_match_timestamp AS day FROM f_results WHERE playerid IN ({_ids})"
)
cte("f_running", _running(_target_days.replace("SELECT", "SELECT DISTINCT", 1)))
cte("f_running_compat", _running(_target_days))
for _suffix in ("", "_compat"):
    oracle(
        f"running_total{_suffix}",
        f"""
        SELECT playerid, target_match_timestamp,
               {r("total_ranked_off_last_1", "total_ranked_off_last_1")},
               {r("total_ranked_def_last_1", "total_ranked_def_last_1")}
        FROM f_running{_suffix}
        """,
    )
oracle(
    "running_total_yearly",
    f"""
    SELECT playerid, CAST(date_trunc('year', target_match_timestamp) AS DATE) AS time,
           {r("max(total_ranked_off_last_1)", "total_ranked_off_last_1")},
           {r("min(total_ranked_def_last_1)", "total_ranked_def_last_1")}
    FROM f_running GROUP BY 1, 2
    """,
)
cte(
    "f_member",
    f"""
    SELECT DISTINCT playerid FROM f_results
    WHERE saison = '{p.SEASON}' AND tournament IN ({quoted(p.MEMBER_TOURNAMENTS)})
    """,
)
cte(
    "f_target_month",
    f"""
    SELECT playerid, playername,
           CAST(date_trunc('month', target_match_timestamp) AS DATE) AS time,
           sum(playtime_last_1) AS playtime, sum(total_diff_last_1) AS total_diff,
           avg(avg_diff_last_1) AS avg_diff, avg(avg_off_last_1) AS avg_off,
           avg(avg_def_last_1) AS avg_def
    FROM f_results JOIN f_profile USING (playerid) JOIN f_member USING (playerid)
    WHERE saison IN ({quoted(p.TARGET_SEASONS)}) GROUP BY 1, 2, 3
    """,
)


def _topn(metric: str) -> str:
    aggregate = "avg" if metric.startswith("avg") else "sum"
    return f"""
    SELECT place, playerid, playername, time,
           sum(coalesce({metric}, 0)) OVER (PARTITION BY playerid ORDER BY time
                                            ROWS UNBOUNDED PRECEDING) AS points
    FROM (
        SELECT * FROM (
            SELECT playerid, row_number() OVER (ORDER BY overall DESC, playerid) AS place FROM (
                SELECT playerid, {aggregate}({metric}) AS overall FROM f_target_month
                GROUP BY playerid HAVING sum(playtime) > 2000 * 2)
            QUALIFY place <= 10) l
        JOIN (SELECT playerid, any_value(playername) AS playername FROM f_profile
              GROUP BY playerid) USING (playerid),
        (SELECT DISTINCT time FROM f_target_month WHERE playerid IN (
            SELECT playerid FROM (
                SELECT playerid, {aggregate}({metric}) AS overall FROM f_target_month
                GROUP BY playerid HAVING sum(playtime) > 2000 * 2
                ORDER BY overall DESC, playerid LIMIT 10)))) d
    LEFT JOIN (SELECT playerid, time, {metric} FROM f_target_month) USING (playerid, time)
    """


for _name, _metric in (
    ("topn_cumulative", "total_diff"),
    ("topn_cumulative_avg_diff", "avg_diff"),
    ("topn_cumulative_avg_off", "avg_off"),
    ("topn_cumulative_avg_def", "avg_def"),
):
    oracle(
        _name,
        f"""
        SELECT place, playerid, playername, time, {r("points", "points")} FROM ({_topn(_metric)})
        """,
    )
oracle(
    "topn_pivot",
    "SELECT time, "
    + ", ".join(r(f"max(points) FILTER (place = {i})", f"place_{i}") for i in range(1, 11))
    + f" FROM ({_topn('total_diff')}) GROUP BY time",
)

# --- leagues, trainers, graph -----------------------------------------------------------------

oracle(
    "league_strength",
    f"""
    SELECT tournament, saison, {r("avg(mean)", "mean")} FROM (
        SELECT *, row_number() OVER (PARTITION BY tournament, saison ORDER BY mean DESC) AS rank
        FROM (SELECT saison, teamid, avg(avg_off_last_1) AS mean FROM f_results GROUP BY ALL)
        JOIN (SELECT tournament, saison, hometeam AS teamid FROM f_match
              UNION SELECT tournament, saison, guestteam FROM f_match) USING (saison, teamid))
    WHERE rank <= 5 GROUP BY tournament, saison
    """,
)
cte("f_goals", "SELECT teamid, matchid, count(*) AS n FROM f_goal GROUP BY ALL")


def _match_points(join: str) -> str:
    season = "CAST(m.saison AS BIGINT)"
    return f"""
    SELECT matchid, saison, tournament, country, refereeid, hometeam AS teamid,
           CASE WHEN h > g THEN 3 WHEN h < g THEN 0 ELSE 1 END AS score
    FROM (SELECT m.* EXCLUDE (saison), {season} AS saison, coalesce(a.n, 0) AS h,
                 coalesce(b.n, 0) AS g
          FROM f_match m {join} JOIN f_goals a ON a.teamid = hometeam AND a.matchid = m.matchid
          {join} JOIN f_goals b ON b.teamid = guestteam AND b.matchid = m.matchid)
    WHERE saison >= {p.POINTS_SINCE} AND saison < {p.POINTS_UNTIL}
    UNION ALL
    SELECT matchid, saison, tournament, country, refereeid, guestteam,
           CASE WHEN g > h THEN 3 WHEN g < h THEN 0 ELSE 1 END
    FROM (SELECT m.* EXCLUDE (saison), {season} AS saison, coalesce(a.n, 0) AS h,
                 coalesce(b.n, 0) AS g
          FROM f_match m {join} JOIN f_goals a ON a.teamid = hometeam AND a.matchid = m.matchid
          {join} JOIN f_goals b ON b.teamid = guestteam AND b.matchid = m.matchid)
    WHERE saison >= {p.POINTS_SINCE} AND saison < {p.POINTS_UNTIL}
    """


cte("f_match_points", _match_points("LEFT"))
cte("f_match_points_compat", _match_points("INNER"))


def _trainer(points: str, listed_on: str) -> str:
    recent = (
        f"SELECT * FROM {points} WHERE saison >= {p.TRAINER_SINCE} "
        f"AND tournament = '{p.TOURNAMENT}'"
    )
    return f"""
    SELECT trainer, trainername, teamid, {r("team_mean", "team_mean")},
           {r("avg(trainer_mean - team_mean)", "trainer_team_diffs")},
           {big("sum(trainer_match_count)", "trainer_match_counts")}
    FROM (SELECT teamid, avg(score) AS team_mean FROM {points} GROUP BY teamid)
    JOIN (SELECT trainer, s.teamid, trainername, avg(score) AS trainer_mean,
                 count(*) AS trainer_match_count
          FROM {points} s JOIN (SELECT DISTINCT * FROM f_trainer) t
            ON t.team = s.teamid AND t.match = s.matchid
          JOIN f_trainer_name USING (trainer)
          WHERE s.saison >= {p.TRAINER_SINCE} AND s.teamid IN (SELECT teamid FROM ({recent}))
          GROUP BY ALL) USING (teamid)
    WHERE trainer IN (SELECT trainer FROM ({recent}) q JOIN f_trainer t
                      ON t.match = q.matchid {listed_on})
    GROUP BY trainer, trainername, teamid, team_mean
    """


for _suffix, _on in (("", "AND t.team = q.teamid"), ("_compat", "")):
    oracle(
        f"match_points{_suffix}",
        f"""
        SELECT matchid, saison, tournament, country, refereeid, teamid, {big("score", "score")}
        FROM f_match_points{_suffix}
        """,
    )
    oracle(f"trainer_effect{_suffix}", _trainer(f"f_match_points{_suffix}", _on))

cte(
    "f_present",
    f"""
    SELECT playerid, matchid, teamid, matchday FROM f_time JOIN f_match USING (matchid)
    WHERE matchday >= DATE '{p.GRAPH_SINCE}' AND country IN ({quoted(p.GRAPH_COUNTRIES)})
    """,
)
cte(
    "f_node",
    """
    SELECT playerid AS id, playername AS label, nationality, position, teamname
    FROM f_profile JOIN (
        SELECT playerid, teamid FROM (
            SELECT *, max(matchday) OVER (PARTITION BY playerid) AS newest FROM f_present)
        WHERE matchday = newest) USING (playerid)
    JOIN f_team USING (teamid)
    """,
)
cte(
    "f_edge",
    """
    SELECT a.playerid AS source, b.playerid AS target
    FROM f_present a JOIN f_present b
      ON a.matchid = b.matchid AND a.teamid = b.teamid AND a.playerid <> b.playerid
    WHERE a.playerid IN (SELECT id FROM f_node) AND b.playerid IN (SELECT id FROM f_node)
    """,
)
oracle("coplay_nodes", "SELECT * FROM f_node")
oracle("coplay_export", "SELECT * FROM f_node")
oracle("coplay_edges", "SELECT * FROM f_edge")
oracle("coplay_export_edges", "SELECT * FROM f_edge")
oracle(
    "coplay_edges_compat",
    "SELECT source, target FROM f_edge JOIN f_node a ON a.id = source JOIN f_node b ON b.id = target",
)
oracle(
    "coplay_edges_weighted",
    "SELECT source, target, count(*) AS weight FROM f_edge GROUP BY source, target",
)

# --- goal model -------------------------------------------------------------------------------

cte(
    "f_goal_table",
    """
    SELECT matchid, matchday, saison, matchlength, teamid, opponent, is_home,
           CAST(max(goals) AS BIGINT) AS goals FROM (
        SELECT m.matchid, matchday, saison, matchlength, teamid,
               CASE WHEN teamid = hometeam THEN guestteam ELSE hometeam END AS opponent,
               teamid = hometeam AS is_home, count(*) AS goals
        FROM f_match m JOIN f_goal USING (matchid) GROUP BY ALL
        UNION ALL
        SELECT matchid, matchday, saison, matchlength, hometeam, guestteam, true, 0 FROM f_match
        UNION ALL
        SELECT matchid, matchday, saison, matchlength, guestteam, hometeam, false, 0 FROM f_match)
    GROUP BY ALL
    """,
)
oracle(
    "team_goal_table",
    f"SELECT * EXCLUDE (matchlength), {big('matchlength', 'matchlength')} FROM f_goal_table",
)
oracle(
    "matches_by_year",
    f"""
    SELECT year(matchday) AS year, count(*) AS matches FROM f_match
    WHERE year(matchday) >= {p.FEATURES_SINCE} GROUP BY 1
    """,
)
cte(
    "f_lineup",
    f"""
    SELECT matchid, matchday, playerid, teamid FROM f_player JOIN f_match USING (matchid)
    WHERE year(matchday) >= {p.FEATURES_SINCE}
    """,
)
_attrs = ", ".join(f"s.{a}" for a in ATTRS)
cte(
    "f_asof",
    f"""
    SELECT l.matchid, l.teamid, l.playerid, s.target_match_timestamp AS score_day, {_attrs}
    FROM f_lineup l JOIN f_scores s
      ON s.teamid = l.teamid AND s.playerid = l.playerid
     AND s.target_match_timestamp < l.matchday
    QUALIFY row_number() OVER (PARTITION BY l.matchid, l.teamid, l.playerid
                               ORDER BY s.target_match_timestamp DESC, s.matchid DESC) = 1
    """,
)


def _attribute_out(prefix: str = "") -> str:
    whole = ("playtime_", "total_def")
    return ", ".join(
        (big if a.startswith(whole) else r)(f"{prefix}{a}", f"{prefix}{a}") for a in ATTRS
    )


oracle(
    "asof_scores",
    f"SELECT matchid, teamid, playerid, score_day, {_attribute_out()} FROM f_asof",
)
cte(
    "f_two_days",
    """
    SELECT teamid, playerid, max(day) FILTER (rank = 1) AS day1, max(n) FILTER (rank = 1) AS n1,
           max(scored_in) FILTER (rank = 1) AS in1, max(day) FILTER (rank = 2) AS day2
    FROM (SELECT teamid, playerid, target_match_timestamp AS day, count(*) AS n, max(matchid) AS scored_in,
                 row_number() OVER (PARTITION BY teamid, playerid ORDER BY target_match_timestamp DESC) AS rank
          FROM f_scores GROUP BY teamid, playerid, target_match_timestamp)
    WHERE rank <= 2 GROUP BY teamid, playerid
    """,
)
oracle(
    "asof_scores_compat",
    f"""
    -- The latest day outside the match is one of the two latest days of player and team.
    SELECT q.matchid, q.teamid, q.playerid, q.score_day, {_attribute_out()}
    FROM (SELECT matchid, teamid, playerid, day1 IS NULL AS unknown,
                 CASE WHEN n1 > 1 OR in1 <> matchid THEN day1 ELSE day2 END AS score_day
          FROM f_lineup LEFT JOIN f_two_days USING (teamid, playerid)) q
    LEFT JOIN f_scores s
      ON s.teamid = q.teamid AND s.playerid = q.playerid AND s.target_match_timestamp = q.score_day
    WHERE q.unknown OR q.score_day IS NOT NULL
    """,
)
cte(
    "f_strength",
    "SELECT a.matchid, a.teamid, sum(t.playtime) AS playtime, "
    + ", ".join(f"sum(a.{x} * t.playtime) AS {x}" for x in ATTRS)
    + " FROM f_asof a LEFT JOIN (SELECT matchid, playerid, sum(playtime) AS playtime FROM f_time"
    " GROUP BY ALL) t USING (matchid, playerid) GROUP BY a.matchid, a.teamid",
)
oracle(
    "team_strength",
    f"SELECT matchid, teamid, {big('playtime', 'playtime')}, {_attribute_out()} FROM f_strength",
)
_opponent = ", ".join(f"{c} AS opponent_{c}" for c in ("playtime", *ATTRS))
cte(
    "f_feature",
    f"""
    SELECT *, year(matchday) AS year, month(matchday) AS month, day(matchday) AS day
    FROM f_goal_table JOIN f_strength USING (matchid, teamid)
    JOIN (SELECT matchid, teamid AS opponent, {_opponent} FROM f_strength)
    USING (matchid, opponent)
    """,
)
# The same for many X, neutral and ranked, over the season.
_names = ("off", "def", "diff", *_RANKED)
cte("f_wide", _windowed("f_ranked", "playerid, saison", WIDE_XS, _names))
cte(
    "f_asof_wide",
    f"""
    SELECT l.matchid, l.teamid, l.playerid, {", ".join(f"s.{a}" for a in WIDE_ATTRIBUTES)}
    FROM f_lineup l ASOF JOIN (SELECT * EXCLUDE (matchid), matchid AS scored_in FROM f_wide
         QUALIFY row_number() OVER (PARTITION BY teamid, playerid, target_match_timestamp
                                    ORDER BY scored_in DESC) = 1) s
      ON s.teamid = l.teamid AND s.playerid = l.playerid AND s.target_match_timestamp < l.matchday
    """,
)
cte(
    "f_strength_wide",
    "SELECT a.matchid, a.teamid, sum(t.playtime) AS playtime, "
    + ", ".join(f"sum(a.{x} * t.playtime) AS {x}" for x in WIDE_ATTRIBUTES)
    + " FROM f_asof_wide a LEFT JOIN (SELECT matchid, playerid, sum(playtime) AS playtime FROM f_time"
    " GROUP BY ALL) t USING (matchid, playerid) GROUP BY a.matchid, a.teamid",
)
oracle(
    "team_strength_wide",
    f"SELECT matchid, teamid, {big('playtime', 'playtime')}, "
    + ", ".join(r(f"CAST({a} AS DOUBLE) + {p.TIES['team_strength_wide']}", a) for a in WIDE_ATTRIBUTES)
    + " FROM f_strength_wide",
)
_other = ", ".join(f"{c} AS opponent_{c}" for c in ("playtime", *WIDE_ATTRIBUTES))
oracle(
    "match_features_wide",
    f"""
    SELECT matchid, teamid, opponent, matchday, saison, {big("matchlength", "matchlength")}, is_home, goals,
           year(matchday) AS year, month(matchday) AS month, day(matchday) AS day,
           {big("playtime", "playtime")}, {big("opponent_playtime", "opponent_playtime")}, """
    + ", ".join(
        r(f"CAST({o}{a} AS DOUBLE) / matchlength + {p.TIES['match_features_wide']}", f"{o}{a}")
        for o in ("", "opponent_")
        for a in WIDE_ATTRIBUTES
    )
    + f"""
    FROM f_goal_table JOIN f_strength_wide USING (matchid, teamid)
    JOIN (SELECT matchid, teamid AS opponent, {_other} FROM f_strength_wide) USING (matchid, opponent)
    WHERE """
    + " AND ".join(f"{o}{a} IS NOT NULL" for o in ("", "opponent_") for a in ("playtime", *WIDE_ATTRIBUTES)),
)
_feature_base = f"""
    saison, {big("matchlength", "matchlength")}, is_home, goals, year, month, day,
    {big("playtime", "playtime")}, {big("opponent_playtime", "opponent_playtime")}
"""
oracle(
    "match_features",
    f"""
    SELECT matchid, matchday, teamid, opponent, {_feature_base}, {_attribute_out()},
           {_attribute_out("opponent_")} FROM f_feature
    """,
)
oracle(
    "match_features_norm",
    f"SELECT {_feature_base}, "
    + ", ".join(
        r(f"CAST({o}{a} AS DOUBLE) / matchlength", f"{o}{a}") for o in ("", "opponent_") for a in ATTRS
    )
    + " FROM f_feature",
)
oracle(
    "train_split",
    f"""
    SELECT matchid, teamid, goals, {big("matchlength", "matchlength")}, place < 100 AS is_test,
           place >= 100 AND place < 200 AS is_valid
    FROM (SELECT *, (matchid % 1000003 * 7919 + 123) % 1000 AS place FROM f_feature)
    """,
)
oracle(
    "train_split_compat",
    f"""
    SELECT matchid, teamid, goals, {big("matchlength", "matchlength")},
           (matchid % 1000003 * 7919 + teamid % 1009 * 104729 + 123) % 1000 < 100 AS is_test
    FROM f_feature
    """,
)

cte(
    "f_split",
    """
    SELECT *, (matchid % 1000003 * 7919 + 123) % 1000 AS place,
           CASE WHEN (matchid % 1000003 * 7919 + 123) % 1000 < 100 THEN 'test'
                WHEN (matchid % 1000003 * 7919 + 123) % 1000 < 200 THEN 'valid' ELSE 'train' END AS part
    FROM f_feature
    """,
)
_scaled = {f"{o}{a}": f"CAST({o}{a} AS DOUBLE) / matchlength" for o in ("", "opponent_") for a in ATTRS}
_inputs = {c: f"CAST({c} AS DOUBLE)" for c in ("is_home", "matchlength", "playtime", "opponent_playtime", "year", "month", "day")}
_inputs = {"saison": r"try_cast(regexp_extract(saison, '\d{4}') AS DOUBLE)"} | _inputs | _scaled
oracle(
    "train_imputed",
    "SELECT matchid, teamid, CAST(goals AS DOUBLE) AS goals, part = 'test' AS is_test, part = 'valid' AS is_valid, "
    + ", ".join(
        r(f"coalesce({v}, (SELECT avg({v}) FROM f_split WHERE part = 'train'))", c) for c, v in _inputs.items()
    )
    + " FROM f_split",
)
cte(
    "f_mean",
    """
    SELECT matchid, teamid, CAST(goals AS DOUBLE) AS goals,
           (SELECT avg(goals) FROM f_split WHERE part = 'train') AS prediction
    FROM f_split WHERE part = 'test'
    """,
)
oracle(
    "mean_predictions",
    f"SELECT matchid, teamid, goals, {r('prediction', 'prediction')}, "
    "round(prediction, 0) AS prediction_rounded FROM f_mean",
)
oracle(
    "mean_errors",
    f"""
    SELECT {r("avg(abs(prediction - goals))", "mae")}, {r("avg((prediction - goals) ** 2)", "mse")},
           {r("1 - avg((prediction - goals) ** 2) / var_pop(goals)", "r2")}, count(*) AS n
    FROM f_mean
    """,
)


def _needed(sql: str) -> list[str]:
    """CTEs that ``sql`` uses, directly or not, in the order they were declared."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        for name in set(re.findall(r"\bf_\w+", queue.pop())) & set(CTES):
            if name not in found:
                found.add(name)
                queue.append(CTES[name])
    return [name for name in CTES if name in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in ORACLES.items():
        ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _needed(sql))
        out[name] = f"WITH {ctes}\n{sql}" if ctes else sql
    return out
