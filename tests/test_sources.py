import datetime
import os

import pytest
from conftest import as_set, day
from pyspark.sql import functions as F

from pitchlens import staging
from pitchlens.functions import scalars
from pitchlens.schema import SCHEMAS
from pitchlens.sources import csv_files, jdbc


def test_lenient_parsing(spark):
    df = spark.createDataFrame(
        [("3.4.2018",), ("03.04.2018",), ("n/a",), ("45+2",), ("45",), (None,)], "t string"
    )
    april = datetime.date(2018, 4, 3)
    got = df.select("t", scalars.parse_day("t"), scalars.minute_of_text("t")).collect()
    assert [tuple(r) for r in got] == [
        ("3.4.2018", april, None),
        ("03.04.2018", april, None),
        ("n/a", None, None),
        ("45+2", None, None),
        ("45", None, 45),
        (None, None, None),
    ]


def test_ids_come_as_whole_numbers_or_decimals(spark):
    texts = ["12", "12.0", " 12. ", "-7.000", "9007199254740993", "9223372036854775807.0", "12.7", "12.0000001",
             "9223372036854775808", "1e3", "x", "", "NaN", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [12, 12, 12, -7, 2**53 + 1, 2**63 - 1] + [None] * 8
    assert [r[0] for r in df.select(scalars.number_of_text("t")).collect()] == want


def test_large_ids_come_back_from_a_dump(spark, make_tables, tmp_path):
    ids = [2**53 + 1, 2**53, 2**63 - 1]
    tables = make_tables(match=[(m, day(0), 10, 20) for m in ids], player=[(m - 2, m, 10) for m in ids])
    csv_files.write_csv_tables(tables, str(tmp_path))
    loaded = csv_files.read_csv_tables(spark, str(tmp_path))
    assert as_set(loaded.player, "playerid", "matchid") == {(m - 2, m) for m in ids}


def test_rejects_name_what_was_not_understood(spark, tmp_path):
    for name in ("substitution", "goal"):
        (tmp_path / name).mkdir()
    (tmp_path / "substitution" / "a.csv").write_text(
        ":time,:match,:team,:in,:out\n45+2,1,10,3,4\n50,1,10,x,4\n60,1,10,5,6\n ,2,10,7,8\n70,3,10\n71,4,10,1,2,99\n"
    )
    (tmp_path / "goal" / "a.csv").write_text(":match,:team,:time,:own-goal?\n1,10,5,yes\n1,10,6,maybe\n2.5,10,7,\n")
    rows = csv_files.read_csv_table(spark, str(tmp_path), "substitution")
    assert rows.count() == 6 and rows.filter("time is null").count() == 2
    got = csv_files.csv_rejects(spark, str(tmp_path), "substitution")
    assert {r.file.rsplit("/", 1)[1] for r in got.collect()} == {"a.csv"}
    assert as_set(got, "name", "column", "text") == {
        ("substitution", "time", "45+2"),
        ("substitution", "playerin", "x"),
        ("substitution", "", "70,3,10"),
        ("substitution", "", "71,4,10,1,2,99"),
    }
    got = csv_files.csv_rejects(spark, str(tmp_path), "goal")
    assert as_set(got, "column", "text") == {("own_goal", "maybe"), ("matchid", "2.5")}


def test_slices_have_equal_rows_and_cover_all(spark):
    dense = [(i,) for i in range(3000)] + [(10**9 + 10**6 * i,) for i in range(1000)] + [(None,)] * 7
    ids = spark.createDataFrame(dense, "matchid long")
    bounds = jdbc.slice_bounds(ids, "matchid", 8)
    assert len(bounds) == 7
    counts = [ids.filter(p).count() for p in jdbc.slice_predicates("matchid", bounds)]
    assert sum(counts) == len(dense) and all(abs(c - 500) <= 12 for c in counts)
    one = spark.createDataFrame([(5,)] * 900 + [(i,) for i in range(100)], "matchid long")
    bounds = jdbc.slice_bounds(one, "matchid", 4)
    counts = [one.filter(p).count() for p in jdbc.slice_predicates("matchid", bounds)]
    assert sum(counts) == 1000 and len(counts) <= 4
    empty = jdbc.slice_bounds(ids.limit(0), "matchid", 4)
    assert empty == [] and jdbc.slice_predicates("matchid", empty) == ["1 = 1"]
    assert jdbc.slice_bounds(ids, "matchid", 1) == []


def test_csv_round_trip(spark, make_tables, tmp_path):
    tables = make_tables(
        match=[(1, day(0), 10, 20)],
        player=[(1, 1, 10)],
        substitution=[(1, 10, 3, 1, None)],
        goal=[(1, 10, 60, None, None, True)],
        team=[(10, "A"), (10, "A")],
        profile=[(1, "Ä, \"b\"", datetime.date(1990, 1, 2), "x", None)],
    )
    csv_files.write_csv_tables(tables, str(tmp_path))
    loaded = csv_files.read_csv_tables(spark, str(tmp_path))
    for name in ("match", "player", "substitution", "goal", "profile"):
        expected = [tuple(r) for r in getattr(tables, name).collect()]
        got = getattr(loaded, name)
        assert got.schema == SCHEMAS[name]
        assert [tuple(r) for r in got.collect()] == expected
    assert as_set(loaded.team, "teamid", "teamname") == {(10, "A")}


def test_dump_with_the_seven_tables(spark, make_tables, tmp_path):
    tables = make_tables(match=[(1, day(0), 10, 20)], player=[(1, 1, 10)])
    tables.referee = tables.trainer = tables.trainer_name = None
    csv_files.write_csv_tables(tables, str(tmp_path))
    loaded = csv_files.read_csv_tables(spark, str(tmp_path))
    assert loaded.referee is None and loaded.trainer is None and loaded.trainer_name is None
    assert loaded.player.count() == loaded.match.count() == 1


def test_jdbc_asks_for_the_ends_of_its_slices():
    assert jdbc.range_query("goal") == "SELECT min(matchid) AS low, max(matchid) AS high FROM goal"


def test_local_folders_are_refused_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Cluster)


def test_stored_tables_can_be_discarded(spark):
    first = staging.stage(spark.range(3), "kept")
    second = staging.stage(spark.range(3).withColumn("s", F.lit("a")), "kept", ("s",))
    assert second.columns == ["id", "s"] and second.count() == 3
    path = first.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    staging.discard(first)
    assert not os.path.exists(path) and second.count() == 3


def test_jdbc_reads_large_tables_in_slices():
    ids = {"matchid": (1, 900)}
    sliced = jdbc.jdbc_options("goal", "jdbc:x", "u", "p", 8, ids)
    assert sliced["partitionColumn"] == "matchid" and sliced["numPartitions"] == "8"
    assert (sliced["lowerBound"], sliced["upperBound"]) == ("1", "900")
    assert "numPartitions" not in jdbc.jdbc_options("team", "jdbc:x", "u", "p", 8, ids)
