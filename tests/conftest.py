import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitchlens.schema import SCHEMAS, Tables  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_tables(spark):
    """Build Tables from short rows; tables that are not given are empty.

    A match may be given as (id, day, home, guest) or with its length as fifth value.
    """

    def frame(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    def build(**given) -> Tables:
        matches = []
        for row in given.pop("match", []):
            matchid, day, home, guest, *rest = row
            length = rest[0] if rest else 90
            matches.append(
                (matchid, day, str(day.year), "L1", "F", None, length, home, guest, None)
            )
        rows = {name: given.get(name, []) for name in Tables.names()}
        rows["goal"] = [(*g, None, False) if len(g) == 4 else g for g in rows["goal"]]
        rows["match"] = matches
        return Tables(**{name: frame(name, rows[name]) for name in Tables.names()})

    return build


def day(n: int) -> datetime.date:
    return datetime.date(2018, 3, 1) + datetime.timedelta(days=n)


def as_set(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows)), "repeated rows"
    return set(rows)
