"""Tables in a relational database, read in parallel slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.schema import OPTIONAL, SCHEMAS, Tables

# The numeric column each table is sliced by.
SLICE_COLUMNS: dict[str, str] = {
    "match": "matchid",
    "player": "matchid",
    "substitution": "matchid",
    "card": "matchid",
    "goal": "matchid",
    "profile": "playerid",
    "trainer": "match",
}


def jdbc_options(
    table: str, url: str, user: str, password: str, slices: int = 1, id_range=None
) -> dict[str, str]:
    """Reader options for one table; sliced when it is a large one and an id range is known."""
    options = {"url": url, "dbtable": table, "user": user, "password": password}
    column = SLICE_COLUMNS.get(table)
    if slices > 1 and column and id_range and column in id_range:
        low, high = id_range[column]
        options |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(slices),
        }
    return options


def range_query(table: str) -> str:
    """SQL for the lowest and highest id of the column that a table is sliced by."""
    column = SLICE_COLUMNS[table]
    return f"SELECT min({column}) AS low, max({column}) AS high FROM {table}"


def slice_bounds(ids: DataFrame, column: str, slices: int) -> list[int]:
    """Upper ends of slices with about equal numbers of rows, the last slice being open; ids grow.

    Quantiles over all rows, by a sketch that is merged over tasks: at most a thousandth of a slice's
    rows off. Ids that hold more rows than a slice end it, so there may be fewer slices.
    """
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return []
    accuracy = 1000 * slices
    found = ids.agg(F.percentile_approx(column, shares, accuracy).alias("ends")).first().ends
    return sorted({int(e) for e in found or [] if e is not None})


def slice_predicates(column: str, bounds: Sequence[int]) -> list[str]:
    """Conditions of the slices: every row falls under exactly one of them, rows without id under the first."""
    if not bounds:
        return ["1 = 1"]
    first = f"{column} <= {bounds[0]} OR {column} IS NULL"
    between = [f"{column} > {low} AND {column} <= {high}" for low, high in zip(bounds, bounds[1:])]
    return [first, *between, f"{column} > {bounds[-1]}"]


def read_jdbc_sliced(
    spark: SparkSession, table: str, url: str, user: str, password: str, slices: int
) -> DataFrame:
    """A table read in slices of equal numbers of rows, however dense its ids are at one end.

    The ids alone are read first, in slices of equal width, to find the ends.
    """
    column = SLICE_COLUMNS[table]
    access = {"url": url, "user": user, "password": password}
    ends = spark.read.format("jdbc").options(**access, query=range_query(table)).load().first()
    known = {} if ends[0] is None else {column: (int(ends[0]), int(ends[1]))}
    options = jdbc_options(table, url, user, password, slices, known)
    options["dbtable"] = f"(SELECT {column} FROM {table}) ids"
    bounds = slice_bounds(spark.read.format("jdbc").options(**options).load(), column, slices)
    return spark.read.jdbc(
        url, table, predicates=slice_predicates(column, bounds), properties={"user": user, "password": password}
    )


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    user: str,
    password: str,
    slices: int = 1,
    id_range: dict[str, tuple[int, int]] | None = None,
    tables: Sequence[str] | None = None,
    equal_rows: bool = False,
) -> Tables:
    """The tables of a database, by default the seven that every one has.

    ``tables`` names them where there are more: referee, trainer and trainer_name are optional. Large
    tables are read in ``slices`` at once; where ``id_range`` (slice column to lowest and highest id)
    does not say how, the database is asked for both ends. Slices have equal widths, or with
    ``equal_rows`` equal numbers of rows, for which the ids are read beforehand.
    """

    def read(options: dict[str, str]) -> DataFrame:
        return spark.read.format("jdbc").options(**options).load()

    loaded = {}
    for table in tables or [name for name in Tables.names() if name not in OPTIONAL]:
        ends = dict(id_range or {})
        column = SLICE_COLUMNS.get(table)
        if slices > 1 and column and column not in ends:
            access = {"url": url, "user": user, "password": password}
            found = read(access | {"query": range_query(table)}).first()
            if found[0] is not None:
                ends[column] = (int(found[0]), int(found[1]))
        if equal_rows and slices > 1 and column:
            df = read_jdbc_sliced(spark, table, url, user, password, slices)
        else:
            df = read(jdbc_options(table, url, user, password, slices, ends))
        known = [f for f in SCHEMAS[table].fields if f.name in df.columns]
        loaded[table] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in known])
    return Tables(**loaded)


def write_jdbc(df: DataFrame, table: str, url: str, user: str, password: str) -> None:
    """Replace ``table``; one connection per partition of ``df``."""
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, user=user, password=password)
        .mode("overwrite")
        .save()
    )
