"""Raw CSV dumps: one folder per table, a header, every value text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlens.functions.scalars import minute_of_text, number_of_text, parse_day
from pitchlens.schema import CSV_COLUMNS, CSV_FOLDERS, OPTIONAL, SCHEMAS, Tables

# Tables whose dumps are known to repeat rows.
_DEDUPED = ("team", "trainer", "trainer_name")


def _typed(raw: str, wanted: T.StructField) -> Column:
    text = F.col(f"`{raw}`")
    match wanted.dataType:
        case T.DateType():
            typed = parse_day(text)
        case T.IntegerType():
            typed = minute_of_text(text)
        case T.LongType():
            typed = number_of_text(text)
        case T.BooleanType():
            typed = text.try_cast("boolean")
        case _:
            typed = text
    return typed.alias(wanted.name)


#: Column of a raw row with the whole line, if it has too few or too many values.
_BROKEN = "_broken_line"


def _raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a dump as text. The header names the columns; lines that do not fit it are marked."""
    files = f"{folder}/{CSV_FOLDERS[table]}/*.csv"
    header = spark.read.option("header", True).csv(files).schema
    schema = T.StructType([*header.fields, T.StructField(_BROKEN, T.StringType())])
    reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", _BROKEN).schema(schema)
    return reader.csv(files)


def _known(raw: DataFrame, table: str) -> dict[str, str]:
    """Raw to canonical names of the columns that a dump has."""
    return {raw_name: name for raw_name, name in CSV_COLUMNS[table].items() if raw_name in raw.columns}


def read_csv_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a dump in canonical names and types. Values that do not parse are NULL.

    Columns are matched by the names in the header, which may come in any order. What was not
    understood is listed by ``csv_rejects``.
    """
    raw = _raw(spark, folder, table)
    by_name = {field.name: field for field in SCHEMAS[table].fields}
    typed = raw.select(*[_typed(raw_name, by_name[name]) for raw_name, name in _known(raw, table).items()])
    return typed.dropDuplicates() if table in _DEDUPED else typed


def csv_rejects(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """What ``read_csv_table`` did not understand: ``name`` (of the table), ``file``, ``column``, ``text``.

    A row per value that is there, is not blank and did not parse, and one per line with too few or
    too many values (its column is empty, its text the whole line). Lazy like the table itself.
    """
    raw = _raw(spark, folder, table)
    by_name = {field.name: field for field in SCHEMAS[table].fields}
    found = []
    for raw_name, name in _known(raw, table).items():
        text = F.col(f"`{raw_name}`")
        bad = (F.trim(text) != "") & _typed(raw_name, by_name[name]).isNull()
        found.append(F.when(bad, F.struct(F.lit(name).alias("column"), text.alias("text"))))
    whole = F.struct(F.lit("").alias("column"), F.col(_BROKEN).alias("text"))
    found.append(F.when(F.col(_BROKEN).isNotNull(), whole))
    listed = raw.select(
        F.lit(table).alias("name"),
        F.col("_metadata.file_path").alias("file"),
        F.explode(F.filter(F.array(*found), lambda r: r.isNotNull())).alias("_reject"),
    )
    return listed.select("name", "file", "_reject.column", "_reject.text")


def write_rejects(spark: SparkSession, folder: str, path: str) -> None:
    """All rejects of a dump as parquet, next to what was loaded from it."""
    parts = [csv_rejects(spark, folder, name) for name in Tables.names() if _has(spark, folder, name)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows.write.mode("overwrite").parquet(path)


def _has(spark: SparkSession, folder: str, name: str) -> bool:
    return name not in OPTIONAL or _exists(spark, f"{folder}/{CSV_FOLDERS[name]}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_csv_tables(spark: SparkSession, folder: str) -> Tables:
    """All tables of a dump. Referees, trainers and their names may be absent."""
    wanted = [name for name in Tables.names() if _has(spark, folder, name)]
    return Tables(**{name: read_csv_table(spark, folder, name) for name in wanted})


def _as_text(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.date_format(column, "dd.MM.yyyy")
    return column.cast("string")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, for tools outside Spark (such as the co-play edge and node lists)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def as_text(df: DataFrame, table: str) -> DataFrame:
    """A canonical table in the columns and the spelling of a raw dump."""
    back = {canonical: raw for raw, canonical in CSV_COLUMNS[table].items()}
    return df.select(*[_as_text(f).alias(back[f.name]) for f in df.schema.fields])


def write_csv_tables(tables: Tables, folder: str) -> None:
    """Write a data set as a raw dump in the spelling that ``read_csv_tables`` reads."""
    for name in Tables.names():
        df = getattr(tables, name)
        if df is not None:
            write_csv(as_text(df, name), f"{folder}/{CSV_FOLDERS[name]}")
