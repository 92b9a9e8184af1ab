from pitchlens.sources.adapter import tables_from_orders
from pitchlens.sources.csv_files import read_csv_tables, write_csv, write_csv_tables
from pitchlens.sources.jdbc import read_jdbc_tables, write_jdbc
from pitchlens.sources.parquet import read_scores, write_parquet

__all__ = [
    "read_csv_tables",
    "read_jdbc_tables",
    "read_scores",
    "tables_from_orders",
    "write_csv",
    "write_csv_tables",
    "write_jdbc",
    "write_parquet",
]
