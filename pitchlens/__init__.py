"""Player impact analytics for football, written as Spark DataFrame jobs."""

from pitchlens.schema import Tables

__all__ = ["Tables"]
