"""User functions, aggregations and procedures: SQL functions, which stay in the engine, and grouped pandas functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def scalar(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """Registers a function of the session, e.g. ("area", "r DOUBLE", "DOUBLE", "pi() * r * r"), for SQL and F.expr."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def procedure(spark: SparkSession, name: str, arguments: str, columns: str, body: str) -> None:
    """Registers a function that returns a table; ``body`` is a query over the arguments and the session's views."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def call(spark: SparkSession, name: str, *arguments) -> DataFrame:
    """CALL name(arguments) as a source of rows."""
    return spark.sql(f"SELECT * FROM {name}({', '.join(f':a{i}' for i in range(len(arguments)))})", args={f"a{i}": x for i, x in enumerate(arguments)})


def aggregation(spark: SparkSession, name: str, f: Callable[[pd.Series], float], returns: str = "double"):
    """Registers an aggregation of the values of a group. A group is one pandas series, so it is for groups that fit."""
    f.__annotations__ = {"x": pd.Series, "return": float}
    return spark.udf.register(name, F.pandas_udf(f, returns, F.PandasUDFType.GROUPED_AGG))
