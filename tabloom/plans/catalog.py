"""Register of the queries with the SQL that gives the same rows on another engine."""

from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(sql=None, name=None):
    """Register a (spark, directory) -> DataFrame function, under its own name by default."""

    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return register


def table(spark, directory, name):
    return spark.read.parquet(f"{directory}/{name}.parquet")


def plain_zero(c):
    """Rounded values of either sign near zero all become 0.0, never -0.0."""
    return c + F.lit(0.0)


def load():
    """Import every module that registers queries."""
    from tabloom.plans import (  # noqa: F401
        algorithm_queries,
        eligibility_queries,
        evaluation_queries,
        experiment_queries,
        model_queries,
        profile_queries,
        scoring_queries,
        source_queries,
        split_queries,
        value_queries,
    )

    return QUERIES, SQL
