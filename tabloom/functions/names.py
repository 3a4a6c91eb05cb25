"""Column access by exact header; headers may hold spaces, dots and backticks."""

from pyspark.sql import functions as F


def quoted(name):
    return "`" + name.replace("`", "``") + "`"


def col(name):
    return F.col(quoted(name))


def by_place(df):
    """The table with columns s0, s1, ... and where each name went, for names that differ by case only."""
    place = {n: f"s{i}" for i, n in enumerate(df.columns)}
    return df.toDF(*place.values()), place
