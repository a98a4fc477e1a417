"""Small output helpers of the registered queries."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str | Column) -> Column:
    return F.concat_ws(",", c)
