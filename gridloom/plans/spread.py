"""Work spread over tasks, and expressions made once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: rows of a small table that one task takes on
ROWS = 16_384


def spread(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """``df``, a table as it is read, by ``key`` over the cores there are, or over more tasks so that none takes much more than ``rows``.

    A file of few bytes is read by one task, however much its rows cost or grow to.  What is grouped by ``key`` and more
    columns later on stays where it is.  Rows are counted from the files' footers.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` that are made once a row; of plain ones the optimizer puts a copy wherever a filter names them."""
    s = F.struct(*[c.alias(n) for n, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(s)).alias("__once")).select(*[F.col(f"__once.{c}").alias(c) if c in columns else c for c in [*df.columns, *[n for n in columns if n not in df.columns]]])
