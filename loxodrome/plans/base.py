"""Registration of queries and access to tables, shared by the query modules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries of one module and the SQL they are compared with."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers the decorated function under its name, with its SQL if there is one."""

        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, and the fewest that a task is made for, where a row costs milliseconds.
ROWS_OF_A_TASK, FEWEST_ROWS = 4000, 200


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as its rows are worth, for columns that cost far more than the read: a file of a row group is one task's, however many rows that has."""
    rows = df.count()
    tasks = max(-(-rows // ROWS_OF_A_TASK), min(2 * df.sparkSession.sparkContext.defaultParallelism, rows // FEWEST_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def real(sql: str) -> str:
    """SQL with doubles for the decimal numbers in it."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", sql)
