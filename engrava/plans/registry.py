"""Named queries with the SQL that they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engrava.tables import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings records edges rank_reversed_planted record_tags recall_cues communities name_parts".split()


class Queries:
    """Collects queries of a module: Spark callables and, where SQL can say the same, its text."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep

    def statement(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query given as Spark SQL over views of the tables it names."""
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
        self.sql[name] = oracle or text


def run_sql(spark: SparkSession, sf_dir: str, text: str, args=None) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text, args=args) if args is not None else spark.sql(text)
