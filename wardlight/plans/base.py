"""A registered query: its name, how to run it, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wardlight.plans.fixtures import fixture, table, with_fixtures

# one fixed time for everything that counts from "now"
AS_OF = "2024-06-01 12:00:00"


class Data:
    """Given tables and fixtures of one scale folder, by attribute or item."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Plan:
    name: str
    run: Callable[[Data], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Data(spark, sf_dir))

    @property
    def oracle(self) -> str | None:
        return None if self.sql is None else with_fixtures(self.sql)
