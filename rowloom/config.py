"""Settings from a TOML file: of Spark, the warehouse and the performance of jobs."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from rowloom.client import Client
from rowloom.plans.lower import Performance


@dataclass
class Config:
    """``[spark]`` holds Spark's own settings by full name, ``[storage]`` the warehouse, ``[performance]`` the fields of
    Performance. Whatever a file doesn't say keeps its default; unknown tables and fields are errors."""

    spark: dict[str, str] = field(default_factory=dict)
    warehouse: str | None = None
    performance: Performance = field(default_factory=Performance)

    @classmethod
    def of(cls, tables: dict[str, Any]) -> Config:
        known = {"spark", "storage", "performance"}
        if unknown := set(tables) - known:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        storage = dict(tables.get("storage", {}))
        warehouse = storage.pop("warehouse", None)
        if storage:
            raise ValueError(f"unknown fields of storage: {sorted(storage)}")
        try:
            performance = Performance(**tables.get("performance", {}))
        except TypeError as e:
            raise ValueError(f"unknown fields of performance: {e}") from e
        return cls(_flat(tables.get("spark", {})), warehouse, performance)

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path, "rb") as f:
            return cls.of(tomllib.load(f))

    def session(self) -> SparkSession:
        builder = SparkSession.builder
        for k, v in self.spark.items():
            builder = builder.config(k, v)
        return builder.getOrCreate()

    def client(self, spark: SparkSession | None = None) -> Client:
        return Client(spark or self.session(), self.warehouse)


def _flat(table: dict[str, Any], before: str = "") -> dict[str, str]:
    """Settings by full name; a dotted name in TOML is a table in a table."""
    out: dict[str, str] = {}
    for k, v in table.items():
        if isinstance(v, dict):
            out |= _flat(v, f"{before}{k}.")
        else:
            out[f"{before}{k}"] = str(v).lower() if isinstance(v, bool) else str(v)
    return out
