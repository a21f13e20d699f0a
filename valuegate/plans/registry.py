"""Registered queries: each takes the given tables and has, where SQL can express it, the SQL of the same rows."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from valuegate.sources.kept import kept, listing

#: The given tables.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@cache
def rules() -> str:
    """What tells the present code of kept tables from any other: where one of these modules changes, all of them are made anew."""
    names = ("functions.text", "operators.bloom", "operators.dictionary", "operators.gate", "operators.index", "operators.profile", "plans.profiling")
    sources = (inspect.getsource(importlib.import_module(f"valuegate.{name}")) for name in names)
    return hashlib.sha256("".join(sources).encode()).hexdigest()[:16]


class Tables:
    """The given tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}
        self._read: dict[str, DataFrame] = {}
        self._version: str | None = None

    @property
    def version(self) -> str:
        """What tells the tables' present files, and the rules that are applied to them, from any others."""
        if self._version is None:
            self._version = f"{listing(self.spark, [f'{self.folder}/{name}.parquet' for name in TABLES])}-{rules()}"
        return self._version

    def kept(self, name: str, schema: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        """A derived table that later queries over the same files read as well."""
        if name not in self._made:
            self._made[name] = kept(self.spark, name, self.version, schema, make, partition_by)
        return self._made[name]

    def __call__(self, name: str) -> DataFrame:
        if name not in self._read:  # reading a schema is a job
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def all(self, names: list[str] | None = None) -> dict[str, DataFrame]:
        return {name: self(name) for name in names or TABLES}

    def sql(self, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        """``spark.sql`` over those tables that the text names, and over the given frames."""
        named = {name: self(name) for name in TABLES if re.search(rf"\b{name}\b", text)} | frames
        for name, frame in named.items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args)


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` under ``name``."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def sql_query(name: str, text: str, oracle: str | None = None, args: dict | None = None) -> None:
    """Registers query text that Spark SQL runs; ``oracle`` where its dialect has to differ."""
    query(name, oracle or text)(lambda t: t.sql(text, args))
