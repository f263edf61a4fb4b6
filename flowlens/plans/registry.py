"""The table of queries: name -> function of (spark, sf_dir), with its oracle in DuckDB SQL where SQL can say it.

A query, and an analysis that queries share, declares the analyses it needs. One query alone computes them within its own plan, or
writes one that it and another of its analyses need;
``together`` runs many over one set of them: what several need is written once and deleted after its last use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.fixpoint import Rounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ANALYSES: dict[str, Callable[[Tables], DataFrame]] = {}
#: What each query and each analysis needs.
NEEDS: dict[str, tuple[str, ...]] = {}
_PLANS: dict[str, Callable[[Tables], DataFrame]] = {}


class UndeclaredAnalysisError(LookupError):
    """A query or an analysis asked for one that it does not declare."""


class Tables:
    """The tables of a folder, read when first asked for, and the analyses over them."""

    def __init__(self, spark: SparkSession, folder: str, shared: dict[str, set[str]] | None = None):
        """``shared``: analyses to be written, each with those who will ask for it."""
        self.spark, self.folder, self.rounds = spark, folder, Rounds(spark)
        self.left, self.written, self.asking = {name: set(users) for name, users in (shared or {}).items()}, {}, []

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def run(self, name: str, plan: Callable[[Tables], DataFrame]) -> DataFrame:
        self.asking.append(name)
        try:
            return plan(self)
        finally:
            self.asking.pop()

    def result(self, name: str) -> DataFrame:
        """An analysis: as a plan, or as the table that those who share it read."""
        if self.asking and name not in NEEDS[self.asking[-1]]:
            raise UndeclaredAnalysisError(f"{self.asking[-1]} does not declare {name}")
        if name not in self.left:
            return self.run(name, ANALYSES[name])
        if name not in self.written:
            self.written[name] = self.rounds.write(self.run(name, ANALYSES[name]))[0]
        self.left[name].difference_update(self.asking[-1:])
        return self.written[name]

    def drop_used(self, every: bool = False) -> None:
        """Deletes written analyses that nobody will ask for again."""
        for name in [n for n in self.written if every or not self.left[n]]:
            self.rounds.drop(self.written.pop(name))


def requires(*needs: str):
    """Declares the analyses that the function below asks for."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        NEEDS[f.__name__] = needs
        return f

    return add


def analysis(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Registers what several queries need under its own name."""
    ANALYSES[f.__name__] = f
    NEEDS.setdefault(f.__name__, ())
    return wraps(f)(lambda t: t.result(f.__name__))


def query(oracle: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _PLANS[f.__name__] = f
        NEEDS.setdefault(f.__name__, ())
        QUERIES[f.__name__] = partial(_alone, f.__name__)
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _alone(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder, _shared([name])).run(name, _PLANS[name])


def _shared(names: list[str]) -> dict[str, set[str]]:
    return {need: users for need, users in uses(names).items() if len(users) > 1}


def uses(names: list[str]) -> dict[str, set[str]]:
    """Who asks for each analysis when ``names`` run over one set of analyses."""
    todo, met, users = list(names), set(names), {}
    while todo:
        asking = todo.pop()
        for need in NEEDS[asking]:
            users.setdefault(need, set()).add(asking)
            if need not in met:
                met.add(need)
                todo.append(need)
    return users


def together(spark: SparkSession, folder: str, names: list[str]) -> Iterator[tuple[str, DataFrame]]:
    """Each of the different ``names`` with its result, which is to be used before the next one is asked for. No analysis
    is computed twice; one that only one query or analysis needs stays part of its plan."""
    names = list(dict.fromkeys(names))
    t = Tables(spark, folder, _shared(names))
    try:
        for name in names:
            yield name, t.run(name, _PLANS[name])
            t.drop_used()
    finally:
        t.drop_used(every=True)
