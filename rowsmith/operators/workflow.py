"""Named steps over a table, and columns from an external provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Workflow:
    """Steps by name, run in the order asked for as one lazy plan."""

    def __init__(self):
        self.steps: dict[str, Step] = {}

    def step(self, name: str) -> Callable[[Step], Step]:
        def register(fn: Step) -> Step:
            self.steps[name] = fn
            return fn

        return register

    def fill(self, name: str, source: str, target: str, fn: Callable[[Column], Column]) -> None:
        """A step that sets ``target`` from ``source`` in rows where it is null or blank."""
        blank = lambda df: F.col(target).isNull() | (F.trim(target) == "") if target in df.columns else F.lit(True)
        self.steps[name] = lambda df: df.withColumn(target, F.when(blank(df), fn(F.col(source))).otherwise(F.col(target) if target in df.columns else F.lit(None)))

    def run(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        missing = [n for n in names if n not in self.steps]
        if missing:
            raise KeyError(f"no steps named {missing}")
        for name in names:
            df = df.transform(self.steps[name])
        return df


def provided(df: DataFrame, column: str, into: str, provider: Callable[[list[str]], list[str]]) -> DataFrame:
    """``into`` from an external provider that answers a batch of texts; tasks call it, and nulls are not asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[column].notna()
            batch[into] = None
            if asked.any():
                batch.loc[asked, into] = provider(batch.loc[asked, column].tolist())
            yield batch

    return df.mapInPandas(run, df.withColumn(into, F.lit(None).cast("string")).schema)
