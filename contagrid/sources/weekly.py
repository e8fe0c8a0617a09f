"""Cubes stored by snapshot week, to be merged over any weeks.

A cube holds counts, so the cube of several weeks is the sum of theirs, and every
indicator that is computed from a cube (shares, means, quartiles) is computed from the
merged one just as from the rows. A corrected week is counted again on its own and
replaced as a whole; the other weeks are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from contagrid.session import run_together
from contagrid.sources.published import Folder
from contagrid.sources.readers import SNAPSHOT


class WeeklyCubes:
    """Named cubes of each week under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, week: date) -> Folder:
        return Folder(self.spark, f"{self.path}/{SNAPSHOT}={week.isoformat()}")

    def store(self, week: date, cubes: Mapping[str, DataFrame]) -> None:
        """Put a week's cubes in place of those stored; all of them or, if one fails, none."""

        def write(version: str) -> None:
            dated = {name: cube.withColumn(SNAPSHOT, F.lit(week)) for name, cube in cubes.items()}
            run_together(self.spark, {name: lambda df=df, name=name: df.write.parquet(f"{version}/{name}") for name, df in dated.items()})

        self._folder(week).replace(write)

    def read(self, name: str, weeks: Sequence[date]) -> DataFrame:
        """A cube's rows of the given weeks, with their week; weeks that aren't stored have none."""
        versions = [self._folder(week).current() for week in weeks]
        paths = [f"{version}/{name}" for version in versions if version]
        if not paths:
            raise ValueError(f"no stored week among {', '.join(map(str, weeks))}")
        return self.spark.read.parquet(*paths)

    def merged(self, name: str, weeks: Sequence[date]) -> DataFrame:
        """One cube of all the weeks."""
        return merge(self.read(name, weeks).drop(SNAPSHOT))


def merge(rows: DataFrame) -> DataFrame:
    """Cube rows added up where their keys agree; every column but the counts is a key."""
    counts = [c for c in rows.columns if c in ("n", "n_first")]
    keys = [c for c in rows.columns if c not in counts]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
