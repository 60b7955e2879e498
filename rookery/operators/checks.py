"""Checks that ride along: what a query's rows should be is counted while the query runs, and reported without a second pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

OK, WARN, FAIL = "ok", "warn", "fail"


@dataclass(frozen=True)
class Check:
    """Rows for which `holds` isn't true break it; up to `spare` (a share of all rows) is a warning, more a failure. `least` rows must be there at all."""

    name: str
    holds: Column
    spare: float = 0.0
    least: int = 0


class Checked:
    """`rows` are the frame's own; once they have been written or counted, `report` tells how the checks came out."""

    def __init__(self, df: DataFrame, checks: list[Check]):
        self.checks, self.spark = checks, df.sparkSession
        self._seen = Observation()
        broken = [F.count_if(~F.coalesce(c.holds, F.lit(False))).alias(f"broken_{i}") for i, c in enumerate(checks)]
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *broken)

    def report(self) -> DataFrame:
        """(name, state, broken, rows): waits for the first action on `rows`; makes none itself."""
        seen = self._seen.get
        n = seen["rows"]
        lines = []
        for i, c in enumerate(self.checks):
            broken = seen[f"broken_{i}"]
            state = FAIL if n < c.least or broken > c.spare * n else WARN if broken else OK
            lines.append((c.name, state, broken, n))
        return self.spark.createDataFrame(lines, "name string, state string, broken long, rows long")
