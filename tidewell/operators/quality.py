"""Quality gates: suites of expectations, checked over staged rows in one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.errors import ValidationFailed


@dataclass(frozen=True)
class Expectation:
    """A name, and an aggregate that counts what is unexpected."""

    name: str
    unexpected: Column


def _c(column: str) -> Column:
    return F.col(f"`{column}`")


def not_null(column: str) -> Expectation:
    return Expectation(f"{column} not_null", F.count_if(_c(column).isNull()))


def unique(column: str) -> Expectation:
    """Rows beyond the first of each value; nulls are not compared."""
    return Expectation(f"{column} unique", F.count(_c(column)) - F.count_distinct(_c(column)))


def between(column: str, low: object, high: object) -> Expectation:
    return Expectation(f"{column} between", F.count_if(~_c(column).between(F.lit(low), F.lit(high))))


def in_set(column: str, values: Sequence[object]) -> Expectation:
    return Expectation(f"{column} in_set", F.count_if(~_c(column).isin(*values)))


def matches(column: str, pattern: str) -> Expectation:
    return Expectation(f"{column} matches", F.count_if(~_c(column).rlike(pattern)))


def row_count(low: int = 0, high: int | None = None) -> Expectation:
    n = F.count(F.lit(1))
    return Expectation("row_count", F.when((n >= low) & (F.lit(True) if high is None else n <= high), 0).otherwise(1))


@dataclass(frozen=True)
class StagedInfo:
    """What a gate is given, once, after all rows are staged and before any is visible."""

    table: str
    dest_table: str
    rows: int
    dataframe: DataFrame


@dataclass
class Suite:
    """A gate out of expectations. on_result is called with what was found, passed or not."""

    expectations: Sequence[Expectation]
    on_result: Callable[[dict], None] | None = None
    results: list[dict] = field(default_factory=list)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """expectation, success, unexpected: one row for each."""
        one = df.agg(*[e.unexpected.cast("long").alias(f"e{i}") for i, e in enumerate(self.expectations)])
        rows = F.array(*[F.struct(F.lit(e.name).alias("expectation"), F.coalesce(F.col(f"e{i}"), F.lit(0)).alias("unexpected")) for i, e in enumerate(self.expectations)])
        return one.select(F.explode(rows).alias("r")).select("r.expectation", (F.col("r.unexpected") == 0).alias("success"), F.col("r.unexpected").alias("unexpected"))

    def __call__(self, staged: StagedInfo) -> None:
        found = [r.asDict() for r in self.evaluate(staged.dataframe).collect()]
        result = {"success": all(r["success"] for r in found), "dest_table": staged.dest_table, "rows": staged.rows, "results": found}
        self.results.append(result)
        if self.on_result:
            self.on_result(result)
        if not result["success"]:
            raise ValidationFailed(result)
