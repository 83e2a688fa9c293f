"""The panel: a DataFrame with an entity column and a time column, and the windows over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


@dataclass(frozen=True)
class Panel:
    """Column names of a panel. Time-series operators partition by entity, cross-sectional ones by time."""

    entity: str = "entity"
    time: str = "dt"

    @property
    def series(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.time)

    @property
    def section(self) -> WindowSpec:
        return Window.partitionBy(self.time)

    def trailing(self, rows: int, shift: int = 0) -> WindowSpec:
        """The last ``rows`` rows, ending ``shift`` rows ago."""
        return self.series.rowsBetween(-(rows - 1) - shift, -shift)

    def expanding(self, shift: int = 0) -> WindowSpec:
        return self.series.rowsBetween(UNBOUNDED, -shift)

    def assert_unique(self, df: DataFrame) -> DataFrame:
        """Fails if a key occurs twice; one aggregate, no rows to the driver but the offending one."""
        twice = df.groupBy(self.entity, self.time).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"key occurs more than once: {twice[0]}")
        return df


PANEL = Panel()


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0 or either is null."""
    return F.try_divide(x, F.nullif(y, F.lit(0.0)))


def finite(x: Column) -> Column:
    """NaN and infinities become null: null is the only missing value of the engine."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate over rows that have both; null where one of them doesn't vary, which plain ``corr`` fails on."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
