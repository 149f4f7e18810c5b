"""Features per sensor series, network degree and the prediction target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pipewatch.operators.series import over_series
from pipewatch.operators.silver import SENSOR, TIME

MEASURES = {"pressure": "pressure_psi", "flow": "flow_gpm", "demand": "demand_gpm"}

# The published feature dictionary.
FEATURE_DICTIONARY = {
    "event_ts_utc": "Standardized event timestamp in UTC",
    "sensor_node_id": "Network sensor/node identifier",
    "pressure_psi": "Pressure standardized to PSI",
    "flow_gpm": "Flow standardized to GPM",
    "demand_gpm": "Demand standardized to GPM",
    "pressure_lag_1": "Pressure lag by 1 timestep",
    "pressure_lag_2": "Pressure lag by 2 timesteps",
    "flow_lag_1": "Flow lag by 1 timestep",
    "demand_lag_1": "Demand lag by 1 timestep",
    "pressure_delta": "Pressure change vs previous timestep",
    "flow_delta": "Flow change vs previous timestep",
    "demand_delta": "Demand change vs previous timestep",
    "pressure_roc": "Pressure rate of change over 1 timestep",
    "flow_roc": "Flow rate of change over 1 timestep",
    "demand_roc": "Demand rate of change over 1 timestep",
    "pressure_roll_avg_3": "Rolling average pressure over 3 timesteps",
    "pressure_roll_avg_6": "Rolling average pressure over 6 timesteps",
    "flow_roll_avg_3": "Rolling average flow over 3 timesteps",
    "flow_roll_avg_6": "Rolling average flow over 6 timesteps",
    "demand_roll_avg_3": "Rolling average demand over 3 timesteps",
    "demand_roll_avg_6": "Rolling average demand over 6 timesteps",
    "hour_of_day": "Hour extracted from event timestamp",
    "day_of_week": "Day of week extracted from event timestamp",
    "is_weekend": "Weekend indicator",
    "node_degree": "Topology degree for sensor node from EPANET links",
    "target_leak_horizon": "Prediction target at configured horizon",
}


def lags(w: WindowSpec) -> dict[str, Column]:
    first = {f"{m}_lag_1": F.lag(c, 1).over(w) for m, c in MEASURES.items()}
    return {**first, "pressure_lag_2": F.lag("pressure_psi", 2).over(w)}


def rolling_means(w: WindowSpec) -> dict[str, Column]:
    return {
        f"{m}_roll_avg_{n}": F.avg(c).over(w.rowsBetween(1 - n, 0))
        for m, c in MEASURES.items()
        for n in (3, 6)
    }


def changes() -> dict[str, Column]:
    """Deltas to the previous reading and rates, 0 where the previous is absent or 0."""
    out = {}
    for m, c in MEASURES.items():
        before = F.col(f"{m}_lag_1")
        delta = F.col(c) - before
        out[f"{m}_delta"] = delta
        out[f"{m}_roc"] = F.when(before != 0, delta / before).otherwise(F.lit(0.0))
    return out


def calendar(time: str = TIME) -> dict[str, Column]:
    weekday = F.dayofweek(time)
    return {
        "hour_of_day": F.hour(time),
        "day_of_week": weekday,
        "is_weekend": F.when(weekday.isin(1, 7), 1).otherwise(0),
    }


#: Rows before a row that its features reach back to.
LOOKBACK = 5


def series_features(silver: DataFrame, horizon: int = 1, more: Callable[[WindowSpec], dict[str, Column]] | None = None,
                    lookahead: int | None = None) -> DataFrame:
    """All window features in one pass over the (sensor, time) order, and those of ``more``, which may look ``lookahead`` rows ahead."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        windowed = {
            **lags(w),
            **rolling_means(w),
            "target_leak_horizon": F.lead("leak_label", horizon).over(w),
            **(more(w) if more else {}),
        }
        return rows.withColumns(windowed).withColumns(changes())

    reach = max(horizon, lookahead or 0)
    return over_series(silver, SENSOR, [F.col(TIME).asc()], compute, lookback=LOOKBACK, lookahead=reach)


def node_degree(links: DataFrame) -> DataFrame:
    """Link ends per node: parallel links count, a loop counts twice."""
    ends = links.select(F.explode(F.array("from_node", "to_node")).alias(SENSOR))
    return ends.groupBy(SENSOR).agg(F.count(F.lit(1)).alias("node_degree"))


def attach_degree(df: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return df.withColumn("node_degree", F.lit(0).cast("long"))
    joined = df.join(node_degree(links), SENSOR, "left")
    return joined.withColumn("node_degree", F.coalesce("node_degree", F.lit(0)))


def fill_gaps(df: DataFrame) -> DataFrame:
    """Defaults for missing values, applied after the changes were computed."""
    return df.withColumns(
        {
            "_source_type": F.coalesce("_source_type", F.lit("real")),
            "target_leak_horizon": F.coalesce("target_leak_horizon", "leak_label"),
        }
    ).fillna(0)


def gold(silver: DataFrame, links: DataFrame | None = None, horizon: int = 1) -> DataFrame:
    features = series_features(silver, horizon).withColumns(calendar())
    return fill_gaps(attach_degree(features, links))


def feature_dictionary(gold: DataFrame) -> DataFrame:
    """Each gold column with its description, NULL for columns passed through."""
    spark = gold.sparkSession
    rows = [(name, dtype, FEATURE_DICTIONARY.get(name)) for name, dtype in gold.dtypes]
    return spark.createDataFrame(rows, "name string, type string, description string")
