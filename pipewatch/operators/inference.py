"""Checks on rows sent for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewatch.sources.schemas import MODEL_FEATURES

MAX_ROWS = 10_000


def training_frame(gold: DataFrame, label: str = "leak_label") -> DataFrame:
    """The fixed model features with gaps as 0, and the label as an integer."""
    missing = [c for c in (*MODEL_FEATURES, label) if c not in gold.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    features = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MODEL_FEATURES]
    return gold.select(*features, F.col(label).cast("int").alias(label))


def finite(value: Column) -> Column:
    """0 for NULL, NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.coalesce(F.when(~bad, value), F.lit(0.0))


def clean_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


def validate_rows(rows: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """Per row (batch_id, row_index, payload JSON): its values, or what is wrong with it.

    A row is an object holding every feature or a list of as many values.
    """
    payload = F.trim("payload")
    as_map = F.from_json(payload, "map<string,string>")
    as_list = F.from_json(payload, "array<string>")
    is_object, is_list = payload.startswith("{"), payload.startswith("[")
    parsed = rows.withColumns(
        {"_map": F.when(is_object, as_map), "_list": F.when(is_list, as_list)}
    )
    names = F.array(*[F.lit(f) for f in features])
    absent = F.filter(names, lambda f: ~F.map_contains_key("_map", f))
    texts = F.when(F.col("_map").isNotNull(), F.transform(names, lambda f: F.col("_map")[f])).otherwise(
        F.col("_list")
    )
    parsed = parsed.withColumns(
        {"_absent": absent, "values": F.transform(texts, lambda t: t.try_cast("double"))}
    )
    values = F.col("values")
    not_finite = F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    quoted = F.transform("_absent", lambda f: F.concat(F.lit("'"), f, F.lit("'")))
    who = F.concat(F.lit("Row "), F.col("row_index").cast("string"))
    error = (
        F.when(F.size("_absent") > 0, F.concat(who, F.lit(" missing fields: ["), F.array_join(quoted, ", "), F.lit("]")))
        .when(
            F.col("_list").isNotNull() & (F.size("_list") != len(features)),
            F.concat(who, F.lit(f" must contain {len(features)} feature values")),
        )
        .when(F.col("_map").isNull() & F.col("_list").isNull(), F.concat(who, F.lit(" must be an object or list")))
        .when(F.exists(values, lambda v: v.isNull()), F.concat(who, F.lit(" contains non-numeric feature values")))
        .when(not_finite, F.concat(who, F.lit(" contains NaN or infinite values")))
    )
    return parsed.withColumn("error", error).select(
        "batch_id", "row_index", F.when(F.col("error").isNull(), values).alias("values"), "error"
    )


def batch_verdicts(validated: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """A batch is accepted when no row has an error and it is not too long."""
    return validated.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("error").alias("n_errors")
    ).withColumns(
        {
            "too_long": F.col("n_rows") > max_rows,
            "accepted": (F.col("n_rows") <= max_rows) & (F.col("n_errors") == 0),
        }
    )


def accepted_rows(validated: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows of accepted batches."""
    good = batch_verdicts(validated, max_rows).filter("accepted").select("batch_id")
    return validated.join(good, "batch_id", "left_semi")
