"""Monthly series, baseline models and rolling-origin backtests as window frames.

A series table is (key..., month_ord, value) with one row per calendar month of each key and null
for a gap. A fold is a frame that ends `horizon` rows before the target, so all folds of all keys
and models come from one sort; a key has at most a few hundred months.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..session import stage
from .constraints import contiguous, known

MODELS = ("naive", "historical_mean", "moving_average")
MIN_FOLDS_FOR_INTERVAL = 3
RELIABLE_FOLDS = 3


def check_models(models: Sequence[str]) -> None:
    unknown = [m for m in models if m not in MODELS]
    if unknown:
        raise ValueError(f"unknown model(s) {unknown}; known: {list(MODELS)}")


def _by(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))


# --- Series ------------------------------------------------------------------------------------


def calendar_bounds(
    df: DataFrame,
    reference: Column,
    date_column: str = "flight_date",
    past_years: int = 10,
    future_days: int = 400,
) -> DataFrame:
    """One row: first and last sane month, and how many dates were unreadable or out of range."""
    day = C.as_date(df, date_column)
    sane = day.between(F.add_months(reference, -12 * past_years), F.date_add(reference, future_days))
    return df.select(day.alias("day"), sane.alias("sane")).agg(
        F.min(F.when(F.col("sane"), C.month_ord(F.col("day")))).alias("first_month"),
        F.max(F.when(F.col("sane"), C.month_ord(F.col("day")))).alias("last_month"),
        F.count_if(F.col("day").isNull()).alias("unparseable"),
        F.count_if(~F.col("sane")).alias("out_of_range"),
    )


def calendar_periods(bounds: DataFrame) -> DataFrame:
    """Every month between the bounds; no row when there is no usable date."""
    months = F.when(F.col("first_month").isNotNull(), F.sequence("first_month", "last_month"))
    return bounds.select(F.explode(months).alias("month_ord")).withColumn("period", C.period_text(F.col("month_ord")))


def check_periods(periods: Sequence[str]) -> list[str]:
    """Explicit periods in order; malformed or repeated ones are an error."""
    for p in periods:
        C.period_ord(p)
    if len(set(periods)) != len(periods):
        raise ValueError("periods repeat")
    return sorted(periods)


def series(
    table: DataFrame, value: str, keys: Sequence[str] = (), coverage: str | None = None, min_coverage: float | None = None
) -> DataFrame:
    """Calendar-complete series between the first and last month of the table.

    Months without a row, without a value or under the coverage threshold are null.
    """
    kept = F.col(value)
    if min_coverage is not None and coverage is not None:
        kept = F.when(F.coalesce(F.col(coverage) >= min_coverage, F.lit(True)), kept)
    points = table.select(*keys, "month_ord", kept.cast("double").alias("value"))
    # One row per key holds its months as a map, bounded by the calendar.
    packed = points.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month_ord", "value"))).alias("points"))
    lo, hi = points.agg(F.min("month_ord")).scalar(), points.agg(F.max("month_ord")).scalar()
    spread = packed.withColumn("month_ord", F.explode(F.sequence(lo, hi)))
    return spread.select(
        *keys,
        "month_ord",
        C.period_text(F.col("month_ord")).alias("period"),
        F.try_element_at("points", F.col("month_ord")).alias("value"),
    )


# --- Models ------------------------------------------------------------------------------------


def forecast_column(model: str, keys: Sequence[str], horizon: int, window: int = 3) -> Column:
    """Forecast for a row from the rows up to `horizon` before it."""
    order = _by(keys).orderBy("month_ord")
    history = order.rowsBetween(W.unboundedPreceding, -horizon)
    if model == "naive":
        return F.last("value", ignorenulls=True).over(history)
    if model == "historical_mean":
        return F.avg("value").over(history)
    recent = order.rowsBetween(-horizon - window + 1, -horizon)
    return F.when(F.count("value").over(recent) == window, F.avg("value").over(recent))


def backtest(
    table: DataFrame,
    keys: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    min_train: int = 1,
    horizon: int = 1,
    window: int = 3,
) -> DataFrame:
    """Every fold of every key and model: forecast, error, scaled error and status.

    Folds count by row, so a key that skips or repeats a month would mislabel its horizon: it fails the query.
    """
    check_models(models)
    if min_train < 1 or horizon < 1:
        raise ValueError("min_train and horizon must be at least 1")
    order = _by(keys).orderBy("month_ord")
    history = order.rowsBetween(W.unboundedPreceding, -horizon)
    step = F.abs(F.col("value") - F.lag("value").over(order))
    work = contiguous(table, keys).withColumn("step", step).withColumn("slot", F.row_number().over(order))
    scale = F.avg("step").over(history)
    work = work.withColumns(
        {
            "scale": F.when(scale != 0, scale),
            "data_points_used": F.count("value").over(history),
            **{f"m_{m}": forecast_column(m, keys, horizon, window) for m in models},
        }
    ).filter(F.col("slot") >= min_train + horizon)
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"m_{m}").alias("forecast")) for m in models])
    long = work.withColumn("e", F.explode(entries)).select(
        *keys, "month_ord", "period", "value", "scale", "data_points_used", "e.model", "e.forecast"
    )
    status = (
        F.when(F.col("value").isNull(), "TARGET_UNAVAILABLE")
        .when(F.col("forecast").isNull(), "MODEL_NOT_APPLICABLE")
        .otherwise("OK")
    )
    scored = long.withColumn("status", status)
    ok = F.col("status") == "OK"
    return scored.withColumns(
        {
            "forecast": F.when(F.col("value").isNotNull(), F.col("forecast")),
            "error": F.when(ok, F.col("value") - F.col("forecast")),
            "scaled_error": F.when(ok, F.abs(F.col("value") - F.col("forecast")) / F.col("scale")),
        }
    )


def metrics(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MASE and fold counts per key and model."""
    out = folds.groupBy(*keys, "model").agg(
        F.count("error").alias("number_of_forecasts"),
        F.avg(F.abs("error")).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("scaled_error").alias("mase"),
        F.count("scaled_error").alias("mase_folds"),
        F.count_if(F.col("status") == "TARGET_UNAVAILABLE").alias("skipped_target"),
        F.count_if(F.col("status") == "MODEL_NOT_APPLICABLE").alias("skipped_model"),
    )
    n = F.col("number_of_forecasts")
    return out.withColumns(
        {"status": F.when(n == 0, "INSUFFICIENT_DATA").otherwise("OK"), "few_folds": n < RELIABLE_FOLDS}
    )


def evaluate(
    table: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = MODELS, min_train: int = 1, window: int = 3
) -> DataFrame:
    return metrics(backtest(table, keys, models, min_train, 1, window), keys)


def forecast_next(
    table: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = MODELS, window: int = 3, horizon: int = 1
) -> DataFrame:
    """One forecast per key and model for the month after the last real value; a skipped or repeated month fails the query.

    The model sees the whole series, trailing gap included. Bounds are +-1.96 residual standard
    deviations when at least three folds were scored.
    """
    if horizon != 1:
        raise ValueError("only one month ahead is supported")
    check_models(models)
    # Read by the forecast and by the backtest; one row per key and month.
    table = stage(table, "series")
    order = _by(keys).orderBy("month_ord")
    whole = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    # The frame that ends at the last row itself is the whole series.
    last_row = contiguous(table, keys).withColumns(
        {
            "later": F.lead("month_ord").over(order),
            "data_points_used": F.count("value").over(whole),
            "last_real": F.max(F.when(F.col("value").isNotNull(), F.col("month_ord"))).over(whole),
            **{f"m_{m}": forecast_column(m, keys, 0, window) for m in models},
        }
    ).filter(F.col("later").isNull())
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"m_{m}").alias("forecast")) for m in models])
    heads = last_row.withColumn("e", F.explode(entries)).select(
        *keys, "data_points_used", "last_real", "e.model", "e.forecast"
    )
    residuals = (
        backtest(table, keys, models, 1, 1, window)
        .groupBy(*keys, "model")
        .agg(F.count("error").alias("folds"), F.stddev_samp("error").alias("sd"))
    )
    on = [*keys, "model"]
    joined = heads.join(residuals, on, "left")
    reach = F.when(F.coalesce("folds", F.lit(0)) >= MIN_FOLDS_FOR_INTERVAL, 1.96 * F.col("sd"))
    status = (
        F.when(F.col("last_real").isNull(), "INSUFFICIENT_DATA")
        .when(F.col("forecast").isNull(), "MODEL_NOT_APPLICABLE")
        .otherwise("OK")
    )
    return joined.select(
        *on,
        F.coalesce(C.period_text(F.col("last_real") + 1), F.lit("UNKNOWN")).alias("forecast_period"),
        F.col("forecast").alias("forecast_value"),
        (F.col("forecast") - reach).alias("lower_bound"),
        (F.col("forecast") + reach).alias("upper_bound"),
        "data_points_used",
        status.alias("status"),
    )


def forecast_key(table: DataFrame, column: str, value: str, **options) -> DataFrame:
    """The forecasts of one key, such as a route; a key without a series fails the query."""
    return forecast_next(known(table, column, value), [column], **options)


def backtest_key(table: DataFrame, column: str, value: str, **options) -> DataFrame:
    return backtest(known(table, column, value), [column], **options)


# --- Own models --------------------------------------------------------------------------------


def backtest_custom(
    table: DataFrame,
    keys: Sequence[str],
    model: Callable[..., float | None],
    name: str,
    min_train: int = 1,
    horizon: int = 1,
    **options,
) -> DataFrame:
    """Folds of a caller's model `f(history: pd.Series, **options) -> value or None`.

    The one place with a Python function: Spark groups by key, a group is one monthly series.
    """
    kinds = {f.name: f.dataType for f in table.schema}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [
            T.StructField("month_ord", T.IntegerType()),
            T.StructField("model", T.StringType()),
            T.StructField("forecast", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("status", T.StringType()),
        ]
    )

    def folds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_ord").reset_index(drop=True)
        if (pdf["month_ord"].diff().iloc[1:] != 1).any():
            raise ValueError("not calendar-complete: " + ", ".join(str(pdf[k].iloc[0]) for k in keys))
        rows = []
        for target in range(min_train + horizon - 1, len(pdf)):
            actual = pdf["value"].iloc[target]
            made = None
            if pd.notna(actual):
                made = model(pdf["value"].iloc[: target - horizon + 1], **options)
            status = "TARGET_UNAVAILABLE" if pd.isna(actual) else ("MODEL_NOT_APPLICABLE" if made is None else "OK")
            rows.append(
                {
                    **{k: pdf[k].iloc[0] for k in keys},
                    "month_ord": int(pdf["month_ord"].iloc[target]),
                    "model": name,
                    "forecast": made,
                    "value": None if pd.isna(actual) else float(actual),
                    "status": status,
                }
            )
        return pd.DataFrame(rows, columns=[f.name for f in schema])

    out = table.groupBy(*keys).applyInPandas(folds, schema)
    return out.withColumns({"forecast": C.as_number(F.col("forecast")), "value": C.as_number(F.col("value"))})
