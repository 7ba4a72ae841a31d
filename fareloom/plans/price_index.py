"""From quotes to the national index: the main plan.

quotes -> one rejection reason per row -> first row per observation id -> (route, month, fare)
counts, staged once -> outlier limits -> representative fares -> indices for all months.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig, VolatilityConfig
from ..functions import columns as C
from ..operators import cleaning, facts, indices, volatility
from ..operators.constraints import guarded
from ..operators.quantiles import value_bin
from ..operators.validation import enrich, with_rejection_reason
from ..session import stage


#: Outcome of usable rows outside the wanted booking horizon.
LEFT_OUT = "LEFT_OUT"


@dataclass(frozen=True)
class PriceIndex:
    """All results of one set of quotes under one method configuration.

    Every attribute is a lazy DataFrame, except that the value counts, the limits and the facts are written once to the
    shared checkpoint folder when first needed: several branches read them.
    """

    quotes: DataFrame
    config: IndexConfig
    weights: DataFrame | None = None
    order_cols: tuple[str, ...] = cleaning.ORDER_COLS
    volatility_config: VolatilityConfig = VolatilityConfig()

    # --- rows --------------------------------------------------------------------------------

    @cached_property
    def checked(self) -> DataFrame:
        """Quotes with the columns the index needs and their rejection reason."""
        needed = {
            "observation_id", "airline", "origin", "destination", "flight_date", "booking_date",
            "total_fare", "currency", self.config.fare_field, *self.order_cols,
        }
        columns = [c for c in self.quotes.columns if c in needed]
        return with_rejection_reason(self.quotes.select(*columns), self.config.fare_field)

    @cached_property
    def valid(self) -> DataFrame:
        return self.checked.filter(F.col("rejection_reason").isNull()).drop("rejection_reason")

    @cached_property
    def enriched(self) -> DataFrame:
        slim = [c for c in self.valid.columns if c not in ("airline", "currency")]
        return enrich(self.valid.select(*slim), self.config)

    # --- counts ------------------------------------------------------------------------------

    @cached_property
    def tally(self) -> DataFrame:
        """(outcome, route, month, bucket, fare) -> n, rows; staged. The one pass over the quotes.

        `outcome` is null for rows that count; others have their rejection reason, or LEFT_OUT by the horizon filter, and no
        key but that. `n` are ids and `rows` the rows they came in: what the dedup drops stays known.
        """
        keys = ("route", "month_ord", "booking_horizon_bucket")
        rows = enrich(self.checked, replace(self.config, booking_horizon_filter=None))
        wanted = self.config.booking_horizon_filter
        left_out = ~F.coalesce(F.col("booking_horizon_bucket") == wanted, F.lit(False)) if wanted else F.lit(False)
        outcome = F.coalesce("rejection_reason", F.when(left_out, LEFT_OUT))
        order = [c for c in self.order_cols if c in rows.columns]
        columns = dict.fromkeys(["observation_id", *keys, "standardized_fare", *order])
        counted = rows.withColumn("outcome", outcome)
        counted = counted.select("outcome", *[F.when(F.col("outcome").isNull(), F.col(c)).alias(c) for c in columns])
        unique = cleaning.first_per_key(counted, ["outcome", "observation_id"], self.order_cols, count_as="rows")
        fare = "standardized_fare"
        per_fare = unique.groupBy("outcome", *keys, value_bin(fare).alias("bin"), fare)
        return stage(per_fare.agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")), "fare-counts")

    @cached_property
    def counts(self) -> DataFrame:
        """(route, month, bucket, fare) -> n of the rows that count."""
        return self.tally.filter(F.col("outcome").isNull() & F.col("standardized_fare").isNotNull()).drop("outcome", "rows")

    @cached_property
    def flagged(self) -> DataFrame:
        """Counts with `is_outlier`; limits pool the buckets of a route and month.

        Limits have one row per route and month and are staged, so that the branches that read
        the kept counts do not search them again and join them by their known size.
        """
        keys = ("route", "month_ord")
        limits = cleaning.outlier_limits(self.counts, keys, self.config)
        if limits is not None:
            limits = stage(limits, "fare-limits")
        return cleaning.flag_outliers(self.counts, keys, self.config, limits)

    @cached_property
    def kept(self) -> DataFrame:
        return self.flagged.filter(~F.col("is_outlier")).drop("is_outlier")

    @cached_property
    def facts(self) -> DataFrame:
        """One row per route and month; staged, as the routes, the total of their weights and every result read it."""
        return stage(facts.route_period_fares(self.kept, self.config), "facts")

    # --- results -----------------------------------------------------------------------------

    def month_bounds(self) -> tuple[Column, Column]:
        """First and last observed month as scalar subqueries."""
        span = F.struct(F.min("month_ord").alias("lo"), F.max("month_ord").alias("hi"))
        bounds = self.counts.agg(span.alias("span")).scalar()
        return bounds["lo"], bounds["hi"]

    def routes(self, first: str | None = None, last: str | None = None, lead: int = 0) -> DataFrame:
        """Route indices for first..last (default: the observed months), `lead` months earlier on."""
        lo, hi = self.month_bounds() if first is None or last is None else (None, None)
        start = F.lit(C.period_ord(first)) if first else lo
        end = F.lit(C.period_ord(last)) if last else hi
        return indices.route_indices(self.facts, self.config, start - lead, end, self.weights)

    def national(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """National index per month with changes; the twelve months before `first` feed the changes."""
        if first is None:
            return indices.national_index(self.routes(None, last), self.config)
        monthly = indices.national_index(self.routes(first, last, lead=12), self.config)
        return monthly.filter(F.col("month_ord") >= C.period_ord(first))

    def inflation(
        self, first: str | None = None, last: str | None = None, traffic_weights: DataFrame | None = None
    ) -> DataFrame:
        return indices.inflation_table(self.routes(first, last), self.config, traffic_weights)

    def contributions(self, first: str | None = None, last: str | None = None) -> DataFrame:
        return indices.contributions(self.routes(first, last), self.config)

    def route_volatility(self) -> DataFrame:
        return volatility.route_volatility(self.kept, self.volatility_config)

    def cleaning_report(self) -> DataFrame:
        """(reason, n): received, valid, removed and every reason that occurs, from the staged tally alone.

        Rows a horizon filter leaves out are in `removed` but have no reason of their own.
        """
        counts = F.col("outcome").isNull()
        reasons = self.tally.groupBy(F.coalesce("outcome", F.lit("VALIDATED")).alias("reason")).agg(F.sum("rows").alias("n"))
        extra = F.coalesce(F.sum(F.when(counts, F.col("rows") - F.col("n"))), F.lit(0))
        repeated = self.tally.agg(extra.alias("n")).select(F.lit("DUPLICATE").alias("reason"), "n")
        outliers = self.flagged.groupBy("is_outlier").agg(F.sum("n").alias("n"))
        label = F.when(F.col("is_outlier"), F.lit(f"OUTLIER_{self.config.outlier_method.upper()}")).otherwise("valid")
        parts = reasons.unionByName(repeated).unionByName(outliers.select(label.alias("reason"), "n"))
        # A handful of rows from here on: one per reason.
        is_input = (F.col("reason") == "VALIDATED") | ~F.col("reason").isin("valid", "DUPLICATE") & ~F.col(
            "reason"
        ).startswith("OUTLIER")
        totals = parts.agg(
            F.sum(F.when(is_input, F.col("n")).otherwise(0)).alias("received"),
            F.sum(F.when(F.col("reason") == "valid", F.col("n")).otherwise(0)).alias("valid"),
        )
        summary = totals.select(
            F.explode(
                F.array(
                    F.struct(F.lit("received").alias("reason"), F.col("received").alias("n")),
                    F.struct(F.lit("removed").alias("reason"), (F.col("received") - F.col("valid")).alias("n")),
                    F.struct(F.lit("valid").alias("reason"), F.col("valid").alias("n")),
                )
            ).alias("s")
        ).select("s.*")
        detail = parts.filter(~F.col("reason").isin("VALIDATED", LEFT_OUT, "valid") & (F.col("n") > 0))
        return detail.unionByName(summary)

    def summary(self, current: str) -> DataFrame:
        """One row for a month: index, changes, counts, flags and method names. Empty input gives no row."""
        report = self.cleaning_report()
        outliers = F.sum(F.when(F.col("reason").startswith("OUTLIER"), F.col("n")).otherwise(0))
        totals = report.agg(
            F.max(F.when(F.col("reason") == "received", F.col("n"))).alias("received"),
            F.max(F.when(F.col("reason") == "removed", F.col("n"))).alias("removed"),
            outliers.alias("outliers"),
        )
        month = self.national(current, current)
        out = month.withColumns(
            {
                "observations_received": totals.select("received").scalar(),
                "observations_rejected": totals.select("removed").scalar(),
                "outliers_flagged": totals.select("outliers").scalar(),
                "base_period": F.lit(self.config.base_period),
                "representative_method": F.lit(self.config.representative_method),
                "aggregation_method": F.lit(self.config.aggregation_method),
            }
        )
        flags = indices.quality_flags(F.col("observations_rejected"), F.col("observations_received"))
        return out.withColumn("quality_flags", flags)

    def require_survivors(self) -> "PriceIndex":
        """The same index; queries over its counts fail when nothing survived validation and cleaning."""
        found = self.counts.agg(F.count(F.lit(1)).alias("n"))
        problem = F.when(F.col("n") == 0, "no observation survived validation and cleaning")
        checked = replace(self)
        checked.__dict__["counts"] = guarded(self.counts, found.select(problem.alias("problem")))
        return checked

    def with_config(self, **changes) -> "PriceIndex":
        return PriceIndex(
            self.quotes, replace(self.config, **changes), self.weights, self.order_cols, self.volatility_config
        )
