"""News context of significant route movements."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MatchingConfig
from ..functions import columns as C
from ..functions.news_text import event_label, event_score, tidy
from ..session import stage
from .constraints import known

ARTICLE_COLUMNS = (
    "headline", "source", "published_at", "url", "event_type", "summary",
    "related_airlines", "related_airports", "related_routes", "confidence_score", "is_mock",
)
MOVEMENT_KEY = ("route", "period", "metric")
DISCLAIMER = "Articles are shown for context; a shared date or place does not show what moved the fare."


def is_significant(change: Column, threshold: float) -> Column:
    return F.abs(change) >= threshold


def movements(inflation: DataFrame, as_of: Column, metric: str = "mom") -> DataFrame:
    """Rows with a value of the metric as movements; `as_of` is an expression on the row."""
    change = F.col(f"{metric}_inflation_pct")
    return inflation.filter(change.isNotNull()).select(
        "route",
        "origin",
        "destination",
        change.alias("change_pct"),
        F.when(change >= 0, "increase").otherwise("decrease").alias("direction"),
        F.lit(metric).alias("metric"),
        "period",
        as_of.alias("as_of"),
    )


def with_article_columns(df: DataFrame) -> DataFrame:
    """Article schema with null for columns a provider does not fill."""
    tags = ("related_airlines", "related_airports", "related_routes")
    kinds = {**{t: "array<string>" for t in tags}, "confidence_score": "double", "is_mock": "boolean"}
    return df.select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c)
            for c in ARTICLE_COLUMNS
        ]
    )


def in_window(moves: DataFrame, articles: DataFrame, days: int) -> DataFrame:
    """(as_of, article) for every article within `days` of a date that some movement is judged at.

    The range condition becomes an equality on buckets of `days` length: a date covers at most
    three or four of them, an article lies in one.
    """
    dates = moves.select("as_of").distinct()
    bucket = lambda ts: F.floor(F.unix_seconds(ts) / (days * 86400))
    lo, hi = F.timestamp_add("DAY", F.lit(-days), F.col("as_of")), F.timestamp_add("DAY", F.lit(days), F.col("as_of"))
    spread = dates.withColumn("bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    dated = articles.withColumn("bucket", bucket(F.col("published_at")))
    near = dated.join(spread, "bucket").drop("bucket")
    return near.filter(F.col("published_at").between(lo, hi))


def first_by_url(pairs: DataFrame, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """One article per address (within each `by` group): the earliest published, then by content."""
    rest = [c for c in pairs.columns if c not in (*by, "url", "published_at")]
    kept = F.min(F.struct("published_at", *rest)).alias("kept")
    grouped = pairs.groupBy(*by, "url").agg(kept)
    return grouped.select(*by, "url", "kept.*")


def _date_score(config: MatchingConfig) -> Column:
    away = F.abs(F.unix_micros("published_at") - F.unix_micros("as_of")) / 86_400_000_000
    w = config.date_window_days
    return F.when(away >= w, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - away / w))


def _total(parts: Sequence[tuple[float, Column]]) -> Column:
    total = None
    for weight, score in parts:
        term = F.lit(weight) * score
        total = term if total is None else total + term
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def _tidied(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({f"t_{k}": tidy(F.col(f"related_{k}")) for k in ("airports", "routes", "airlines")})


def score(pairs: DataFrame, config: MatchingConfig) -> DataFrame:
    """Relevance and matched signals of (movement, article) rows.

    `airlines_on_route` (array) may be a column; without it any named airline is a mild signal.
    """
    rows = _tidied(pairs)
    a, d = F.upper("origin"), F.upper("destination")
    at_origin, at_destination = F.array_contains("t_airports", a), F.array_contains("t_airports", d)
    route_hit = F.array_contains("t_routes", F.upper("route")) | F.array_contains("t_routes", F.concat_ws("-", d, a))
    named_airline, named_airport = F.size("t_airlines") > 0, F.size("t_airports") > 0
    roster = F.col("airlines_on_route") if "airlines_on_route" in pairs.columns else F.lit(None).cast("array<string>")
    flies = F.arrays_overlap("t_airlines", tidy(roster))
    airline = (
        F.when(~named_airline, 0.0).when(roster.isNull(), 0.5).when(flies, 1.0).otherwise(0.25)
    )
    event = event_score(F.col("event_type"))
    date = _date_score(config)
    airport_hit = at_origin | at_destination
    parts = [
        (config.weight_date, date),
        (config.weight_airport, (at_origin.cast("int") + at_destination.cast("int")) / 2.0),
        (config.weight_route, route_hit.cast("double")),
        (config.weight_airline, airline),
        (config.weight_event, event),
        (config.weight_geography, F.when(~named_airport, 0.5).when(airport_hit, 1.0).otherwise(0.0)),
    ]
    signals = F.array_compact(
        F.array(
            F.when(date > 0, "date_proximity"),
            F.when(at_origin, "airport:origin"),
            F.when(at_destination, "airport:destination"),
            F.when(route_hit, "route"),
            F.when(named_airline & roster.isNull(), "airline:mentioned")
            .when(named_airline & flies, "airline:operates_route")
            .when(named_airline, "airline:unrelated"),
            F.when(event > 0, F.concat(F.lit("event_type:"), F.col("event_type"))),
            F.when(~named_airport, "geographic:national").when(airport_hit, "geographic:route_specific"),
        )
    )
    return rows.withColumns({"relevance_score": _total(parts), "matched_signals": signals}).drop(
        "t_airports", "t_routes", "t_airlines"
    )


def _places(airports: Column, routes: Column) -> Column:
    """Where an article may meet a movement: nowhere, at one airport, at both, or on a route; with airports hit and route hit.

    An article on a route hits those of its ends that it names, so a route needs no other entry.
    """
    place = lambda key, hits, route: F.struct(key.alias("key"), hits.cast("int").alias("hits"), F.lit(route).alias("route"))
    pairs = F.flatten(
        F.transform(
            airports,
            lambda a: F.transform(
                F.filter(airports, lambda b: b > a), lambda b: place(F.concat(F.lit("A:"), a, F.lit("|"), b), F.lit(2), False)
            ),
        )
    )
    ends = lambda r: F.size(F.array_intersect(F.split(r, "-"), airports))
    return F.concat(
        F.array(place(F.lit(""), F.lit(0), False)),
        F.transform(airports, lambda a: place(F.concat(F.lit("A:"), a), F.lit(1), False)),
        pairs,
        F.transform(routes, lambda r: place(F.concat(F.lit("R:"), r), ends(r), True)),
    )


def top_lists(nearby: DataFrame, config: MatchingConfig, with_rosters: bool) -> DataFrame:
    """The best `top_n` articles per date, roster class, place and carrier: (as_of, roster_known, meeting, article columns).

    A list is ranked by what its articles score for a movement that they meet in this place, over this carrier and nowhere
    else. An article in two airports, a route and two carriers stands in a dozen lists, and a list has `top_n` rows at most.
    """
    tagged = _tidied(nearby)
    airports, routes, airlines = (F.array_distinct(F.coalesce(F.col(f"t_{k}"), F.array().cast("array<string>"))) for k in ("airports", "routes", "airlines"))
    named = F.size(airlines) > 0
    carrier = lambda key, worth, known: F.struct(key.alias("key"), worth.cast("double").alias("worth"), F.lit(known).alias("known"))
    carriers = [F.array(carrier(F.lit(""), F.when(named, 0.5).otherwise(0.0), False))]
    if with_rosters:
        carriers.append(F.array(carrier(F.lit(""), F.when(named, 0.25).otherwise(0.0), True)))
        carriers.append(F.transform(airlines, lambda x: carrier(F.concat(F.lit("L:"), x), F.lit(1.0), True)))
    spread = tagged.withColumn("named_airport", F.size(airports) > 0).withColumn("carrier", F.explode(F.concat(*carriers)))
    spread = spread.withColumn("place", F.explode(_places(airports, routes)))
    worth = _total(
        [
            (config.weight_date, _date_score(config)),
            (config.weight_airport, F.col("place.hits") / 2.0),
            (config.weight_route, F.col("place.route").cast("double")),
            (config.weight_airline, F.col("carrier.worth")),
            (config.weight_event, event_score(F.col("event_type"))),
            (config.weight_geography, F.when(~F.col("named_airport"), 0.5).when(F.col("place.hits") > 0, 1.0).otherwise(0.0)),
        ]
    )
    listed = spread.select(
        "as_of",
        F.col("carrier.known").alias("roster_known"),
        F.concat("place.key", F.lit("#"), "carrier.key").alias("meeting"),
        worth.alias("worth"),
        *ARTICLE_COLUMNS,
    ).filter(F.col("worth") >= config.min_relevance)
    order = W.partitionBy("as_of", "roster_known", "meeting").orderBy(F.desc("worth"), F.desc("published_at"), "url")
    return listed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= config.top_n).drop("place", "worth")


def rank_articles(moves: DataFrame, articles: DataFrame, config: MatchingConfig = MatchingConfig()) -> DataFrame:
    """The top articles of every movement, best first; ties go to the newer, then by address.

    Articles are cut to `top_lists` before they meet any movement, so the pairs of articles and routes of an airport are never
    formed: a movement meets at most `top_n` articles in each of six places over each carrier of its roster. That is
    enough by a threshold rule. Take an article in the list of exactly what it shares with a movement: there it stands with
    its true score. Whatever precedes it in that list scores at least as much for the movement, as sharing more only
    raises a score, and wins its ties. So an article cut from that list has `top_n` better ones.

    A movement's route is its origin and destination joined by a dash. A null roster is a class of its own.
    """
    has_roster = "airlines_on_route" in moves.columns
    moves = stage(moves, "movements")  # one row per route and month, read by the window and by the join
    nearby = first_by_url(in_window(moves, with_article_columns(articles), config.date_window_days))
    lists = top_lists(nearby, config, has_roster)

    o, d = F.upper("origin"), F.upper("destination")
    ends = F.concat(F.lit("A:"), F.least(o, d), F.lit("|"), F.greatest(o, d))
    route = F.array(F.concat(F.lit("R:"), F.upper("route")), F.concat(F.lit("R:"), d, F.lit("-"), o))
    places = F.concat(F.array(F.lit(""), F.concat(F.lit("A:"), o), F.concat(F.lit("A:"), d), ends), route)
    roster = tidy(F.col("airlines_on_route")) if has_roster else F.array().cast("array<string>")
    roster = F.coalesce(roster, F.array().cast("array<string>"))
    carriers = F.concat(F.array(F.lit("")), F.transform(roster, lambda x: F.concat(F.lit("L:"), x)))
    met = F.flatten(F.transform(places, lambda p: F.transform(carriers, lambda c: F.concat(p, F.lit("#"), c))))
    known = F.col("airlines_on_route").isNotNull() if has_roster else F.lit(False)
    asked = moves.withColumn("roster_known", known).withColumn("meeting", F.explode(F.array_distinct(F.array_compact(met))))
    pairs = asked.join(lists, ["as_of", "roster_known", "meeting"]).drop("roster_known", "meeting")

    scored = score(pairs, config).filter(F.col("relevance_score") >= config.min_relevance)
    rest = [c for c in scored.columns if c not in (*MOVEMENT_KEY, "url")]
    single = scored.groupBy(*MOVEMENT_KEY, "url").agg(F.min(F.struct(*rest)).alias("row"))
    single = single.select(*MOVEMENT_KEY, "url", "row.*")
    best_first = W.partitionBy(*MOVEMENT_KEY).orderBy(F.desc("relevance_score"), F.desc("published_at"), "url")
    return single.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= config.top_n)


def potential_factors(ranked: DataFrame) -> DataFrame:
    """Distinct event types per movement in the order of the ranked articles (at most top_n each)."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "event_type")))
    types = F.array_distinct(F.transform(listed, lambda x: x["event_type"]))
    return ranked.groupBy(*MOVEMENT_KEY).agg(types.alias("factors"))


def attach_context(
    inflation: DataFrame,
    articles: DataFrame,
    as_of: Column,
    metric: str = "mom",
    config: MatchingConfig = MatchingConfig(),
    threshold: float | None = None,
) -> DataFrame:
    """Ranked articles of all significant movements of all months, in one plan."""
    limit = config.significance_threshold_pct if threshold is None else threshold
    moves = movements(inflation, as_of, metric).filter(is_significant(F.col("change_pct"), limit))
    return rank_articles(moves, articles, config)


def context_records(moves: DataFrame, ranked: DataFrame) -> DataFrame:
    """One nested record per movement: factors with labels, ranked news, disclaimer."""
    news = F.struct(
        "rank", "headline", "source", "published_at", "url", "summary", "event_type",
        "relevance_score", "confidence_score", "is_mock",
    )
    lists = ranked.groupBy(*MOVEMENT_KEY).agg(F.sort_array(F.collect_list(news)).alias("related_news"))
    types = F.array_distinct(F.transform("related_news", lambda x: x["event_type"]))
    factors = F.transform(types, lambda t: F.struct(t.alias("event_type"), event_label(t).alias("label")))
    out = moves.join(lists, list(MOVEMENT_KEY), "left")
    return out.withColumn("potential_related_factors", factors).withColumn("disclaimer", F.lit(DISCLAIMER))


def route_context(
    moves: DataFrame, ranked: DataFrame, route: str, threshold: float, among: DataFrame | None = None
) -> DataFrame:
    """Context of one route: direction up or down, significance and its articles. An unknown route fails the query.

    `among` has all routes where `moves` were filtered: a route without a movement left has no context, but isn't unknown.
    """
    one = context_records(known(moves, "route", route, among), ranked.filter(F.col("route") == route))
    return one.withColumns(
        {
            "significant_movement": is_significant(F.col("change_pct"), threshold),
            "movement_direction": F.when(F.col("direction") == "increase", "up").otherwise("down"),
        }
    )


# --- Signals -----------------------------------------------------------------------------------

SignalProvider = Callable[[DataFrame], DataFrame]


def news_signal(articles: DataFrame, config: MatchingConfig = MatchingConfig()) -> SignalProvider:
    """News as a context signal: movements -> (route, period, metric, signal_name, items, summary)."""

    def provide(moves: DataFrame) -> DataFrame:
        records = context_records(moves, rank_articles(moves, articles, config))
        n = F.coalesce(F.size("related_news"), F.lit(0))
        n = F.when(n > 0, n).otherwise(0)
        text = F.when(n > 0, F.concat(n.cast("string"), F.lit(" related article(s)"))).otherwise("no related article")
        return records.select(
            *MOVEMENT_KEY,
            F.lit("news").alias("signal_name"),
            F.coalesce(F.to_json("related_news"), F.lit("[]")).alias("items"),
            text.alias("summary"),
        )

    return provide


def combine_signals(moves: DataFrame, providers: Sequence[SignalProvider]) -> DataFrame:
    """All providers' results in one table, keyed by signal name."""
    parts = [provider(moves) for provider in providers]
    if not parts:
        raise ValueError("no signal provider given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
