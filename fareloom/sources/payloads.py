"""Landed responses of fare and news sources, parsed with built-in JSON expressions.

Input is one row per response: the request's columns and `payload`, the response text. Nothing
here calls a source. A response is one document, so its arrays stay within one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CARRIER_NAMES, EVENT_KEYWORDS
from ..functions import columns as C
from ..functions.news_text import classify_event, is_valid_article



LEG = "struct<airline: string, departure_airport: struct<time: string>>"
ITINERARY = f"struct<flights: array<{LEG}>, price: string, total_duration: double, booking_token: string>"
RESPONSE = f"error string, best_flights array<{ITINERARY}>, other_flights array<{ITINERARY}>"


def _unread_status(payload: Column) -> Column:
    """Status of a text that gave no itinerary list; parsed in full only for such rows."""
    doc = F.try_parse_json(payload)
    return F.when(doc.isNull(), "PARSE_ERROR").when(~F.schema_of_variant(doc).startswith("OBJECT"), "MALFORMED_RESPONSE")


def _itineraries(df: DataFrame) -> DataFrame:
    """One parse with a declared schema; a list of another kind reads as null and is told apart after."""
    read = df.withColumn("doc", F.from_json("payload", RESPONSE))
    none = F.array().cast(f"array<{ITINERARY}>")
    lists = [F.col("doc.best_flights"), F.col("doc.other_flights")]
    listed = read.withColumn("listed", F.concat(*[F.coalesce(x, none) for x in lists]))

    def observation(it: Column) -> Column:
        return F.struct(
            F.try_element_at(it["flights"], F.lit(1))["airline"].alias("airline"),
            F.split(F.try_element_at(it["flights"], F.lit(1))["departure_airport"]["time"], " ")[0].alias("flight_date"),
            C.as_number(it["price"]).alias("total_fare"),
            (F.size(it["flights"]) - 1).alias("stops"),
            it["total_duration"].alias("duration"),
            it["booking_token"].alias("token"),
        )

    parsed = F.transform("listed", observation)
    good = F.filter(
        parsed, lambda o: o["airline"].isNotNull() & o["flight_date"].isNotNull() & o["total_fare"].isNotNull()
    )
    wrong_kind = C.any_of(
        x.isNull() & F.get_json_object("payload", f"$.{name}").isNotNull()
        for x, name in zip(lists, ("best_flights", "other_flights"))
    )
    status = (
        F.when(F.col("doc.error").isNotNull(), "SOURCE_UNAVAILABLE")
        .when(F.size("good") > 0, F.when(wrong_kind, "MALFORMED_RESPONSE").otherwise("SUCCESS"))
        .when(F.size("listed") > 0, F.when(wrong_kind, "MALFORMED_RESPONSE").otherwise("PARSE_ERROR"))
        .otherwise(
            F.coalesce(_unread_status(F.col("payload")), F.when(wrong_kind, "MALFORMED_RESPONSE"), F.lit("EMPTY_RESULT"))
        )
    )
    return listed.withColumn("good", good).withColumn("status", status)


def itinerary_statuses(df: DataFrame) -> DataFrame:
    """Request columns, status and number of observations per response."""
    n = F.when(F.col("status") == "SUCCESS", F.size("good")).otherwise(0)
    kept = [c for c in df.columns if c != "payload"]
    return _itineraries(df).select(*kept, "status", n.alias("observation_count"))


def parse_itineraries(df: DataFrame, source: str = "serpapi_google_flights", prefix: str = "serpapi") -> DataFrame:
    """Observations of search responses. The first leg gives airline and date; bad itineraries drop out."""
    # Generated outer and filtered after: a filter on the status would be pushed below the parse and
    # repeat it.
    found = F.when(F.col("status") == "SUCCESS", F.col("good"))
    rows = _itineraries(df).withColumn("o", F.explode_outer(found)).filter(F.col("o.airline").isNotNull())
    tail = F.when(F.length("o.token") > 0, F.col("o.token")).otherwise(
        F.concat_ws("_", F.col("o.airline"), F.col("o.total_fare").cast("string"))
    )
    return rows.select(
        F.concat_ws("_", F.lit(prefix), "origin", "destination", "o.flight_date", tail).alias("observation_id"),
        "o.airline",
        "origin",
        "destination",
        "o.flight_date",
        F.col("booking_date").cast("string").alias("booking_date"),
        "o.total_fare",
        F.lit("INR").alias("currency"),
        F.lit(source).alias("source"),
        "o.stops",
        "o.duration",
    )


def _calendar(df: DataFrame) -> DataFrame:
    """The asked day's entry as text, then its two fields."""
    days = F.from_json("payload", "day map<string,string>")["day"]
    entry = F.try_element_at(days, F.col("flight_date").cast("string"))
    read = df.withColumn("days", days).withColumn("entry", entry)
    read = read.withColumn("fields", F.from_json("entry", "lf string, la string"))
    fare, code = C.as_number(F.col("fields.lf")), F.col("fields.la")
    status = (
        F.when(F.col("days").isNull(), "MALFORMED_RESPONSE")
        .when(F.col("entry").isNull() | (F.regexp_replace("entry", r"\s", "") == "{}"), "EMPTY_RESULT")
        .when(fare.isNull() | code.isNull(), "PARSE_ERROR")
        .otherwise("SUCCESS")
    )
    return read.withColumns({"status": status, "fare": fare, "code": code})


def calendar_statuses(df: DataFrame) -> DataFrame:
    return _calendar(df).select(*[c for c in df.columns if c != "payload"], "status")


def parse_fare_calendar(df: DataFrame, source: str = "yatra") -> DataFrame:
    """The lowest fare of the asked day, one observation per response that has it."""
    flight = F.col("flight_date").cast("string")
    found = F.when(F.col("status") == "SUCCESS", F.struct("fare", "code"))
    rows = _calendar(df).withColumn("o", F.explode_outer(F.array(found))).filter(F.col("o").isNotNull())
    code = F.col("o.code")
    carrier = C.first_reason([(name, code == short) for short, name in CARRIER_NAMES]).otherwise(code)
    return (
        rows.select(
            F.concat_ws("_", F.lit(source), "origin", "destination", flight, code, F.lit("lowest")).alias(
                "observation_id"
            ),
            carrier.alias("airline"),
            "origin",
            "destination",
            flight.alias("flight_date"),
            F.col("booking_date").cast("string").alias("booking_date"),
            F.col("o.fare").alias("total_fare"),
            F.lit("INR").alias("currency"),
            F.lit(source).alias("source"),
            F.lit("LOWEST_OF_DAY").alias("fare_type"),
        )
    )


def _article_rows(df: DataFrame, list_name: str, fields: str) -> DataFrame:
    parsed = F.from_json("payload", f"{list_name} array<struct<{fields}>>")
    return df.select(F.explode(parsed[list_name]).alias("a")).select("a.*")


def _article(url: str, title: str, at: Column, source: Column, text: Column, summary: Column, keywords) -> list[Column]:
    return [
        F.col(title).alias("headline"),
        F.coalesce(source, F.lit("unknown")).alias("source"),
        at.alias("published_at"),
        F.col(url).alias("url"),
        classify_event(text, keywords).alias("event_type"),
        summary.alias("summary"),
        F.lit(False).alias("is_mock"),
    ]


def _kept(rows: DataFrame) -> DataFrame:
    named = (F.length("url") > 0) & (F.length("headline") > 0) & F.col("published_at").isNotNull()
    return rows.filter(named & is_valid_article(F.col("url"), F.col("event_type")))


def parse_articles_feed_a(df: DataFrame, keywords=EVENT_KEYWORDS) -> DataFrame:
    """Feed with `articles` of url, title, seendate (yyyyMMddHHmmss) and domain."""
    rows = _article_rows(df, "articles", "url string, title string, seendate string, domain string")
    at = F.try_to_timestamp(F.col("seendate"), F.lit("yyyyMMddHHmmss"))
    domain = F.when(F.length("domain") > 0, F.col("domain"))
    none = F.lit(None).cast("string")
    return _kept(rows.select(*_article("url", "title", at, domain, F.col("title"), none, keywords)))


def parse_articles_feed_b(df: DataFrame, start: Column, end: Column, keywords=EVENT_KEYWORDS) -> DataFrame:
    """Feed with `results` of link, title, pubDate, description; only the asked window is kept."""
    rows = _article_rows(
        df,
        "results",
        "link string, title string, pubDate string, description string, source_name string, source_id string",
    )
    at = F.try_to_timestamp(F.col("pubDate"), F.lit("yyyy-MM-dd HH:mm:ss"))
    full = lambda name: F.when(F.length(name) > 0, F.col(name))
    text = F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit("")))
    source = F.coalesce(full("source_name"), full("source_id"))
    columns = _article("link", "title", at, source, text, full("description"), keywords)
    return _kept(rows.select(*columns)).filter(F.col("published_at").between(start, end))
