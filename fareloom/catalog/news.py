"""News context: classification, matching and ranking over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MatchingConfig
from ..constants import EVENT_LABELS
from ..functions.news_text import classify_event, is_valid_article
from ..operators import news
from ..session import stage, tune
from ..sources import domain_views as V
from ..sources import payloads
from . import views as S
from .index import price_index, rd

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# The warehouse's documents are invented prose without the default words, so a table of words that
# do occur is passed instead.
WORDS = (
    ("STRIKE", ("license", "copyright")),
    ("WEATHER_DISRUPTION", ("@", "http")),
    ("FUEL_PRICE_CHANGE", ("password", "token", "key")),
    ("FLIGHT_CANCELLATION", ("ough", "ttle")),
    ("CAPACITY_REDUCTION", ("eaux", "tion")),
    ("GEOPOLITICAL_EVENT", ("und", "ich")),
    ("AIRPORT_DISRUPTION", ("ado", "iendo")),
)


def _event_sql(text: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{event}'" for event, words in WORDS
    )
    return f"CASE {cases} ELSE 'OTHER' END"


@query(
    "classify_events",
    f"SELECT doc_id, {_event_sql('text')} AS event_type FROM documents",
)
def _classify(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", classify_event(F.col("text"), WORDS).alias("event_type"))


@query(
    "valid_articles",
    """SELECT page_id, url, regexp_matches(lower(url), '^https?://[^/?#\\s]+') AS valid FROM pages""",
)
def _valid(spark, sf):
    pages = V.table(spark, sf, "pages")
    return pages.select("page_id", "url", is_valid_article(F.col("url"), F.lit("OTHER")).alias("valid"))


@query(
    "dedup_by_url",
    f"""WITH a AS ({S.ARTICLES}) SELECT url, min(published_at)::VARCHAR[1:10] AS first_day, count(*) AS n FROM a GROUP BY 1""".replace(
        "min(published_at)::VARCHAR[1:10]", "strftime(min(published_at), '%Y-%m-%d')"
    ),
)
def _dedup(spark, sf):
    arts = V.articles(spark, sf).select("url", "published_at", "doc_id").withColumn("as_of", F.lit("all"))
    copies = arts.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    first = news.first_by_url(arts).select("url", F.date_format("published_at", "yyyy-MM-dd").alias("first_day"))
    return first.join(copies, "url")


# --- Movements and matching --------------------------------------------------------------------

_MONTH_END = "CAST(last_day(make_date(CAST((month_ord - 1) // 12 AS INTEGER), CAST((month_ord - 1) % 12 + 1 AS INTEGER), 1)) AS TIMESTAMP)"
_MOVES = f"""moves AS (SELECT route, split_part(route, '-', 1) AS o, split_part(route, '-', 2) AS d, mom AS change_pct, period, month_ord,
 {_MONTH_END} AS as_of FROM inflation WHERE mom IS NOT NULL AND abs(mom) >= 5.0)"""
_ARTS = f"""arts0 AS ({S.ARTICLES}), arts AS (SELECT headline, source, published_at, url, {_event_sql('body')} AS event_type,
 related_airlines, related_airports, related_routes FROM arts0)"""
_DEMAND = S.names(
    ("FLIGHT_CANCELLATION", "CAPACITY_REDUCTION", "WEATHER_DISRUPTION", "AIRPORT_DISRUPTION", "AIRLINE_OPERATIONAL_ISSUE", "STRIKE")
)
_MATCH = f"""near AS (SELECT m.route, m.o, m.d, m.period, m.change_pct, m.as_of, a.*, row_number() OVER (PARTITION BY m.route, m.period, a.url
  ORDER BY published_at, headline, source, event_type) AS seen FROM moves m JOIN arts a ON a.published_at BETWEEN m.as_of - INTERVAL 10 DAY AND m.as_of + INTERVAL 10 DAY),
parts AS (SELECT *, abs(epoch(published_at) - epoch(as_of)) / 86400 AS away, list_contains(related_airports, o) AS ho, list_contains(related_airports, d) AS hd,
  list_contains(related_routes, route) OR list_contains(related_routes, d || '-' || o) AS hr, len(related_airports) AS na, len(related_airlines) AS nl
  FROM near WHERE seen = 1),
scored AS (SELECT *, round(0.25::DOUBLE * CASE WHEN away >= 10 THEN 0 ELSE 1 - away / 10 END + 0.25::DOUBLE * ((ho::INT + hd::INT) / 2.0) + 0.15::DOUBLE * hr::INT
  + 0.15::DOUBLE * CASE WHEN nl > 0 THEN 0.5 ELSE 0 END
  + 0.10::DOUBLE * CASE WHEN event_type IN {_DEMAND} THEN 1 WHEN event_type = 'OTHER' THEN 0 ELSE 0.5 END
  + 0.10::DOUBLE * CASE WHEN na = 0 THEN 0.5 WHEN ho OR hd THEN 1 ELSE 0 END, 4) AS score,
  concat_ws(',', CASE WHEN away < 10 THEN 'date_proximity' END, CASE WHEN ho THEN 'airport:origin' END, CASE WHEN hd THEN 'airport:destination' END,
    CASE WHEN hr THEN 'route' END, CASE WHEN nl > 0 THEN 'airline:mentioned' END, CASE WHEN event_type <> 'OTHER' THEN 'event_type:' || event_type END,
    CASE WHEN na = 0 THEN 'geographic:national' WHEN ho OR hd THEN 'geographic:route_specific' END) AS signals FROM parts),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route, period ORDER BY score DESC, published_at DESC, url) AS rank
  FROM scored WHERE score >= 0.35) WHERE rank <= 5)"""
_CONTEXT = S.index_ctes() + f", {_MOVES}, {_ARTS}, {_MATCH} "


def month_end():
    """Last day of the movement's month: the date it is judged at."""
    first = F.to_date(F.concat(F.col("period"), F.lit("-01")))
    return F.last_day(first).cast("timestamp")


def articles(spark, sf):
    return V.articles(spark, sf).withColumn("event_type", classify_event(F.col("body"), WORDS)).drop("body", "doc_id")


def every_move(spark, sf):
    return news.movements(price_index(spark, sf).inflation(), month_end())


def moves(spark, sf):
    return stage(every_move(spark, sf).filter(news.is_significant(F.col("change_pct"), 5.0)), "movements")


@query(
    "movements",
    S.index_ctes()
    + f", {_MOVES} SELECT route, period, {S.r('change_pct')} AS change_pct, CASE WHEN change_pct >= 0 THEN 'increase' ELSE 'decrease' END AS direction, strftime(as_of, '%Y-%m-%d') AS as_of FROM moves",
)
def _moves(spark, sf):
    return moves(spark, sf).select("route", "period", rd("change_pct"), "direction", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


@query(
    "news_context",
    _CONTEXT
    + "SELECT route, period, rank, url, strftime(published_at, '%Y-%m-%d') AS published, event_type, score + 0.0 AS relevance_score, signals FROM ranked",
)
def _context(spark, sf):
    rows = news.attach_context(price_index(spark, sf).inflation(), articles(spark, sf), month_end())
    return rows.select(
        "route", "period", F.col("rank").cast("long").alias("rank"), "url",
        F.date_format("published_at", "yyyy-MM-dd").alias("published"), "event_type", "relevance_score",
        F.array_join("matched_signals", ",").alias("signals"),
    )


_ROSTER = V.CARRIERS[:2]
_FLIES = f"list_has_any(related_airlines, {S.array(_ROSTER)})"
_ROSTER_MATCH = _MATCH.replace(
    "CASE WHEN nl > 0 THEN 0.5 ELSE 0 END", f"CASE WHEN nl = 0 THEN 0 WHEN o >= d THEN 0.5 WHEN {_FLIES} THEN 1 ELSE 0.25 END"
).replace(
    "CASE WHEN nl > 0 THEN 'airline:mentioned' END",
    f"CASE WHEN nl > 0 THEN CASE WHEN o >= d THEN 'airline:mentioned' WHEN {_FLIES} THEN 'airline:operates_route' ELSE 'airline:unrelated' END END",
)


@query(
    "news_context_roster",
    S.index_ctes()
    + f", {_MOVES}, {_ARTS}, {_ROSTER_MATCH} SELECT route, period, rank, url, event_type, score + 0.0 AS relevance_score, signals FROM ranked",
)
def _roster(spark, sf):
    """Two carriers are known for routes in alphabetical order; of the others the roster is unknown."""
    known = F.when(F.col("origin") < F.col("destination"), F.array(*[F.lit(c) for c in _ROSTER]))
    rows = news.rank_articles(moves(spark, sf).withColumn("airlines_on_route", known), articles(spark, sf))
    return rows.select(
        "route", "period", F.col("rank").cast("long").alias("rank"), "url", "event_type", "relevance_score",
        F.array_join("matched_signals", ",").alias("signals"),
    )


@query(
    "potential_factors",
    _CONTEXT
    + """, firsts AS (SELECT route, period, event_type, min(rank) AS r FROM ranked GROUP BY 1, 2, 3)
    SELECT route, period, string_agg(event_type, ',' ORDER BY r) AS factors FROM firsts GROUP BY 1, 2""",
)
def _factors(spark, sf):
    rows = news.potential_factors(news.rank_articles(moves(spark, sf), articles(spark, sf)))
    return rows.select("route", "period", F.array_join("factors", ",").alias("factors"))


_LABEL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{label}'" for e, label in EVENT_LABELS) + " ELSE event_type END"


@query(
    "context_records",
    _CONTEXT
    + f""", listed AS (SELECT route, period, string_agg(rank || ' ' || url || ' ' || event_type || ' ' || CAST(round(score * 10000) AS BIGINT), ',' ORDER BY rank) AS news FROM ranked GROUP BY 1, 2),
    firsts AS (SELECT route, period, {_LABEL} AS label, min(rank) AS r FROM ranked GROUP BY 1, 2, 3),
    factors AS (SELECT route, period, string_agg(label, ',' ORDER BY r) AS factors FROM firsts GROUP BY 1, 2)
    SELECT m.route, m.period, coalesce(news, '') AS news, coalesce(factors, '') AS factors FROM moves m LEFT JOIN listed USING (route, period) LEFT JOIN factors USING (route, period)""",
)
def _records(spark, sf):
    m = moves(spark, sf)
    rows = news.context_records(m, news.rank_articles(m, articles(spark, sf)))
    entry = lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["url"], x["event_type"], F.round(x["relevance_score"] * 10000).cast("long").cast("string"))
    labels = F.array_join(F.transform("potential_related_factors", lambda x: x["label"]), ",")
    listed = F.array_join(F.transform("related_news", entry), ",")
    return rows.select("route", "period", F.coalesce(listed, F.lit("")).alias("news"), F.coalesce(labels, F.lit("")).alias("factors"))


@query(
    "context_signals",
    _CONTEXT
    + """, listed AS (SELECT route, period, count(*) AS n, string_agg(url, ',' ORDER BY rank) AS urls FROM ranked GROUP BY 1, 2)
    SELECT route, period, 'mom' AS metric, 'news' AS signal_name, coalesce(urls, '') AS items,
      CASE WHEN n > 0 THEN n || ' related article(s)' ELSE 'no related article' END AS summary FROM moves LEFT JOIN listed USING (route, period)
    UNION ALL SELECT route, period, 'mom', 'size', '', CASE WHEN abs(change_pct) >= 10 THEN 'large' ELSE 'moderate' END FROM moves""",
)
def _signals(spark, sf):
    providers = [news.news_signal(articles(spark, sf)), _movement_size]
    rows = news.combine_signals(moves(spark, sf), providers)
    urls = F.transform(F.from_json("items", "array<struct<url string>>"), lambda x: x["url"])
    return rows.withColumn("items", F.array_join(urls, ","))


def _movement_size(rows):
    """A second, trivial signal next to the news."""
    return rows.select(
        *news.MOVEMENT_KEY,
        F.lit("size").alias("signal_name"),
        F.lit("[]").alias("items"),
        F.when(F.abs("change_pct") >= 10, "large").otherwise("moderate").alias("summary"),
    )


@query(
    "route_context",
    _CONTEXT
    + f"""SELECT m.route, m.period, CASE WHEN m.change_pct >= 0 THEN 'up' ELSE 'down' END AS movement_direction, {S.r('m.change_pct')} AS movement_pct, true AS significant_movement,
    count(r.url) AS events FROM moves m LEFT JOIN ranked r ON r.route = m.route AND r.period = m.period WHERE m.route = 'DEL-BOM' GROUP BY 1, 2, 3, 4""",
)
def _route(spark, sf):
    every, limit = stage(every_move(spark, sf), "movements"), MatchingConfig().significance_threshold_pct
    m = every.filter(news.is_significant(F.col("change_pct"), limit))
    rows = news.route_context(m, news.rank_articles(m, articles(spark, sf)), "DEL-BOM", limit, among=every)
    n = F.coalesce(F.size("related_news"), F.lit(0))
    return rows.select(
        "route", "period", "movement_direction", F.round("change_pct", 6).alias("movement_pct"), "significant_movement",
        F.greatest(n, F.lit(0)).cast("long").alias("events"),
    )


# --- Landed feeds ------------------------------------------------------------------------------


def _feed(spark, sf, list_name: str, fields: dict):
    """Response texts of a feed, built from the documents: one response per document."""
    entry = F.struct(*[value.alias(name) for name, value in fields.items()])
    return V.articles(spark, sf).select(F.to_json(F.struct(F.array(entry).alias(list_name))).alias("payload"))


_FEED_KEPT = "doc_id % 7 <> 0 AND doc_id % 11 <> 0"


@query(
    "parse_feed_a",
    f"""WITH a AS (SELECT * REPLACE (regexp_replace(body, '\\s+', ' ', 'g') AS headline) FROM ({S.ARTICLES}))
    SELECT url, headline, strftime(published_at, '%Y-%m-%d') AS day, source, {_event_sql('headline')} AS event_type
    FROM a WHERE {_FEED_KEPT} AND length(headline) > 0""",
)
def _feed_a(spark, sf):
    """This feed has no text beside its title, so the whole text stands there and is classified."""
    doc = F.col("doc_id")
    raw = _feed(spark, sf, "articles", {
        "url": F.when(doc % 7 == 0, F.lit("not a url")).otherwise(F.col("url")),
        "title": F.regexp_replace("body", r"\s+", " "),
        "seendate": F.when(doc % 11 == 0, "yesterday").otherwise(F.date_format("published_at", "yyyyMMddHHmmss")),
        "domain": F.col("source"),
    })
    rows = payloads.parse_articles_feed_a(raw, WORDS)
    return rows.select("url", "headline", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "source", "event_type")


@query(
    "parse_feed_b",
    f"""WITH a AS ({S.ARTICLES}) SELECT url, strftime(published_at, '%Y-%m-%d') AS day, {_event_sql("headline || ' ' || body")} AS event_type
    FROM a WHERE {_FEED_KEPT} AND length(headline) > 0 AND published_at BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1999-03-01'""",
)
def _feed_b(spark, sf):
    doc = F.col("doc_id")
    raw = _feed(spark, sf, "results", {
        "link": F.when(doc % 7 == 0, F.lit("ftp://host/x")).otherwise(F.col("url")),
        "title": F.col("headline"),
        "pubDate": F.when(doc % 11 == 0, "").otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")),
        "description": F.col("body"),
        "source_id": F.col("source"),
    })
    lo, hi = (F.lit(t).cast("timestamp") for t in ("1998-03-01 00:00:00", "1999-03-01 00:00:00"))
    rows = payloads.parse_articles_feed_b(raw, lo, hi, WORDS)
    return rows.select("url", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "event_type")
