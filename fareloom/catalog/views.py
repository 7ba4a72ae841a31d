"""SQL twins of `sources.domain_views` and of the index plan, as chains of common table expressions."""

from __future__ import annotations

from ..constants import AIRPORTS, BOOKING_WINDOWS, HORIZON_BUCKETS, METROS
from ..sources.domain_views import CARRIERS, NATION_CITIES, NATION_CODES, REGION_CODES

BASE = "1996-01"
CURRENT = "1998-08"
BASE_ORD = 1996 * 12 + 1
CURRENT_ORD = 1998 * 12 + 8


def array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def period(m: str) -> str:
    return f"printf('%04d-%02d', CAST(({m} - 1) // 12 AS INTEGER), CAST(({m} - 1) % 12 + 1 AS INTEGER))"


def band(days: str, bands, otherwise: str) -> str:
    cases = " ".join(
        f"WHEN {days} >= {lo}" + ("" if hi is None else f" AND {days} <= {hi}") + f" THEN '{label}'"
        for label, lo, hi in bands
    )
    return f"CASE {cases} ELSE {otherwise} END"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


_FARE = (
    "floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100"
    " * CASE WHEN l_partkey % 97 = 0 THEN 6.0::DOUBLE ELSE 1.0::DOUBLE END"
)
_AIRLINE = (
    "CASE WHEN l_suppkey % 6 = 5 THEN 'Brand#' || (l_partkey % 25 + 1)"
    f" ELSE {array(CARRIERS)}[least(l_suppkey % 6, 4) + 1] END"
)
_ID4 = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


def _joined(level: str) -> str:
    if level == "region":
        ends = (
            f"{array(REGION_CODES)}[ns.n_regionkey + 1] AS origin, {array(REGION_CODES)}[nc.n_regionkey + 1] AS destination"
        )
    else:
        ends = f"{array(NATION_CODES)}[s_nationkey + 1] AS origin, {array(NATION_CODES)}[c_nationkey + 1] AS destination"
    return f"""(SELECT l.*, o_orderdate, {ends} FROM lineitem l
      JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ns ON s_nationkey = ns.n_nationkey
      JOIN nation nc ON c_nationkey = nc.n_nationkey)"""


def fares(level: str = "region") -> str:
    return f"""SELECT {_ID4} AS observation_id, {_AIRLINE} AS airline, origin, destination,
      CAST(l_shipdate AS DATE) AS flight_date,
      CAST(l_shipdate AS DATE) - CAST(l_partkey % 75 AS INTEGER) AS booking_date,
      {_FARE} AS total_fare, 'INR' AS currency FROM {_joined(level)}"""


def fares_dirty() -> str:
    ship = "strftime(l_shipdate, '%Y-%m-%d')"
    order = "strftime(o_orderdate, '%Y-%m-%d')"
    early = "strftime(CAST(l_shipdate AS DATE) - CAST(l_partkey % 75 AS INTEGER), '%Y-%m-%d')"
    return f"""SELECT
      CASE WHEN l_partkey % 61 = 0 THEN '' ELSE l_orderkey || '-' || l_linenumber END AS observation_id,
      CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE {_AIRLINE} END AS airline,
      CASE WHEN l_partkey % 89 = 0 THEN 'zzz' WHEN l_partkey % 83 = 0 THEN 'X1'
           WHEN l_linenumber = 7 AND l_partkey % 11 = 0 THEN ' ' ELSE origin END AS origin,
      CASE WHEN l_partkey % 59 = 0 THEN NULL ELSE destination END AS destination,
      CASE WHEN l_partkey % 71 = 0 THEN 'not-a-date' ELSE {ship} END AS flight_date,
      CASE WHEN l_partkey % 73 = 0 THEN '' WHEN l_linenumber <= 4 THEN {early} ELSE {order} END AS booking_date,
      CASE WHEN l_partkey % 79 = 0 THEN -({_FARE}) ELSE {_FARE} END AS total_fare,
      CASE WHEN l_partkey % 67 = 0 THEN ' ' WHEN l_suppkey % 17 = 0 THEN 'USD' ELSE 'INR' END AS currency,
      {order} AS timestamp, l_returnflag AS source,
      CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'Economy' END AS fare_class FROM {_joined("region")}"""


def fares_grouped() -> str:
    return f"""SELECT {_ID4} AS observation_id, {array(CARRIERS)}[l_suppkey % 2 + 1] AS airline, origin, destination,
      strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS flight_date,
      strftime(CAST(date_trunc('month', l_shipdate) AS DATE) - 30, '%Y-%m-%d') AS booking_date,
      {_FARE} AS total_fare, 'INR' AS currency, strftime(o_orderdate, '%Y-%m-%d') AS timestamp,
      l_returnflag AS source, 'Economy' AS fare_class FROM {_joined("region")}"""


TRAFFIC = f"""SELECT year(o_orderdate) AS "Year", month(o_orderdate) AS "Month", least(a, b) AS "City1",
  greatest(a, b) AS "City2", sum(CASE WHEN a <= b THEN l_quantity ELSE 0 END) AS "PaxToCity2",
  sum(CASE WHEN a > b THEN l_quantity ELSE 0 END) AS "PaxFromCity2"
  FROM (SELECT o_orderdate, l_quantity, {array(NATION_CITIES)}[s_nationkey + 1] AS a,
        {array(NATION_CITIES)}[c_nationkey + 1] AS b
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey) GROUP BY ALL"""

CALLS = f"""SELECT event_id AS call_id, 'source_' || (user_id % 5) AS source,
  {array(NATION_CODES)}[user_id % 25 + 1] || '-' || {array(NATION_CODES)}[(user_id * 7 + 3) % 25 + 1] AS route,
  CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'HTTP_ERROR' WHEN 'click' THEN 'EMPTY_RESULT'
    WHEN 'view' THEN 'TIMEOUT' ELSE 'RATE_LIMITED' END AS status,
  CASE WHEN event_type = 'purchase' THEN event_id % 4 + 1 ELSE 0 END AS n_observations, ts AS called_at FROM events"""

ARTICLES = f"""SELECT regexp_replace(coalesce(nullif(regexp_extract(text, '[^.]*[^.\\x20\\x09-\\x0D][^.]*', 0), ''), text), '\\s+', ' ', 'g') AS headline, source,
  TIMESTAMP '1998-01-01 00:00:00' + to_days(CAST(doc_id % 700 AS INTEGER)) AS published_at,
  'https://news.example.org/a/' || (doc_id // 2) AS url,
  CASE WHEN doc_id % 3 <> 0 THEN [{array(REGION_CODES)}[doc_id % 5 + 1]] ELSE [] END AS related_airports,
  CASE WHEN doc_id % 4 = 0 THEN [{array(REGION_CODES)}[(doc_id // 5) % 5 + 1] || '-' || {array(REGION_CODES)}[doc_id % 5 + 1]]
    ELSE [] END AS related_routes,
  CASE WHEN doc_id % 2 = 0 THEN [{array(CARRIERS)}[doc_id % 5 + 1]] ELSE [] END AS related_airlines,
  text AS body, doc_id FROM documents"""

METRO = (
    f"CASE WHEN split_part(route, '-', 1) IN {names(METROS)} AND split_part(route, '-', 2) IN {names(METROS)}"
    " THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END"
)

CHECKED = """SELECT *, CASE
  WHEN trim(coalesce(observation_id, '')) = '' OR trim(coalesce(airline, '')) = '' OR trim(coalesce(origin, '')) = ''
    OR trim(coalesce(destination, '')) = '' OR trim(coalesce(currency, '')) = '' THEN 'MISSING_REQUIRED_FIELD'
  WHEN fd IS NULL OR bd IS NULL THEN 'INVALID_DATE'
  WHEN total_fare IS NULL OR total_fare <= 0 THEN 'INVALID_FARE'
  WHEN upper(origin) = upper(destination) THEN 'SAME_ORIGIN_DESTINATION'
  WHEN fd < bd THEN 'IMPOSSIBLE_BOOKING_HORIZON' END AS rejection_reason
  FROM (SELECT *, TRY_CAST(flight_date AS DATE) AS fd, TRY_CAST(booking_date AS DATE) AS bd FROM src)"""

_LIMITS = {
    "iqr": """SELECT {k}, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {k}, count(*) AS n,
      quantile_cont(fare, 0.25) AS q1, quantile_cont(fare, 0.75) AS q3 FROM uniq GROUP BY {k}) WHERE n >= 4 AND q3 <> q1""",
    "percentile": """SELECT {k}, q1 AS lo, q3 AS hi FROM (SELECT {k}, count(*) AS n, quantile_cont(fare, 0.01) AS q1,
      quantile_cont(fare, 0.99) AS q3 FROM uniq GROUP BY {k}) WHERE n >= 4""",
    "mad": """SELECT {k}, med, mad FROM (SELECT {k}, any_value(med) AS med, any_value(n) AS n,
      quantile_cont(abs(fare - med), 0.5) AS mad FROM (SELECT *, quantile_cont(fare, 0.5) OVER (PARTITION BY {k}) AS med,
      count(*) OVER (PARTITION BY {k}) AS n FROM uniq) GROUP BY {k}) WHERE n >= 4 AND mad <> 0""",
    "none": "SELECT {k}, 0.0 AS lo, 0.0 AS hi FROM uniq WHERE false",
}

_TRIMMED = """CASE WHEN count(*) < 3 THEN quantile_cont(fare, 0.5) ELSE
  avg(fare) FILTER (WHERE rn > floor(0.1 * n) AND rn <= n - floor(0.1 * n)) END"""

_REPRESENTATIVE = {"median": "quantile_cont(fare, 0.5)", "mean": "avg(fare)", "trimmed_mean": _TRIMMED}


def index_ctes(
    source: str | None = None,
    outlier: str = "iqr",
    rep: str = "median",
    agg: str = "arithmetic",
    horizon: str | None = None,
    weights: str | None = None,
    by: str = "",
    where: str = "true",
) -> str:
    """`WITH ...` up to `national`. `by` is an extra key such as a booking window, computed in `enriched`."""
    k = f"{by + ', ' if by else ''}route, month_ord"
    p = f"{by}, " if by else ""
    use = lambda a: f"a.{by} = {a}.{by} AND " if by else ""
    extra = f"{band('days', BOOKING_WINDOWS, 'NULL')} AS booking_window, " if by == "booking_window" else ""
    buckets = band("days", HORIZON_BUCKETS, "'unknown'")
    keep = f"bucket = '{horizon}'" if horizon else "true"
    if by:
        keep += f" AND {by} IS NOT NULL"
    flag = {
        "mad": "l.mad IS NOT NULL AND abs(0.6745 * (u.fare - l.med) / l.mad) > 3.5",
        "none": "false",
    }.get(outlier, "l.lo IS NOT NULL AND (u.fare < l.lo OR u.fare > l.hi)")
    on = f"u.route = l.route AND u.month_ord = l.month_ord{f' AND u.{by} = l.{by}' if by else ''}"
    weight_rows = weights or f"SELECT {p}route, {METRO} AS weight FROM (SELECT DISTINCT {p}route FROM facts)"
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    value = {
        "arithmetic": "sum(CASE WHEN use THEN wn * idx END) / nullif(sum(CASE WHEN use THEN wn END), 0)",
        "geometric": "100 * exp(sum(CASE WHEN use THEN wn * ln(idx / 100) END) / nullif(sum(CASE WHEN use THEN wn END), 0))",
    }[agg]
    return f"""WITH src AS ({source or fares()}),
checked AS ({CHECKED}),
dated AS (SELECT *, datediff('day', bd, fd) AS days FROM checked WHERE rejection_reason IS NULL AND {where}),
enriched AS (SELECT * FROM (SELECT {extra}observation_id, upper(origin) || '-' || upper(destination) AS route,
  year(fd) * 12 + month(fd) AS month_ord, days, {buckets} AS bucket, total_fare AS fare FROM dated) WHERE {keep}),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {p}observation_id
  ORDER BY fare, route, month_ord, bucket) AS seen FROM enriched) WHERE seen = 1),
lim AS ({_LIMITS[outlier].format(k=k)}),
flagged AS (SELECT u.*, coalesce({flag}, false) AS is_outlier FROM uniq u LEFT JOIN lim l ON {on}),
kept AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY fare) AS rn, count(*) OVER (PARTITION BY {k}) AS n
  FROM flagged WHERE NOT is_outlier),
facts AS MATERIALIZED (SELECT {k}, {_REPRESENTATIVE[rep]} AS fare, count(*) AS n, count(*) >= 3 AS ok_n, avg(fare) AS mean,
  stddev_samp(fare) AS sd FROM kept GROUP BY {k}),
w AS (SELECT *, weight / sum(weight) {over} AS wn FROM ({weight_rows})),
universe AS (SELECT DISTINCT {p}route FROM facts UNION SELECT {p}route FROM w),
months AS (SELECT unnest(generate_series(min(month_ord) - 12, max(month_ord))) AS month_ord FROM uniq),
spine AS (SELECT universe.*, month_ord FROM universe, months),
routes0 AS MATERIALIZED (SELECT a.*, b.fare AS base_fare, f.fare, coalesce(f.n, 0) AS n, f.mean, f.sd, w.weight, w.wn,
  CASE WHEN b.route IS NULL AND f.route IS NULL THEN 'NO_BASE_DATA' WHEN b.route IS NULL THEN 'NEW_ROUTE'
    WHEN NOT b.ok_n OR b.fare IS NULL OR b.fare = 0 THEN 'INSUFFICIENT_DATA' WHEN f.route IS NULL THEN 'DISCONTINUED'
    WHEN NOT f.ok_n THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS status
  FROM spine a LEFT JOIN facts b ON {use("b")}a.route = b.route AND b.month_ord = {BASE_ORD}
  LEFT JOIN facts f ON {use("f")}a.route = f.route AND a.month_ord = f.month_ord
  LEFT JOIN w ON {use("w")}a.route = w.route),
routes1 AS MATERIALIZED (SELECT *, CASE WHEN status = 'OK' THEN 100.0 * fare / base_fare END AS idx FROM routes0),
routes AS MATERIALIZED (SELECT a.*, {period("a.month_ord")} AS period, p.idx AS idx1, y.idx AS idx12,
  a.idx IS NOT NULL AND coalesce(a.wn, 0) <> 0 AS use FROM routes1 a
  LEFT JOIN routes1 p ON {use("p")}a.route = p.route AND p.month_ord = a.month_ord - 1
  LEFT JOIN routes1 y ON {use("y")}a.route = y.route AND y.month_ord = a.month_ord - 12),
contrib AS (SELECT *, coalesce(coalesce(wn, 0) / nullif(sum(CASE WHEN use THEN wn END) OVER (PARTITION BY {p}month_ord), 0), 0)
  AS cw FROM routes),
inflation AS MATERIALIZED (SELECT *, cw * (idx - idx1) AS points, (idx / nullif(idx1, 0) - 1) * 100 AS mom,
  (idx / nullif(idx12, 0) - 1) * 100 AS yoy, CASE WHEN n >= 3 THEN sd / nullif(mean, 0) END AS cv FROM contrib),
national0 AS (SELECT {p}month_ord, {period("month_ord")} AS period, {value} AS idx,
  count(*) FILTER (WHERE status = 'OK') AS routes_covered, count(*) AS routes_total,
  count(*) FILTER (WHERE status <> 'NO_BASE_DATA') AS routes_with_data,
  coalesce(sum(CASE WHEN status = 'OK' THEN coalesce(wn, 0) ELSE 0 END) / nullif(sum(coalesce(wn, 0)), 0), 0) AS coverage,
  CAST(sum(n) AS BIGINT) AS obs FROM routes GROUP BY {p}month_ord),
national AS (SELECT a.*, (a.idx / nullif(p.idx, 0) - 1) * 100 AS mom, (a.idx / nullif(y.idx, 0) - 1) * 100 AS yoy
  FROM national0 a LEFT JOIN national0 p ON {use("p")}p.month_ord = a.month_ord - 1
  LEFT JOIN national0 y ON {use("y")}y.month_ord = a.month_ord - 12),
first_month AS (SELECT min(month_ord) AS lo FROM uniq)
"""


def airports_values() -> str:
    rows = ", ".join(f"('{code}', '{city}', {lat}, {lon})" for code, city, lat, lon in AIRPORTS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(code, city, lat, lon))"
