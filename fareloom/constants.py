"""Word lists, codes and lookup tables that results depend on."""

from __future__ import annotations

# --- Observation schema ------------------------------------------------------------------------

REQUIRED_COLUMNS = (
    "observation_id",
    "airline",
    "origin",
    "destination",
    "flight_date",
    "booking_date",
    "total_fare",
    "currency",
)

OPTIONAL_COLUMNS = (
    "timestamp",
    "source",
    "fare_class",
    "fare_type",
    "base_fare",
    "taxes",
    "fees",
    "stops",
    "duration",
    "baggage",
    "availability",
)

# Booking-horizon buckets of the index: label, first day, last day (None = open).
HORIZON_BUCKETS = (
    ("0-3", 0, 3),
    ("4-7", 4, 7),
    ("8-14", 8, 14),
    ("15-30", 15, 30),
    ("31-60", 31, 60),
    ("61+", 61, None),
)

# Advance-purchase windows of the forecasting panels: a second, different scale.
BOOKING_WINDOWS = (
    ("T1_7", 1, 7),
    ("T8_14", 8, 14),
    ("T15_21", 15, 21),
    ("T22_30", 22, 30),
    ("T31_45", 31, 45),
)

# --- Places and carriers -----------------------------------------------------------------------

# Airport code -> city name as the traffic statistics spell it, latitude, longitude.
AIRPORTS = (
    ("DEL", "DELHI", 28.6139, 77.2090),
    ("BOM", "MUMBAI", 19.0760, 72.8777),
    ("BLR", "BENGALURU", 12.9716, 77.5946),
    ("HYD", "HYDERABAD", 17.3850, 78.4867),
    ("MAA", "CHENNAI", 13.0827, 80.2707),
    ("CCU", "KOLKATA", 22.5726, 88.3639),
    ("PNQ", "PUNE", 18.5204, 73.8567),
    ("AMD", "AHMEDABAD", 23.0225, 72.5714),
    ("SXR", "SRINAGAR", 34.0837, 74.7973),
    ("GAU", "GUWAHATI", 26.1445, 91.7362),
    ("PAT", "PATNA", 25.5941, 85.1376),
    ("COK", "KOCHI", 9.9312, 76.2673),
    ("LKO", "LUCKNOW", 26.8467, 80.9462),
    ("IXC", "CHANDIGARH", 30.7333, 76.7794),
    ("VNS", "VARANASI", 25.3176, 82.9739),
    ("IXR", "RANCHI", 23.3441, 85.3096),
    ("IDR", "INDORE", 22.7196, 75.8577),
    ("RPR", "RAIPUR", 21.2514, 81.6296),
    ("BBI", "BHUBANESWAR", 20.2961, 85.8245),
    ("CJB", "COIMBATORE", 11.0168, 76.9558),
    ("ATQ", "AMRITSAR", 31.6340, 74.8723),
    ("IXA", "AGARTALA", 23.8315, 91.2868),
    ("IXB", "BAGDOGRA", 26.6812, 88.3286),
    ("IXL", "LEH", 34.1642, 77.5850),
    ("GOI", "DABOLIM", 15.3808, 73.8314),
)

METROS = ("DEL", "BOM", "BLR", "MAA", "CCU", "HYD")

TRUNK_CITIES = ("DELHI", "MUMBAI", "BENGALURU")

KNOWN_AIRLINES = (
    "INDIGO",
    "AIR INDIA",
    "AIRINDIA",
    "AIR INDIA EXPRESS",
    "AIRINDIAEXPRESS",
    "SPICEJET",
    "VISTARA",
    "AKASA",
    "AKASA AIR",
    "ALLIANCEAIR",
    "ALLIANCE AIR",
    "GO FIRST",
    "GOFIRST",
    "GOAIR",
    "STAR AIR",
    "STARAIR",
    "FLYBIG",
    "TRUJET",
    "INDIAONE AIR",
)

# Carrier code -> name in fare-calendar payloads; other codes stay as they are.
CARRIER_NAMES = (
    ("6E", "IndiGo"),
    ("AI", "Air India"),
    ("SG", "SpiceJet"),
    ("QP", "Akasa Air"),
    ("IX", "Air India Express"),
)

ALLOWED_CURRENCIES = ("INR",)

# --- Collection --------------------------------------------------------------------------------

RETRYABLE_STATUSES = ("TIMEOUT", "HTTP_ERROR", "RATE_LIMITED")

MONTH_NAMES = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)

# --- News --------------------------------------------------------------------------------------

# Event types with the display label; the order is the order of the vocabulary.
EVENT_LABELS = (
    ("FLIGHT_CANCELLATION", "Flight cancellations"),
    ("CAPACITY_REDUCTION", "Capacity reduction"),
    ("WEATHER_DISRUPTION", "Weather disruption"),
    ("AIRPORT_DISRUPTION", "Airport disruption"),
    ("AIRLINE_OPERATIONAL_ISSUE", "Airline operational issue"),
    ("STRIKE", "Strike"),
    ("REGULATORY_CHANGE", "Regulatory change"),
    ("FUEL_PRICE_CHANGE", "Fuel price change"),
    ("GEOPOLITICAL_EVENT", "Geopolitical event"),
    ("OTHER", "Other"),
)

DEMAND_SUPPLY_EVENTS = (
    "FLIGHT_CANCELLATION",
    "CAPACITY_REDUCTION",
    "WEATHER_DISRUPTION",
    "AIRPORT_DISRUPTION",
    "AIRLINE_OPERATIONAL_ISSUE",
    "STRIKE",
)

# First matching group wins; words match as substrings of the lower-cased text.
EVENT_KEYWORDS = (
    ("STRIKE", ("strike", "protest", "walkout")),
    ("WEATHER_DISRUPTION", ("fog", "rain", "storm", "weather", "cyclone", "monsoon", "visibility")),
    ("FUEL_PRICE_CHANGE", ("atf", "fuel price", "jet fuel")),
    ("FLIGHT_CANCELLATION", ("cancel", "grounded", "grounds flights")),
    ("CAPACITY_REDUCTION", ("capacity cut", "trims capacity", "reduces flights", "frequency cut")),
    ("REGULATORY_CHANGE", ("dgca", "ministry of civil aviation", "regulation", "policy")),
    ("GEOPOLITICAL_EVENT", ("airspace closure", "sanctions", "conflict", "war")),
    ("AIRPORT_DISRUPTION", ("airport shut", "runway", "air traffic control", "atc")),
)

# --- Coverage planning -------------------------------------------------------------------------

TIER_LABELS = (
    (1, "TIER 1 - Essential"),
    (2, "TIER 2 - High value"),
    (3, "TIER 3 - Expansion"),
    (4, "TIER 4 - Long tail"),
)
