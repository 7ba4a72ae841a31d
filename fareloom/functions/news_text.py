"""Expressions on news articles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEMAND_SUPPLY_EVENTS, EVENT_KEYWORDS, EVENT_LABELS
from .columns import first_reason


def classify_event(text: Column, keywords: Sequence[tuple[str, Sequence[str]]] = EVENT_KEYWORDS) -> Column:
    """Event type of the first group with a word inside the lower-cased text, else OTHER."""
    lowered = F.lower(text)
    rules = [(event, lowered.rlike("|".join(re.escape(w) for w in words))) for event, words in keywords]
    return first_reason(rules).otherwise("OTHER")


def is_valid_article(url: Column, event_type: Column) -> Column:
    """Known event type and an absolute http(s) address with a host."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    good = scheme.isin("http", "https") & (F.length(host) > 0) & event_type.isin([e for e, _ in EVENT_LABELS])
    return F.coalesce(good, F.lit(False))


def event_label(event_type: Column) -> Column:
    return first_reason([(label, event_type == event) for event, label in EVENT_LABELS]).otherwise(event_type)


def event_score(event_type: Column) -> Column:
    return F.when(event_type.isin(*DEMAND_SUPPLY_EVENTS), 1.0).when(event_type == "OTHER", 0.0).otherwise(0.5)


def tidy(tags: Column) -> Column:
    """Tags trimmed and upper-cased, without empties."""
    upper = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))
    return F.filter(upper, lambda x: x.isNotNull() & (x != ""))
