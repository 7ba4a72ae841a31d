"""Duplicate quotes of a graded batch: exact ones are rejected, near ones flagged.

All of it runs on narrow rows: fixed-size keys, the order of the row, fare and reason (see `quality.verdicts`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import QualityConfig
from ..session import stage
from .cleaning import ORDER_COLS

GROUP_COLS = ("airline", "origin", "destination", "flight_date", "booking_date")
# Fares of a group are dealt by bands of so many log units, or more for a wide tolerance: a band reaches into its neighbours only.
BAND = 0.5
# Cells per tolerance: a fare's neighbours less than so many cells away are near for certain.
CELLS = 4
# Below this fare the tolerance is that of this fare, and the scale of the cells is linear.
LEAST = 1e-9


# Ids that several candidates share go to all tasks up to so many (8 bytes each); beyond, all candidates are shuffled by id.
SHARED_IDS = 1 << 16
# Bytes of a key: 96 bits, by which among a billion different texts two agree with a probability of 1e-11.
KEY_BYTES = 12
# Bytes of a row key: it tells rows apart that have one content and one id, and orders rows of one id and fare. Rows are padded to eight.
ROW_KEY_BYTES = 8


def _key(text: Column, size: int = KEY_BYTES) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, size)


def digest(columns: Sequence[Column], size: int = KEY_BYTES) -> Column:
    """A key of fixed size of all columns; null and empty text differ."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in columns])
    return _key(F.concat_ws("|", nulls, *texts), size)


def row_keys(raw_cols: Sequence[str]) -> dict[str, Column]:
    """`row_key` of all raw columns, `content_key` of all but the id, with null as empty text, `group_key` of a near group."""
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw_cols if c != "observation_id"]
    groups = [F.col(c) for c in (*GROUP_COLS, "source") if c in raw_cols]
    return {
        "row_key": digest([F.col(c) for c in raw_cols], ROW_KEY_BYTES),
        "content_key": _key(F.concat_ws("|", *content)),
        "group_key": digest(groups),
    }


def row_order(columns: Sequence[str], order_cols: Sequence[str] = ORDER_COLS) -> list[str]:
    """Columns of a strict total order of distinct rows: the given columns in turn, then id and row key."""
    given = [c for c in order_cols if c in columns]
    return [*given, *[c for c in ("observation_id", "row_key") if c not in given]]


def distinct_rows(rows: DataFrame, order: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Every distinct row with its `copies` and `later_of_content`: an earlier candidate (no rejection reason) has its content.

    Rows are shuffled once, by content: equal rows have equal content, so the copies and the first row of a content are
    found in the same layout. `extra` columns follow from the row key and are carried along. `content_key` is dropped.
    """
    keys = [c for c in rows.columns if c not in extra]
    carried = [F.first(c).alias(c) for c in extra]
    distinct = rows.repartition("content_key").groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *carried)
    candidate = F.col("rejection_reason").isNull()
    place = F.row_number().over(W.partitionBy("content_key", candidate).orderBy(*order))
    return distinct.withColumn("later_of_content", candidate & (place > 1)).drop("content_key")


def mark_exact(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, bool]:
    """Candidates of `distinct_rows` with `is_repeat`: an earlier candidate has the same id or content. And whether all were shuffled.

    Hashes of ids are counted first, 64 bits and a count of each row. Only candidates whose hash comes again are shuffled by id and
    staged; others have an id of their own. Where the ids that come again are too many to be sent to all tasks, all candidates are
    shuffled. Rejected rows stay out, so that blank ids, already rejected, don't meet on one key.
    """
    candidates = rows.filter(F.col("rejection_reason").isNull()).withColumn("id_key", F.trim("observation_id"))
    hashed = candidates.withColumn("id_hash", F.xxhash64("id_key"))
    times = hashed.groupBy("id_hash").agg(F.count(F.lit(1)).alias("times"))
    shared = stage(times.filter(F.col("times") > 1).select("id_hash"), "shared-ids")
    ids = shared.count()
    place = F.row_number().over(W.partitionBy("id_key").orderBy(*order))
    in_place = F.col("later_of_content") | (place > 1)
    done = ("id_key", "id_hash", "later_of_content")
    if ids > SHARED_IDS:
        return candidates.withColumn("is_repeat", in_place).drop(*done), True
    if not ids:
        return candidates.withColumn("is_repeat", F.col("later_of_content")).drop(*done), False
    few = F.broadcast(shared)  # counted: half a megabyte at most
    alone = hashed.join(few, "id_hash", "left_anti").withColumn("is_repeat", F.col("later_of_content")).drop(*done)
    together = hashed.join(few, "id_hash", "left_semi").withColumn("is_repeat", in_place).drop(*done)
    return alone.unionByName(stage(together, "shared-id-rows")), False


def near_duplicates(candidates: DataFrame, config: QualityConfig) -> DataFrame:
    """(group_key, fare, first_near): the first row whose fare lies within the tolerance.

    A row is a potential duplicate when its own order is later than `first_near`. Rows of a group are reduced to one row
    per fare, and fares to cells narrower than the tolerance: `CELLS` of them span its lower reach on a log scale. A fare is
    near every fare that lies fewer than `CELLS` cells away, of which only the first row matters; the few cells beyond, where the
    limit falls, send their fares, and only these are tested one by one with the exact rule. Each cell sends itself
    to the cells around it, so they meet by equal cell numbers. A cell without another in reach sends nothing.

    Rows are dealt once, by group and band; all that follows is grouped by more columns and needs no other exchange until
    the result, one row per group and fare, which is dealt as the rows that join it.
    """
    tol = config.near_duplicate_tolerance
    # reach of |f - s| <= tol * s in ln f - ln s, below and above; the first with a margin no rounding crosses
    width = math.log1p(tol) / CELLS * (1 - 1e-6)
    reach = -math.log1p(-tol) + 1e-6
    far = math.ceil(reach / width)
    sure, edge = list(range(1 - CELLS, CELLS)), [d for n in range(CELLS, far + 1) for d in (-n, n)]

    scale = F.when(F.col("fare") >= LEAST, F.ln("fare")).otherwise(F.col("fare") / LEAST - 1 + math.log(LEAST))
    margin = reach + 2 * width
    band = max(BAND, margin)
    home = F.floor(F.col("scale") / band)
    bands = F.array_distinct(F.array(F.floor((F.col("scale") - margin) / band), home, F.floor((F.col("scale") + margin) / band)))
    in_band = ["group_key", "band"]
    scaled = candidates.select("group_key", "fare", "row_order", scale.alias("scale"))
    dealt = scaled.withColumn("band", F.explode(bands)).drop("scale").repartition(*in_band)
    fares = dealt.groupBy(*in_band, "fare").agg(F.min("row_order").alias("first"), F.max("row_order").alias("last"))
    fares = fares.withColumn("scale", scale).withColumns({"cell": F.floor(F.col("scale") / width), "own": home})

    cells = fares.groupBy(*in_band, "cell").agg(
        F.min("first").alias("low"), F.collect_list(F.struct("fare", "first", "last", "own")).alias("fares")
    )
    order = W.partitionBy(*in_band).orderBy("cell")
    alone = F.coalesce(F.col("cell") - F.lag("cell").over(order) > far, F.lit(True)) & F.coalesce(
        F.lead("cell").over(order) - F.col("cell") > far, F.lit(True)
    )
    around = F.when(F.col("alone"), F.array(F.lit(0))).otherwise(F.array(*[F.lit(d) for d in sure + edge]))
    sent = cells.withColumn("alone", alone).withColumn("step", F.explode(around))
    by_edge = F.abs("step") >= CELLS
    sent = sent.select(
        *in_band,
        (F.col("cell") + F.col("step")).alias("cell"),
        F.when(~by_edge, F.col("low")).alias("low"),
        F.when(by_edge, F.transform("fares", lambda x: F.struct(x["fare"], x["first"]))).alias("edge"),
        F.when(F.col("step") == 0, F.col("fares")).alias("here"),
    )
    met = sent.groupBy(*in_band, "cell").agg(
        F.min("low").alias("low"), F.flatten(F.collect_list("edge")).alias("edge"), F.flatten(F.collect_list("here")).alias("here")
    )
    met = met.withColumn("at", F.explode("here")).filter(F.col("at.own") == F.col("band"))
    fare = F.col("at.fare")
    at_edge = F.filter("edge", lambda e: F.abs(fare - e["fare"]) <= F.lit(tol) * F.greatest(F.abs(e["fare"]), F.lit(LEAST)))
    nearest = F.least("low", F.array_min(F.transform(at_edge, lambda e: e["first"])))
    found = met.select("group_key", fare.alias("fare"), nearest.alias("first_near"), F.col("at.last").alias("last"))
    found = found.filter(F.col("first_near") < F.col("last"))
    # a grouping, so that the planner knows the key as unique and drops the search where no one asks for its flag
    return found.groupBy("group_key", "fare").agg(F.min("first_near").alias("first_near"))


def mark_near(candidates: DataFrame, config: QualityConfig) -> DataFrame:
    """Add `is_near_repeat` to candidates."""
    joined = candidates.join(near_duplicates(candidates, config), ["group_key", "fare"], "left")
    flag = F.coalesce(F.col("row_order") > F.col("first_near"), F.lit(False))
    return joined.withColumn("is_near_repeat", flag).drop("first_near")
