"""Pattern score of dated events with a registry id, a route and participants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.fixed import PATTERN_WEIGHTS


def pattern_score(events: DataFrame, people: DataFrame, registries: DataFrame, strong: DataFrame,
                  routes: Sequence[tuple[str, str]], places: Sequence[str], ranges: Sequence[tuple[str, str]],
                  prefixes: Mapping[str, float], owner: str = "tail") -> DataFrame:
    """Four components, their weighted sum, flags and class.

    ``registries`` is (``owner``, confidence), where ``owner`` tells registries apart that share a tail; ``strong`` the (entity_id) of high-score
    participants; routes, places, date ranges and prefix classes are parameters.
    """
    aboard = people.join(strong.select("entity_id"), "entity_id", "left_semi").groupBy("event_id").agg(
        F.countDistinct("entity_id").alias("strong"))
    df = events.join(registries, owner, "left").join(aboard, "event_id", "left")
    tail = F.col("tail")
    guess = F.lit(0.0)
    for start, value in prefixes.items():
        guess = F.when(F.startswith(tail, F.lit(start)) & (F.length(tail) == 6), value).otherwise(guess)
    ends = F.array(F.struct(F.col("origin").alias("a"), F.col("dest").alias("z")))
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in routes])
    back = F.array(F.struct(F.col("dest").alias("a"), F.col("origin").alias("z")))
    near = F.col("origin").isin(list(places)).cast("int") + F.col("dest").isin(list(places)).cast("int")
    route = (F.when(F.arrays_overlap(ends, known), 1.0).when(F.arrays_overlap(back, known), 0.95)
             .when(near == 2, 0.75).when(near == 1, 0.40).otherwise(0.0))
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | F.col("event_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    df = df.select(
        *events.columns, F.coalesce("confidence", guess).alias("registry_score"), route.alias("route_score"),
        F.when(inside, 1.0).otherwise(0.0).alias("date_score"), F.col("confidence").isNotNull().alias("known_registry"),
        F.least(F.lit(1.0), F.coalesce("strong", F.lit(0)) / 3).alias("people_score"))
    w = PATTERN_WEIGHTS
    total = (F.col("registry_score") * w["registry"] + F.col("route_score") * w["route"]
             + F.col("date_score") * w["date"] + F.col("people_score") * w["participants"])
    r, t, d, s = (F.col(c) for c in ("registry_score", "route_score", "date_score", "raw"))
    flags = F.array_compact(F.array(
        F.when(r >= 0.7, "known_registry").when(r >= 0.2, "possible_registry"),
        F.when(t >= 0.7, "known_route").when(t >= 0.4, "known_place"),
        F.when(d >= 0.7, "date_overlap"),
        F.when(s >= 0.85, "high_correlation").when(s >= 0.60, "medium_correlation")))
    return df.withColumn("raw", total).withColumn("score", F.round(F.col("raw") + 1e-9, 3)).withColumn("flags", flags)
