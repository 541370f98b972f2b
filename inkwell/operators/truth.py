"""True events aligned with episodes, and the targets that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.wire import EVENT_TYPES


def align(episodes: DataFrame, truth: DataFrame) -> DataFrame:
    """session_id, truth_event_id, event_type, matched_episode_ids (in the episodes' order) and alignment_status of every true event.

    Candidates share a point with the event. If any of them is on the event's page (or on none), the others go; then the same by
    question. truth: session_id, event_id, event_type, page_id, question_id, source_point_ids. The join is by point, not by pairs of
    lists.
    """
    own = episodes.select("session_id", "episode_id", "episode_index", F.col("page_id").alias("own_page"), F.col("question_id").alias("own_question"), F.explode(F.array_distinct("point_refs")).alias("point_id"))
    named = truth.select("session_id", F.col("event_id").alias("truth_event_id"), "page_id", "question_id", F.explode(F.array_distinct("source_point_ids")).alias("point_id"))
    pairs = named.join(own, ["session_id", "point_id"]).drop("point_id").distinct()
    per_event = Window.partitionBy("session_id", "truth_event_id")
    for column in ("page", "question"):
        fits = F.col(f"{column}_id").isNotNull() & (F.col(f"own_{column}").isNull() | F.coalesce(F.col(f"own_{column}") == F.col(f"{column}_id"), F.lit(False)))
        pairs = pairs.withColumn("_fits", fits).withColumn("_any", F.bool_or("_fits").over(per_event)).where("_fits OR NOT _any").drop("_fits", "_any")
    matched = pairs.groupBy("session_id", "truth_event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("episode_index", "episode_id"))), lambda x: x["episode_id"]).alias("matched"))
    rows = truth.select("session_id", F.col("event_id").alias("truth_event_id"), "event_type").join(matched, ["session_id", "truth_event_id"], "left")
    n = F.size(F.coalesce("matched", F.array().cast("array<string>")))
    status = F.when(n == 0, "UNMATCHED").when(n == 1, "ONE_TO_ONE").otherwise("ONE_TO_MANY")
    return rows.select("session_id", "truth_event_id", "event_type", F.coalesce("matched", F.array().cast("array<string>")).alias("matched_episode_ids"), status.alias("alignment_status"))


def targets(episodes: DataFrame, aligned: DataFrame) -> DataFrame:
    """episodes with target: for each event type in order 1 if an event of it stands for this episode alone, else 0."""
    sure = aligned.where("alignment_status = 'ONE_TO_ONE'").select(F.get("matched_episode_ids", F.lit(0)).alias("episode_id"), "event_type")
    labels = sure.groupBy("episode_id").agg(F.collect_set("event_type").alias("_labels"))
    has = lambda t: F.coalesce(F.array_contains("_labels", t), F.lit(False)).cast("int")
    return episodes.join(labels, "episode_id", "left").withColumn("target", F.array(*map(has, EVENT_TYPES))).drop("_labels")


def distribution(rows: DataFrame) -> DataFrame:
    """event_type, n: episodes with that target."""
    return rows.select(F.posexplode("target").alias("k", "on")).groupBy("k").agg(F.sum("on").alias("n")).select(F.get(F.array(*map(F.lit, EVENT_TYPES)), F.col("k")).alias("event_type"), "n")


def cooccurrence(rows: DataFrame) -> DataFrame:
    """first, second, n: episodes with both targets, for the pairs that occur; first stands before second in the order of types."""
    on = F.filter(F.transform("target", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    pairs = F.flatten(F.transform(on, lambda a: F.transform(F.filter(on, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    name = lambda c: F.get(F.array(*map(F.lit, EVENT_TYPES)), F.col(c))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).select(name("a").alias("first"), name("b").alias("second"), "n")
