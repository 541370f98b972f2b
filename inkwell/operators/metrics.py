"""Multi-label metrics of predictions in long form: id, label, target (0 or 1), score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import scan
from inkwell.sources import store

THRESHOLD = 0.5


def confusion(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """label, tp, fp, fn, tn with precision, recall, f1 (0 where undefined) and the Matthews coefficient."""
    hit = F.col("score") >= threshold
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    c = rows.groupBy("label").agg(n(hit & (F.col("target") == 1)).alias("tp"), n(hit & (F.col("target") == 0)).alias("fp"), n(~hit & (F.col("target") == 1)).alias("fn"), n(~hit & (F.col("target") == 0)).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    mcc = over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select("label", "tp", "fp", "fn", "tn", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"))


def ranking(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """label, roc_auc and average_precision; null where only one class occurs. Scores are counted first, and the counts are summed from the
    highest score over range partitions (written by keep), so a label may have any number of scores."""
    keep = keep or store.keeper(rows.sparkSession, "ranking")
    scores = rows.groupBy("label", "score").agg(F.sum("target").cast("double").alias("pos"), F.sum(1 - F.col("target")).cast("double").alias("neg"))
    down = scan.by_range(scores.withColumn("_down", -F.col("score")), ("label",), ("_down",), keep)
    cum = scan.scan(down, ("label",), ("_down",), total={"tp": F.col("pos"), "fp": F.col("neg")})
    cum = cum.join(down.groupBy("label").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")), "label")
    # A positive beats the negatives below it and half of those level with it.
    wins = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return cum.groupBy("label").agg(
        F.when(both, wins / F.greatest(F.max("all_pos") * F.max("all_neg"), F.lit(1.0))).alias("roc_auc"),
        F.when(both, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.greatest(F.max("all_pos"), F.lit(1.0))).alias("average_precision"),
    )


def overall(rows: DataFrame, threshold: float = THRESHOLD, labels: list[str] | None = None) -> DataFrame:
    """One row: micro and macro figures, Hamming loss and subset accuracy, of all labels or of some. Labels with one class only have no
    ranking and are left out of its means."""
    if labels is not None:
        known = [r["label"] for r in rows.select("label").distinct().collect()]  # labels are few
        if not labels or len(set(labels)) != len(labels) or set(labels) - set(known):
            raise ValueError("labels must be different ones that occur")
        rows = rows.where(F.col("label").isin(labels))
    hit, right = F.col("score") >= threshold, F.col("target") == 1
    n = lambda c: F.sum(c.cast("double"))
    per_label = confusion(rows, threshold).join(ranking(rows), "label").agg(F.avg("f1").alias("macro_f1"), F.avg("roc_auc").alias("macro_roc_auc"), F.avg("average_precision").alias("macro_average_precision"), F.count("roc_auc").alias("evaluable_labels"))
    micro = rows.agg(n(hit & right).alias("tp"), n(hit & ~right).alias("fp"), n(~hit & right).alias("fn"), F.avg((hit != right).cast("double")).alias("hamming_loss"))
    exact = rows.groupBy("id").agg(F.bool_and(hit == right).alias("all")).agg(F.avg(F.col("all").cast("double")).alias("subset_accuracy"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = [df.withColumn("_one", F.lit(1)) for df in (micro, per_label, exact)]  # a row each
    return one[0].join(one[1], "_one").join(one[2], "_one").select(
        over(tp, tp + fp).alias("micro_precision"), over(tp, tp + fn).alias("micro_recall"), over(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        "macro_f1", "macro_roc_auc", "macro_average_precision", "evaluable_labels", "hamming_loss", "subset_accuracy",
    )


def coverage(predictions: DataFrame, rows: DataFrame) -> DataFrame:
    """split, rows, predicted, distinct_ids, unpredicted: whether every row (id, split) has a prediction (id, split) and how many ids
    there are."""
    p = predictions.select("id", "split").groupBy("split").agg(F.count("*").alias("predicted"), F.count_distinct("id").alias("distinct_ids"))
    missing = rows.select("id", "split").join(predictions.select("id").distinct(), "id", "left_anti").groupBy("split").agg(F.count("*").alias("_missing"))
    every = rows.groupBy("split").agg(F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.join(p, "split", "full").join(missing, "split", "left").select("split", *[zero(F.col(c)).alias(c) for c in ("rows", "predicted", "distinct_ids")], zero(F.col("_missing")).alias("unpredicted"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """id and label where two runs' predictions (id, label, target) don't cover the same rows with the same targets."""
    other = b.select("id", "label", F.col("target").alias("_target"), F.lit(True).alias("_there"))
    both = a.withColumn("_here", F.lit(True)).join(other, ["id", "label"], "full")
    return both.where(F.col("_here").isNull() | F.col("_there").isNull() | ~F.col("target").eqNullSafe(F.col("_target"))).select("id", "label")


def deltas(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """label and a - b of each metric."""
    other = b.select("label", *[F.col(n).alias(f"_{n}") for n in names])
    return a.join(other, "label").select("label", *[(F.col(n) - F.col(f"_{n}")).alias(n) for n in names])
