"""Ranking, likelihood and calibration over scored alternatives (event_id, alt_idx, score, chosen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources.shared import stored

TOP = 5
BINS = 15


def per_event(scores: DataFrame, keys: list[str] | None = None, top: int = TOP) -> DataFrame:
    """One row an event, in one shuffle: n_alts, nll, rr (fair ties), rank (ties by position), top1, topk, confidence.

    An event's alternatives are few by nature; they are gathered into one array of bounded length.
    """
    keys = keys or []
    g = scores.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("alt_idx", "score"))).alias("alts"),
        F.max(F.when(F.col("chosen"), F.struct("alt_idx", "score"))).alias("own"),
        *(F.first(k).alias(k) for k in keys),
    )
    s = F.transform("alts", lambda a: a["score"])
    own = F.col("own.score")
    g = g.withColumn("top_score", F.array_max(s))
    g = g.withColumn("log_sum", F.col("top_score") + F.log(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top_score")))))
    above = F.size(F.filter("alts", lambda a: a["score"] > own))
    equal = F.size(F.filter("alts", lambda a: a["score"] == own)) - 1
    before = F.size(F.filter("alts", lambda a: (a["score"] == own) & (a["alt_idx"] < F.col("own.alt_idx"))))
    return g.select(
        "event_id",
        *keys,
        F.size("alts").cast("long").alias("n_alts"),
        (F.col("log_sum") - own).alias("nll"),
        (1.0 / (1 + above + 0.5 * equal)).alias("rr"),
        (above + before).cast("long").alias("rank"),
        above.cast("long").alias("strict_rank"),
        (above + before < 1).alias("top1"),
        (above + before < F.least(F.lit(top), F.size("alts"))).alias("topk"),
        F.exp(F.col("top_score") - F.col("log_sum")).alias("confidence"),
    )


def share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def panel(events: DataFrame, n_params: int, n_train: int, by: list[str] | None = None) -> DataFrame:
    """The metric panel, over all events or by strata; pseudo R2 takes the mean number of alternatives' log."""
    nll = F.avg("nll")
    return events.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        share("top1").alias("top1"),
        share("topk").alias("topk"),
        F.avg("rr").alias("mrr"),
        nll.alias("nll"),
        (2.0 * n_params + 2.0 * n_train * nll).alias("aic"),
        (n_params * F.log(F.lit(float(n_train))) + 2.0 * n_train * nll).alias("bic"),
        (1 - nll / F.avg(F.log("n_alts"))).alias("pseudo_r2"),
    )


def ece(events: DataFrame, bins: int = BINS) -> DataFrame:
    """One row: expected calibration error of the first choice over bins of equal width."""
    b = events.groupBy(F.least((F.col("confidence") * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("conf"), share("top1").alias("acc")
    )
    return b.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def weighted_loss(events: DataFrame, weight: str) -> DataFrame:
    return events.agg((F.sum(F.col(weight) * F.col("nll")) / F.sum(weight)).alias("loss"))


def time_of_day(hour: Column, evening_ends: int = 24) -> Column:
    """night, morning, afternoon, evening from 0, 6, 12 and 18; from ``evening_ends`` on night again."""
    out = F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").when(hour < evening_ends, "evening").when(hour < 24, "night")
    return F.when(hour.between(0, 23), out).otherwise(F.raise_error(F.lit("an hour is from 0 to 23")).cast("string"))


def tertiles(activity: DataFrame, value: str) -> DataFrame:
    """low, mid or high by the thirds of a value; one that equals an edge goes up."""
    activity = stored(activity, "activity")  # read by every pass that narrows the edges
    low, high = (F.lit(q).cast("double") for q in quantiles(activity, value, [1 / 3, 2 / 3]))
    return activity.withColumn("tertile", F.when(F.col(value) >= high, "high").when(F.col(value) >= low, "mid").otherwise("low"))


def dominant(attributes: DataFrame) -> DataFrame:
    """(event_id, m): the attribute of the chosen alternative with the greatest weight times mean size; ties: the first.

    ``attributes`` has (event_id, k, m, a, w) for chosen alternatives.
    """
    score = attributes.groupBy("event_id", "m").agg((F.first("w") * F.avg(F.abs("a"))).alias("score"))
    return score.groupBy("event_id").agg(F.min_by("m", F.struct((-F.col("score")).alias("s"), "m")).alias("m"))


def per_customer(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(F.avg("nll").alias("nll"), share("top1").alias("top1"), F.count("*").alias("n_events"))


def repeat_novel(events: DataFrame) -> DataFrame:
    """Both rows always: kind, n, top1 (0 where there are none)."""
    spark = events.sparkSession
    kinds = spark.createDataFrame([("repeat", True), ("novel", False)], "kind string, is_repeat boolean")
    got = events.groupBy("is_repeat").agg(F.count("*").alias("n"), share("top1").alias("top1"))
    return kinds.join(got, "is_repeat", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top1", F.lit(0.0)).alias("top1"))
