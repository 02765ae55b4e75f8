"""Statistics of the older pipeline: transitions, posterior predictive checks, simple baselines, error slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.text import tokens
from ..sources.binding import DAY_US
from .metrics import share


def _in_order():
    return Window.partitionBy("customer_id").orderBy("us", "seq")


def transitions(events: DataFrame, most: int = 10) -> DataFrame:
    """(category, next, n, share) among the most frequent categories; those count without each customer's last row."""
    moves = events.select("category", F.lead("category").over(_in_order()).alias("next")).filter("next is not null")
    counts = moves.groupBy("category", "next").agg(F.count("*").alias("n"))
    top = counts.groupBy("category").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "category").limit(most).select("category")
    kept = counts.join(F.broadcast(top), "category").join(F.broadcast(top.withColumnRenamed("category", "next")), "next")  # ``most`` rows
    return kept.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category"))).select("category", "next", "n", "share")


def self_transition(events: DataFrame, most: int = 10) -> DataFrame:
    t = transitions(events, most).groupBy("category").agg(F.sum(F.when(F.col("category") == F.col("next"), F.col("share")).otherwise(0.0)).alias("own"))
    return t.agg(F.avg("own").alias("self_transition"))


def posterior_stats(events: DataFrame, brand: str = "brand") -> DataFrame:
    """One row: repeat rate, mean gap in days, mean price of customers and their mean concentration on brands."""
    again = (F.row_number().over(Window.partitionBy("customer_id", "asin").orderBy("us", "seq")) > 1).cast("double")
    gap = F.floor((F.col("us") - F.lag("us").over(_in_order())) / DAY_US)
    rows = events.withColumns({"again": again, "gap": gap})
    customers = rows.groupBy("customer_id").agg(F.avg("again").alias("again"), F.avg("price").alias("price"), F.sum("gap").alias("gaps"), F.count("gap").alias("n_gaps"))
    brands = events.groupBy("customer_id", brand).agg(F.count("*").alias("n"))
    hhi = brands.groupBy("customer_id").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hhi"))
    return customers.join(hhi, "customer_id").agg(
        F.avg("again").alias("repeat_rate"), (F.sum("gaps") / F.sum("n_gaps")).alias("mean_gap"), F.avg("price").alias("mean_price"), F.avg("hhi").alias("brand_hhi")
    )


def compare(real: DataFrame, simulated: DataFrame) -> DataFrame:
    """(statistic, real, simulated, pct_diff) of two rows of statistics, rounded to 4 and 1 places."""
    names = real.columns
    pair = real.select(*(F.round(c, 4).alias(f"r_{c}") for c in names)).crossJoin(simulated.select(*(F.round(c, 4).alias(f"s_{c}") for c in names)))
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(f"r_{c}").alias("real"), F.col(f"s_{c}").alias("simulated")) for c in names)))
    return pair.select(stack.alias("x")).select("x.*").withColumn("pct_diff", F.round((F.col("simulated") - F.col("real")) / (F.abs("real") + 1e-9) * 100, 1))


def ranked_baseline(alternatives: DataFrame, score: Column) -> DataFrame:
    """top1, top5 and mrr of a score over (event_id, alt_idx, chosen); ties by position."""
    rows = alternatives.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), "alt_idx"))
    own = rows.withColumn("rank", rank).filter("chosen")
    return own.agg(F.avg((F.col("rank") <= 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 5).cast("double")).alias("top5"), F.avg(1.0 / F.col("rank")).alias("mrr"), F.count("*").alias("n"))


def frequency_baseline(alternatives: DataFrame, training: DataFrame) -> DataFrame:
    """The customer's most-bought item first."""
    bought = training.groupBy("customer_id", "asin").agg(F.count("*").alias("bought"))
    return ranked_baseline(alternatives.join(bought, ["customer_id", "asin"], "left"), F.coalesce("bought", F.lit(0)))


def markov_baseline(alternatives: DataFrame, training: DataFrame, previous: str = "prev_category", most: int = 10) -> DataFrame:
    """Transition share from the previous category to the event's, times one more than the item's count in it."""
    t = transitions(training, most).select(F.col("category").alias(previous), F.col("next").alias("event_category"), "share")
    pop = training.groupBy(F.col("category").alias("event_category"), "asin").agg(F.count("*").alias("pop"))
    rows = alternatives.join(F.broadcast(t), [previous, "event_category"], "left").join(pop, ["event_category", "asin"], "left")  # most squared rows
    return ranked_baseline(rows, F.coalesce("share", F.lit(1e-3)) * (1 + F.coalesce("pop", F.lit(0))))


def activity_levels(customers: DataFrame, n: str, labels: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """Customers by the quantiles of their counts; the highest quantile that a count reaches names it."""
    k = len(labels)
    q = customers.agg(F.percentile(n, F.array(*(F.lit(i / k) for i in range(k)))).alias("q"))
    level = F.lit(labels[0])
    for i in range(1, k):
        level = F.when(F.col(n) >= F.col("q")[i], labels[i]).otherwise(level)
    return customers.crossJoin(F.broadcast(q)).withColumn("level", level).drop("q")


def error_slices(events: DataFrame, worst: int = 5, flag_at: float = 0.4) -> DataFrame:
    """The categories with most wrong first choices: their error rate, and of their errors the shares that are first
    buys and popular items, flagged at ``flag_at``."""
    wrong = (~F.col("top1")).cast("double")
    g = events.groupBy("category").agg(
        F.count("*").alias("n"), F.avg(wrong).alias("error_rate"), F.sum(wrong).alias("errors"),
        F.sum(wrong * (~F.col("is_repeat")).cast("double")).alias("first"), F.sum(wrong * F.col("is_popular").cast("double")).alias("popular"),
    )
    out = g.withColumns({"first_share": F.try_divide("first", "errors"), "popular_share": F.try_divide("popular", "errors")})
    flag = F.when(F.col("first_share") >= flag_at, "first buys").when(F.col("popular_share") >= flag_at, "popular items").otherwise("none")
    return out.withColumn("pattern", flag).orderBy(F.desc("error_rate"), "category").limit(worst).select("category", "n", "error_rate", "first_share", "popular_share", "pattern")


def describe(customers: DataFrame, n: str) -> DataFrame:
    """count, mean, deviation, least, quartiles and greatest of a count."""
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return customers.agg(F.count(n).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("least"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(n).alias("greatest"))


def months(events: DataFrame) -> DataFrame:
    """Rows a month from the first to the last, months without any as 0."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / DAY_US).cast("int"))
    month = F.year(day) * 12 + F.month(day) - 1
    counts = events.groupBy(month.cast("long").alias("m")).agg(F.count("*").alias("n"))
    span = counts.agg(F.explode(F.sequence(F.min("m"), F.max("m"))).alias("m"))
    return span.join(counts, "m", "left").select(F.floor(F.col("m") / 12).alias("year"), (F.col("m") % 12 + 1).alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def chosen_means(alternatives: DataFrame, features: list[str]) -> DataFrame:
    return alternatives.groupBy("chosen").agg(*(F.avg(f).alias(f) for f in features))


def pareto(points: DataFrame, low: str, high: str) -> DataFrame:
    """Points that none dominates: none is as good in both (low as small, high as great) and better in one.

    One pass over points sorted by ``low``: a point stays if its ``high`` exceeds that of all before it.
    """
    best = points.groupBy(low).agg(F.max(high).alias("_best"))
    stretch = F.floor(F.col(low))
    cells = best.withColumn("_cell", stretch)
    tops = cells.groupBy("_cell").agg(F.max("_best").alias("_top"))
    before = tops.select("_cell", F.max("_top").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"))
    inner = Window.partitionBy("_cell").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    kept = cells.join(before, "_cell").withColumn("_seen", F.greatest(F.max("_best").over(inner), "_prior")).filter("_seen is null or _best > _seen").select(low, F.col("_best").alias(high))
    return points.join(kept, [low, high], "left_semi")


def price_histogram(events: DataFrame, bins: int = 50, most: float = 100.0) -> DataFrame:
    """(bin, low, n): rows by price in equal bins up to ``most``; dearer ones count in the last, empty bins don't show."""
    width = most / bins
    place = F.least(F.greatest(F.floor(F.col("price") / width), F.lit(0)), F.lit(bins - 1)).cast("long")
    return events.filter("price is not null").groupBy(place.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width).alias("low"), "n")


def top_categories(events: DataFrame, most: int = 20) -> DataFrame:
    return events.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(most)


def worst_categories(scored: DataFrame, most: int = 3) -> DataFrame:
    """The categories of the lowest top-1; ``scored`` has category and strict_rank."""
    g = scored.groupBy("category").agg(F.count("*").alias("n"), F.avg((F.col("strict_rank") < 1).cast("double")).alias("top1"), F.avg(1.0 / (1 + F.col("strict_rank"))).alias("mrr"))
    return g.orderBy("top1", "category").limit(most)


def weight_summary(weights: DataFrame, column: str = "weight") -> DataFrame:
    """One row: least, median, greatest, mean and population deviation of weights, zeros where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    median = quantiles(weights, column, [0.5])[0]
    return weights.agg(
        zero(F.min(column)).alias("least"), F.lit(median or 0.0).alias("median"), zero(F.max(column)).alias("greatest"), zero(F.avg(column)).alias("mean"), zero(F.stddev_pop(column)).alias("std")
    )


def grid_marginals(trials: DataFrame, parameters: list[str], score: str) -> DataFrame:
    """(parameter, value, mean): the mean score of every value of every tuned parameter."""
    long = trials.select(F.explode(F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters))).alias("x"), F.col(score).alias("s"))
    return long.groupBy("x.parameter", "x.value").agg(F.avg("s").alias("mean"))


def rejections(proposals: DataFrame, least: int = 3, share_: float = 0.0) -> DataFrame:
    """(term, n, share): terms of ``least`` or more rejected proposals (term, accepted) and their share of all rejected."""
    counts = proposals.filter(~F.col("accepted")).groupBy("term").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    return counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= least).select("term", "n", (F.col("n") / F.col("t")).alias("share")).filter(F.col("share") >= share_)


def importance(weight: Column) -> Column:
    """How much a standardised weight says."""
    size = F.abs(weight)
    return F.when(size >= 0.5, "high").when(size >= 0.1, "medium").when(size > 1e-3, "low").otherwise("none")


def newest_within(events: DataFrame, budget: int, text: str = "title") -> DataFrame:
    """Each customer's newest rows whose texts' estimated tokens add up to at most ``budget``."""
    newest = Window.partitionBy("customer_id").orderBy(F.desc("us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_used", F.sum(tokens(F.col(text))).over(newest)).filter(F.col("_used") <= budget).drop("_used")


def top_of_heads(attributes: DataFrame, most: int = 100) -> DataFrame:
    """(m, event_id, k, rn): the outcomes that each attribute head values most."""
    rn = F.row_number().over(Window.partitionBy("m").orderBy(F.desc("a"), "event_id", "k"))
    return attributes.withColumn("rn", rn.cast("long")).filter(F.col("rn") <= most).select("m", "event_id", "k", "rn")
