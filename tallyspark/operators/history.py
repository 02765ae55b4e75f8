"""Per-row history features: what a customer had done before this row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.binding import DAY_US

NEVER = 999.0


def prior_count(*keys: str) -> Column:
    """How many earlier rows share these keys."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy("us", "seq")) - 1).cast("long")


def recency_days(*keys: str) -> Column:
    """Whole 24-hour periods since the previous row of the keys, NEVER if there is none."""
    before = F.lag("us").over(Window.partitionBy(*keys).orderBy("us", "seq"))
    return F.coalesce(F.floor((F.col("us") - before) / DAY_US).cast("double"), F.lit(NEVER))


def rolling_count(days: int, *keys: str) -> Column:
    """Rows of the keys in (t - days, t], this one included; of rows at the same time only those up to this one."""
    span = Window.partitionBy(*keys).orderBy("us").rangeBetween(-(days * DAY_US - 1), 0)
    later = Window.partitionBy(*keys, "us").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    return (F.count("*").over(span) - F.count("*").over(later)).cast("double")


def state_features(events: DataFrame) -> DataFrame:
    """routine, novelty, recency_days, last_us, cat_affinity, cat_count_7d and cat_count_30d of every row.

    All windows start with customer_id, so one exchange by it serves them all.
    """
    dealt = events.repartition("customer_id")
    return dealt.withColumns(
        {
            "routine": prior_count("customer_id", "asin"),
            "recency_days": recency_days("customer_id", "asin"),
            "last_us": F.lag("us").over(Window.partitionBy("customer_id", "asin").orderBy("us", "seq")),
            "cat_affinity": prior_count("customer_id", "category"),
            "cat_count_7d": rolling_count(7, "customer_id", "category"),
            "cat_count_30d": rolling_count(30, "customer_id", "category"),
        }
    ).withColumn("novelty", (F.col("routine") == 0).cast("int"))


def min_events(events: DataFrame, least: int = 5) -> DataFrame:
    """Rows of customers with ``least`` rows or more, in one pass."""
    n = F.count("*").over(Window.partitionBy("customer_id"))
    return events.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def recent_titles(events: DataFrame, days: int = 30, most: int = 5, title: str = "title") -> DataFrame:
    """recent: the last ``most`` titles of the customer in [t - days, t), in time order; the array is empty without any.

    Rows of one time are one row for a while. The ``most`` times before have all titles that can count, as each has one
    at least; so a frame holds that many rows whatever a month holds, and one exchange by customer serves both steps.
    """
    tail = lambda a: F.slice(a, F.greatest(F.size(a) - most + 1, F.lit(1)), most)
    times = events.repartition("customer_id").groupBy("customer_id", "us").agg(F.collect_list(F.struct(*events.columns)).alias("_rows"))
    own = F.array_sort(F.transform("_rows", lambda x: F.struct(x["us"].alias("us"), x["seq"].alias("seq"), x[title].alias("title"))))
    before = Window.partitionBy("customer_id").orderBy("us").rowsBetween(-most, -1)
    seen = F.flatten(F.collect_list("_own").over(before))
    recent = F.transform(tail(F.filter("_seen", lambda x: x["us"] >= F.col("us") - days * DAY_US)), lambda x: x["title"])
    laid = times.withColumn("_own", tail(own)).withColumn("_seen", seen).select("_rows", recent.alias("recent"))
    return laid.select(F.explode("_rows").alias("_row"), "recent").select("_row.*", "recent")


def latest_before(timeline: DataFrame, probes: DataFrame, most: int, key: str = "customer_id", columns: tuple[str, ...] = ("us", "seq", "asin")) -> DataFrame:
    """As-of join: for each probe (key, probe_us, probe_id) the ``most`` latest timeline rows strictly before it.

    Timeline rows are numbered along their key. Laid on one time line with them, a probe only counts how many come
    first, and fetches the last of these by their numbers: an equi-join of ``most`` rows a probe, however long the past.
    """
    order = Window.partitionBy(key).orderBy("us", "seq")
    rows = timeline.select(key, F.row_number().over(order).cast("long").alias("number"), F.struct(*columns).alias("row"))
    marks = timeline.select(key, F.col("us").alias("at"), F.lit(None).cast(dict(probes.dtypes)["probe_id"]).alias("probe"), F.lit(1).alias("past"))
    asks = probes.select(key, F.col("probe_us").alias("at"), F.col("probe_id").alias("probe"), F.lit(None).cast("int").alias("past"))
    span = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = marks.unionByName(asks).withColumn("n", F.count("past").over(span)).filter("past is null")
    wanted = F.when(F.col("n") > 0, F.sequence(F.greatest(F.col("n") - most + 1, F.lit(1)), F.col("n")))
    got = seen.select(key, "probe", "at", F.explode_outer(wanted).alias("number")).join(rows, [key, "number"], "left")
    last = F.reverse(F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("number", "row")))))
    return got.groupBy(key, F.col("probe").alias("probe_id"), F.col("at").alias("probe_us")).agg(F.transform(last, lambda x: x["row"]).alias("examples"))
