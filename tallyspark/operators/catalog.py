"""What training rows say about items: popularity, brand, dominant category, first row and popularity bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running

# Title words that are no brand.
NO_BRAND = (
    "premium", "new", "upgraded", "upgrade", "original", "genuine", "authentic",
    "professional", "pro", "deluxe", "luxury", "ultra", "super", "best",
    "the", "a", "an", "for", "with", "by", "of",
    "2-pack", "3-pack", "4-pack", "6-pack", "10-pack", "pack",
    "set", "kit", "bundle", "case", "box",
)


def train(events: DataFrame) -> DataFrame:
    return events.filter("split = 'train'") if "split" in events.columns else events


def brand_token(title: Column) -> Column:
    """The first word of a title that may be a brand: lower case, no marks around it, no count or size; else empty."""
    marks = r"""^[,.:;!?()\[\]{}"']+|[,.:;!?()\[\]{}"']+$"""
    tokens = F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda t: F.regexp_replace(F.lower(t), marks, ""))
    good = F.filter(tokens, lambda t: (t != "") & ~t.isin(*NO_BRAND) & ~t.rlike(r"^[\d.\-x/]+$") & ~t.rlike(r"^\d+[a-z]{1,3}$"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def popularity(events: DataFrame) -> DataFrame:
    """(asin, popularity): how many training rows an item has."""
    return train(events).groupBy("asin").agg(F.count("*").alias("popularity"))


def attach_popularity(events: DataFrame) -> DataFrame:
    return events.join(popularity(events), "asin", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): each key's most frequent value; of equally frequent ones the one seen first."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct("us", "seq")).alias("first"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("n"), "first"))
    return counted.groupBy(key).agg(best.alias(value))


def brand_map(events: DataFrame) -> DataFrame:
    rows = train(events).withColumn("brand", brand_token(F.col("title"))).filter("brand <> ''")
    return mode_by(rows, "asin", "brand")


def attach_brand(events: DataFrame) -> DataFrame:
    return events.join(brand_map(events), "asin", "left").withColumn("brand", F.coalesce("brand", F.lit("")))


def dominant_category(events: DataFrame) -> DataFrame:
    return mode_by(train(events), "asin", "category")


def first_seen(events: DataFrame) -> DataFrame:
    """(asin, first_us); a split without training rows is an error for the caller's validator."""
    return train(events).groupBy("asin").agg(F.min("us").alias("first_us"))


def earliest_rows(events: DataFrame, columns: list[str]) -> DataFrame:
    """Each item's first training row, as columns."""
    row = F.min_by(F.struct(*columns), F.struct("us", "seq"))
    return train(events).groupBy("asin").agg(row.alias("row")).select("asin", "row.*")


def popularity_quantiles(events: DataFrame) -> DataFrame:
    """One row q50, q75, q95 over the items' popularity, interpolated."""
    q = F.percentile("popularity", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    return popularity(events).agg(q.alias("q")).select(F.col("q")[0].alias("q50"), F.col("q")[1].alias("q75"), F.col("q")[2].alias("q95"))


def band(n: Column, q50: Column, q75: Column, q95: Column) -> Column:
    """The popularity band: the first quantile that is reached from the top."""
    return F.when(n >= q95, "top 5%").when(n >= q75, "top 25%").when(n >= q50, "top 50%").otherwise("bottom 50%")


def pool_sizes(events: DataFrame) -> DataFrame:
    """As-of availability: for each row, how many items had been seen strictly before its time.

    No range join: first sightings are counted for each time, summed up along the times, and an event takes the sum of
    its own time by an equi-join. ``events`` with times nobody saw anything first at still get theirs, as the times of
    both sides are laid on one line.
    """
    first = first_seen(events).groupBy(F.col("first_us").alias("us")).agg(F.count("*").alias("fresh"))
    times = events.select("us").distinct().join(first, "us", "full").select("us", F.coalesce("fresh", F.lit(0)).cast("long").alias("fresh"))
    return events.join(running(times, ["us"], "fresh", name="pool").select("us", "pool"), "us")
