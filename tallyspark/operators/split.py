"""Splits by time within a customer and by customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(n: Column, val_frac: float, test_frac: float) -> tuple[Column, Column]:
    """(val, test) rows of a customer with n rows: at least one of each, and one test row only if they would be all."""
    test = F.greatest(F.lit(1), F.floor(n * F.lit(float(test_frac))))
    val = F.greatest(F.lit(1), F.floor(n * F.lit(float(val_frac))))
    all_taken = test + val >= n
    return F.when(all_taken, 0).otherwise(val), F.when(all_taken, 1).otherwise(test)


def temporal_split(events: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """split: a customer's oldest rows are train, then val, the newest test."""
    whole, ordered = Window.partitionBy("customer_id"), Window.partitionBy("customer_id").orderBy("us", "seq")
    val, test = sizes(F.col("_n"), val_frac, test_frac)
    kind = F.when(F.col("_rn") <= F.col("_n") - test - val, "train").when(F.col("_rn") <= F.col("_n") - test, "val").otherwise("test")
    return events.withColumns({"_n": F.count("*").over(whole), "_rn": F.row_number().over(ordered)}).withColumn("split", kind).drop("_n", "_rn")


def shuffle_key(seed: int, key: str = "customer_id") -> Column:
    """A fixed random order of customers that other engines can compute, too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))


def ranked(ids: DataFrame, order: str, prefix: int = 2) -> DataFrame:
    """rank (from 0) and total over all rows by a hex key, without one task that holds all: ranks within the key's
    first digits, moved by the sizes of the stretches before."""
    parts = ids.withColumn("_part", F.substring(order, 1, prefix))
    sizes_ = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    w = Window.orderBy("_part")
    offsets = sizes_.select(
        "_part",
        F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )  # 16 ** prefix rows at most
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn("rank", own + F.col("_offset")).drop("_part", "_offset")


def cold_start_split(events: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1, seed: int = 42) -> DataFrame:
    """split by customer: shares of the shuffled customers are test and val; with over two customers each gets one."""
    ids = ranked(events.select("customer_id").distinct().withColumn("_key", shuffle_key(seed)), "_key")
    n = F.col("total")
    share = lambda f: F.when((F.floor(n * F.lit(float(f))) == 0) & (n > 2) & F.lit(f > 0), 1).otherwise(F.floor(n * F.lit(float(f))))
    kind = F.when(F.col("rank") < share(test_frac), "test").when(F.col("rank") < share(test_frac) + share(val_frac), "val").otherwise("train")
    return events.join(ids.select("customer_id", kind.alias("split")), "customer_id")


def kfold_buckets(events: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """(customer_id, bucket): shuffled customers in ``folds`` stretches, the first ones a customer longer."""
    ids = ranked(events.select("customer_id").distinct().withColumn("_key", shuffle_key(seed)), "_key")
    small, extra = F.floor(F.col("total") / folds), F.col("total") % folds
    cut = extra * (small + 1)
    bucket = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (small + 1))).otherwise(extra + F.floor((F.col("rank") - cut) / F.greatest(small, F.lit(1))))
    return ids.select("customer_id", bucket.cast("long").alias("bucket"))


def kfold(events: DataFrame, folds: int, seed: int = 42, val_frac: float = 0.1) -> DataFrame:
    """(fold, customer_id, split): each bucket is test once; of the others a share, at least one, is val."""
    buckets = kfold_buckets(events, folds, seed)
    table = buckets.select(F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), "customer_id", "bucket")
    rest = table.filter("bucket <> fold").withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("fold").cast("string"), F.lit(":"), F.col("customer_id")).cast("binary")))
    # the val customers of a fold are the least keys below the share's value; keys are uniform over 32 bits
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    least = rest.groupBy("fold").agg(F.min("_key").alias("_least"))  # a row for each fold
    rest, first = rest.join(F.broadcast(least), "fold"), F.col("_least") == F.col("_key")
    val = rest.select("fold", "customer_id", F.when((share < val_frac) | first, "val").otherwise("train").alias("split"))
    return val.union(table.filter("bucket = fold").select("fold", "customer_id", F.lit("test").alias("split")))
